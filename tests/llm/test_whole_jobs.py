"""Passages and articles that an earlier form of the operators lost."""

from __future__ import annotations

import os
import random
import re

import pytest

from tenantlake.llm import decontaminate, html_extract, language
from tenantlake.llm.common import chunks, table
from tests.llm.data import SF

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


def least_distance(item, text):
    """Least word edit distance of the item to any passage of the text, of whatever length."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(text):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return min(row)


def test_leaks_with_words_put_in_or_taken_out():
    chance = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [chance.choices(vocabulary, k=chance.randint(1, 60)) for _ in range(60)]
    known = decontaminate.Items(list(range(60)), [" ".join(i) for i in items])
    texts = []
    for k, item in enumerate(items):
        words, edits = list(item), decontaminate.allowed(len(item)) + (k % 5 == 4)  # some by one edit too many
        for _ in range(edits):
            kind = ("insert", "delete", "any")[k % 3]
            kind = chance.choice(["insert", "delete", "replace"]) if kind == "any" else kind
            at = chance.randrange(max(1, len(words)))
            words[at:at + (kind != "insert")] = [] if kind == "delete" else [chance.choice(vocabulary)]
        texts.append([*chance.choices(vocabulary, k=30), *words, *chance.choices(vocabulary, k=30)])
    got = {(t, i): d for t, i, _, d, _ in known.find([" ".join(t) for t in texts])}
    want = {(t, k): d for t, text in enumerate(texts) for k, item in enumerate(items)
            if (d := least_distance(item, text)) <= decontaminate.allowed(len(item))}
    assert len(want) >= 48 and got == want


def test_leak_of_forty_words_with_five_in_the_middle():
    words = [f"w{i}" for i in range(40)]
    known = decontaminate.Items([7], [" ".join(words)])
    around = " ".join(f"x{i}" for i in range(30))
    longer = " ".join([*words[:20], *"abcde", *words[20:]])
    shorter = " ".join([*words[:18], *words[23:]])
    for text in (longer, shorter):
        assert [(i, d) for _, i, _, d, _ in known.find([f"{around} {text} {around}"])] == [(7, 5)]


STORY = [("sentence %d of the story, long enough to be read as text, and then some more of it. " % k) * 4 for k in range(6)]
STORY = [s.strip() for s in STORY]


def test_story_in_a_plain_div_beside_teasers():
    teasers = "".join(f"<article><a href=/{k}><p>Teaser {k} says a whole sentence of text about another page of ours, to be read there "
                      f"and not here, however long it goes on and on and on.</p></a></article>" for k in range(3))
    page = f"<body><div><h1>Story</h1>{''.join(f'<p>{s}</p>' for s in STORY)}</div><div>{teasers}</div></body>"
    got = html_extract.main_text(page).split("\n")
    assert got[:7] == ["Story", *STORY]


def test_links_inside_an_article_are_judged_by_their_ratio():
    links = "<ul>" + "".join(f"<li><a href=/{k}>Link {k}</a></li>" for k in range(12)) + "</ul>"
    paragraphs = [f"<p>{s}</p>" for s in STORY]
    page = f"<body><article>{''.join(paragraphs[:3])}{links}{''.join(paragraphs[3:])}</article></body>"
    assert html_extract.main_text(page).split("\n") == STORY


@needs_tables
def test_shared_pages_without_their_article_tags(spark):
    for r in table(spark, SF, "pages").collect():
        for bare in (re.sub(r"</?(?:article|main)\b[^>]*>", "", r.html), re.sub(r"(?<=[</])(?:article|main)\b", "div", r.html)):
            assert html_extract.main_text(bare) == html_extract.main_text(r.html) != ""


@pytest.mark.parametrize("around", [
    "<article class='post category-advertising'>", "<div id='page' class='has-sidebar'>", "<form action=/x>",
    "<div class='col hidden-xs-down widget-area-off content'>", "<div class='sidebar'>", "<div class='content-sidebar-wrap'>"])
def test_a_name_does_not_silence_most_of_a_page(around):
    close = "</" + re.match(r"<(\w+)", around)[1] + ">"
    page = f"<body><nav><a>Home</a></nav>{around}{''.join(f'<p>{s}</p>' for s in STORY)}{close}<div class='ad-box'>Buy this</div></body>"
    assert html_extract.main_text(page).split("\n") == STORY


def test_heading_in_an_articles_own_header():
    page = f"<article><header class='entry-header'><h1>Story</h1></header>{''.join(f'<p>{s}</p>' for s in STORY)}</article>"
    assert html_extract.main_text(page).split("\n") == ["Story", *STORY]


def test_an_unclosed_named_inline_element_ends_with_its_block():
    page = f"<article><p>{STORY[0]} <span class='ad'>Buy</p>{''.join(f'<p>{s}</p>' for s in STORY[1:])}</article>"
    assert html_extract.main_text(page).split("\n") == STORY


SHORT = ["A short report", "The council met on Monday and agreed on the plan for the bridge.", "Work starts in May.", "The cost is not known yet."]
LONG_COMMENT = "I have been reading this paper for years and I must say that the plan is not what we were promised at all. " * 5


def page_of(blocks):
    return "".join(f"<h1>{b}</h1>" if i == 0 else f"<p>{b}</p>" for i, b in enumerate(blocks))


def comments(tag, names, n=6):
    return f"<{tag} {names}>" + "".join(f"<li><div><p>{LONG_COMMENT}{k}</p></div></li>" for k in range(n)) + f"</{tag}>"


#: Pages marked by hand, none by an article element: the blocks of the article stand first, all else isn't part of it.
MARKED = {
    "comment list after main": (SHORT, "<main>{}</main>" + comments("ol", "class='comment-list'")),
    "comments in the article's holder": (SHORT, "<div class='post'>{}" + comments("section", "id=comments") + "</div>"),
    "thread of bare articles": (SHORT, "<div class='content'>{}</div><div class='comments'>" + f"<article><p>{LONG_COMMENT}</p></article>" * 9 + "</div>"),
    "discussion before the article": (SHORT, comments("div", "class='disqus-thread'") + "<div>{}</div>"),
    "replies without a list": (SHORT, "<div id=story>{}</div>" + f"<div class='reply'><p>{LONG_COMMENT}</p></div>" * 12),
    "cookie notice": (SHORT, "<div class='cookie-consent'><p>We use cookies to make this page work and to learn how it is used by all of you "
                      "who read it every day.</p><p>" + LONG_COMMENT + "</p></div><div>{}</div>"),
    "newsletter and advert": (SHORT, "<div>{}</div><div class='newsletter-signup'><p>" + LONG_COMMENT + "</p></div><div id='ad-17'><p>" + LONG_COMMENT * 3 + "</p></div>"),
    "dialog by role": (SHORT, "<div role=dialog><p>" + LONG_COMMENT * 2 + "</p></div><div>{}</div>"),
    "popup around main": (SHORT, "<div class='overlay'><main>{}</main></div>"),
    "sponsored article": (SHORT, "<article class='post sponsored'>{}</article>"),
    "layout names around all": (STORY, "<div class='sidebar-wrap'><div class='widget'>{}</div></div><nav><a>Home</a></nav>"),
    "one name inside another": (STORY, "<div class='sidebar'><div class='inner'>{}</div><div class='share'><a>Share</a></div></div>"),
    "story in a form": (STORY, "<form><div class='content'>{}</div><input name=q></form>"),
}


@pytest.mark.parametrize("kind", MARKED)
def test_pages_marked_by_hand(kind):
    blocks, around = MARKED[kind]
    inside = page_of(blocks) if blocks is SHORT else "".join(f"<p>{b}</p>" for b in blocks)
    assert html_extract.main_text(f"<html><body>{around.replace('{}', inside)}</body></html>").split("\n") == blocks


def test_formulas_stay_in_their_line():
    page = f"<article><p>{STORY[0]} <math><mi>a</mi><mo>+</mo><mn>1</mn><annotation>a+1</annotation></math> holds.</p><p>{STORY[1]}</p></article>"
    assert html_extract.main_text(page).split("\n") == [f"{STORY[0]} a+1 holds.", STORY[1]]


@pytest.mark.parametrize("markup", [
    "<div class='sidebar'>x" * 100_000, "<div class='ad'>" * 100_000, "<div>x" * 100_000 + "</b></i></section>" * 100_000,
    "<span class='ad'>" * 100_000 + "<div></div>x" * 100_000, "<ul>" * 50_000 + "<li>x" * 100_000, "<p class='widget'>x" * 100_000])
def test_malformed_markup_takes_time_in_proportion(markup):
    import time

    began = time.process_time()
    html_extract.main_text(f"<body><p>{STORY[0]}</p>{markup}")
    assert time.process_time() - began < 15  # some seconds on a slow machine; by the square it would be hours


def test_items_without_an_id_are_searched(spark):
    words = ["alpha beta gamma delta epsilon zeta eta theta iota kappa", "one two three four five six seven eight nine ten"]
    items = spark.createDataFrame([(None, words[0]), (None, words[1]), (0, "red orange yellow green blue indigo violet"), (None, None)],
                                  "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {words[0]} it is"), (2, f"and {words[1]} and {words[0]}"), (3, "nothing of it"),
                                  (4, "red orange yellow green blue indigo violet")], "doc_id long, text string")
    for rows in (1, 100):  # items in several parts, and in one
        got = sorted(((r.doc_id, r.item_id) for r in decontaminate.leaks(docs, items, item_rows=rows).collect()), key=str)
        assert got == [(1, None), (2, None), (2, None), (4, 0)]
        assert [r.doc_id for r in decontaminate.clean(docs, items, item_rows=rows).collect()] == [3]


def test_texts_counted_at_once_have_numbers_of_their_own(spark):
    texts = ["aa", "bb"] * 40_000
    assert max(hi - lo for lo, hi in chunks(texts, language.PIECE, language.ROWS)) == language.ROWS
    assert list(chunks([""] * 5, 10, 2)) == [(0, 2), (2, 4), (4, 5)] and list(chunks([], 10, 2)) == []
    model = language.fit(spark.createDataFrame([("aa aa", "a"), ("bb bb", "b")], "text string, lang string"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200000")  # one batch of all texts
    try:
        rows = spark.range(0, 80_000, 1, 1).selectExpr("if(id % 2 = 0, 'aa', 'bb') as text", "if(id % 2 = 0, 'a', 'b') as lang")
        wrong = rows.select("lang", language.predicted(rows["text"], model).alias("p")).where("p.lang_pred <> lang")
        assert wrong.count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
