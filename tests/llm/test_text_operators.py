"""Operators that work on each text by itself: extraction, token counts, language, quality, toxicity."""

from __future__ import annotations

import math
import os
import re
from html import unescape

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenantlake.llm import hashed_text, html_extract, language, quality, tokens, toxicity
from tenantlake.llm.common import HashIndex, ship, slice_hashes, table
from tests.llm.data import DIRTY, SF, dirty, empty

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


@pytest.fixture(autouse=True)
def code(spark):
    ship(spark)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, really quite a lot of them.</div>
<aside>Related things to read, a long list of them indeed</aside>
<article><h1>Title &amp; more</h1><p>First   paragraph with
a break &lt;here&gt;.<p>Short.</p><form><input value=x>Send us your mail</form><div class="ad">Buy this now</div>
<p>Last <b>bold</b> one&nbsp;&#233;.</p><section id="comments"><p>I disagree with all of this, said a reader.</p></section></article>
<footer>&copy; somebody</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_extract.main_text(PAGE) == "Title & more\nFirst paragraph with a break <here>.\nShort.\nLast bold one é."


def test_main_text_without_an_article_element():
    page = ("<body><div id=menu><a>a</a><a>b</a></div><div><p>" + "word " * 60 + "</p><p>ok.</p><p>" + "more " * 60
            + "</p></div><div><a>x</a> <a>y</a></div>")
    assert html_extract.main_text(page).split("\n")[1] == "ok."
    assert "x" not in html_extract.main_text(page).split("\n")[-1]


def test_odd_pages(spark):
    pages = spark.createDataFrame(
        [(1, None), (2, ""), (3, "plain text"), (4, "<p>unclosed <b>"), (5, "<script>only"), (6, "<nav>menu</nav>"), (6, "<nav>menu</nav>")],
        "page_id long, html string").selectExpr("*", "'u' as url", "9 as text", "8 as n_chars")
    got = html_extract.extract_pages(pages).orderBy("page_id").select("page_id", "text", "n_chars").collect()
    assert [(r.text, r.n_chars) for r in got] == [("", 0), ("", 0), ("plain text", 10), ("unclosed", 8), ("", 0), ("", 0), ("", 0)]
    assert html_extract.extract_pages(pages.where("false")).count() == 0


@needs_tables
def test_pages_against_the_article_element(spark):
    for r in html_extract.extract_pages(table(spark, SF, "pages")).collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        blocks = [re.sub(r"\s+", " ", unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " ")))).strip()
                  for b in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b)


def test_token_counts_against_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.public_path(tokens.BYTE_BPE))
    docs = dirty(spark)
    want = sorted((str(i), len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in DIRTY)
    got = tokens.token_counts(docs).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert tokens.token_counts(empty(spark)).count() == 0


def test_ids_of_pieces_against_the_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.public_path(tokens.WORD_BPE))
    texts = [t or "" for _, t, _ in DIRTY] + ["ÀÉÎ straße ÿ x'y don't 'S a\x1cb", "a\xa0b  12 3.4", "ªº ΣΑΣ é", "THE!! the%%%"]
    for text, ids in zip(texts, tokens.Vocabulary.at(tokens.public_path(tokens.WORD_BPE)).ids(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:40]


def test_hash_index_and_slices():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64))
    index = HashIndex(keys[:100])
    index.add(keys[100:])
    assert index.find(keys).tolist() == list(range(len(keys)))
    assert (index.find(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    data = np.frombuffer(b"abcXabcXabd", np.uint8)
    a, b, c = slice_hashes(data, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert a == b != c


def brute_language(train, text, size):
    def grams(t):
        word, out = "", {}
        folded = "".join(c.lower() if c.isalpha() else " " for c in t)
        for word in folded.split():
            s = f" {word} "
            for n in (1, 2, 3):
                for i in range(len(s) - n + 1):
                    g = s[i:i + n]
                    if g != " " and (n == 1 or g.strip()):
                        out[g] = out.get(g, 0) + 1
        return out

    def code(g):
        x = 0
        for ch in g:
            x = x << 16 | (1 if ch == " " else ord(ch))
        return x

    def ranked(counts):
        return {g: r for r, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[:size])}

    profiles = {}
    for t, lang in train:
        c = profiles.setdefault(lang, {})
        for g, n in grams(t).items():
            c[g] = c.get(g, 0) + n
    profiles = {k: ranked(v) for k, v in profiles.items()}
    mine = ranked(grams(text))
    if not mine or not profiles:
        return "und", 0.0
    d = {k: sum(abs(p[g] - r) if g in p else size for g, r in mine.items()) for k, p in sorted(profiles.items())}
    best = min(d, key=lambda k: d[k])
    return best, 1 - d[best] / (len(mine) * size)


@needs_tables
def test_language_against_brute_force(spark):
    shared = table(spark, SF, "documents").select("doc_id", "text", "lang").orderBy("doc_id").limit(60).collect()
    docs = spark.createDataFrame([tuple(r) for r in shared] + [r for r in DIRTY if len(r[1] or "") < 200],
                                 "doc_id long, text string, lang string")
    rows = docs.withColumn("out", language.held_out(F.col("doc_id"))).collect()
    train = [(r.text, r.lang) for r in rows if not r.out and r.text is not None and r.lang is not None]
    got = {(r.doc_id, r.lang_pred, round(r.score, 9), r.held_out) for r in language.identify(docs, size=50).collect()}
    want = set()
    for r in rows:
        lang, score = brute_language(train, r.text or "", 50)
        want.add((r.doc_id, lang, round(score, 9), r.out))
    assert got == want


@needs_tables
def test_language_held_out_accuracy(spark):
    docs = table(spark, SF, "documents")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count() > 0


def test_language_of_odd_tables(spark):
    assert language.identify(empty(spark)).count() == 0
    unlabelled = dirty(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.identify(unlabelled).collect()} == {("und", 0.0)}


def test_ordinal_regression_orders_three_grades():
    chance = np.random.default_rng(3)
    texts, grades = [], []
    for i in range(300):
        g = i % 3
        words = ["good"] * (g == 2) + ["fair"] * (g == 1) + ["bad"] * (g == 0)
        texts.append(" ".join(list(chance.choice(["on", "of", "at", "by", "to"], 20)) + words * 2))
        grades.append(g)
    parts = [hashed_text.features(t, True) for t in texts]
    start = np.concatenate(([0], np.cumsum([len(n) for n, _ in parts])))
    model = quality.fit_ordinal(start, np.concatenate([n for n, _ in parts]), np.concatenate([v for _, v in parts]), np.array(grades))
    scores = np.array([model.score(t) for t in texts])
    assert (np.diff(model.thresholds) >= 0).all()
    assert (np.abs(model.expected(scores) - grades) < 0.5).mean() > 0.95
    tails = model.tails(scores)
    assert (tails[:, 0] >= tails[:, 1]).all() and tails.min() >= 0 and tails.max() <= 1


@needs_tables
def test_quality_and_toxicity_on_labelled_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    rated = quality.rate_documents(docs, labels, rows=250).join(labels, "doc_id")
    assert rated.where("keep = (quality = 1)").count() >= 0.95 * rated.count() > 0
    low = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), F.col("toxic").alias("bad"))
    scored = toxicity.score_toxicity(docs, low, ("low_quality", "bad")).join(low, "doc_id")
    assert scored.where("toxic and bad = 0").count() <= 0.01 * scored.count()
    assert scored.where("toxic and bad = 1").count() >= 0.5 * scored.where("bad = 1").count() > 0


def test_classifiers_on_odd_tables(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, None, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    for some in (labels, labels.where("false"), labels.where("doc_id = 1")):
        got = quality.rate_documents(dirty(spark), some).collect()
        assert len(got) == len(DIRTY) and all(0 <= r.p_tail <= 1 for r in got)
        got = toxicity.score_toxicity(dirty(spark), some.selectExpr("doc_id", "1 - quality as low_quality", "toxic")).collect()
        assert len(got) == len(DIRTY) and all(0 <= r.p_toxic <= 1 for r in got)
    assert all(r.keep for r in quality.rate_documents(dirty(spark), labels.where("false")).collect())
    assert quality.rate_documents(empty(spark), labels).count() == 0
    assert toxicity.score_toxicity(empty(spark), labels.selectExpr("doc_id", "quality as low_quality", "toxic")).count() == 0


def test_chain_learns_from_out_of_fold_probabilities():
    """The second category is the first one's noisy copy, so its link must use the first probability."""
    chance = np.random.default_rng(5)
    texts, y = [], []
    for _ in range(400):
        bad = chance.random() < 0.5
        texts.append(" ".join([*chance.choice(["on", "of", "at", "by"], 10), *(["foul"] if bad else [])]))
        y.append((int(bad), int(bad)))
    parts = [hashed_text.features(t, False) for t in texts]
    start = np.concatenate(([0], np.cumsum([len(n) for n, _ in parts])))
    links = toxicity.fit_chain(start, np.concatenate([n for n, _ in parts]), np.concatenate([v for _, v in parts]),
                               np.array(y), np.arange(400))
    assert len(links) == 2 and len(links[0].earlier) == 0 and links[1].earlier[0] > 0
    assert math.isfinite(links[1].bias)


def _sample(seed, n):
    """Hashed features of short made texts, their dense matrix, and labels that hang on some of the words."""
    chance = np.random.default_rng(seed)
    texts = [" ".join(chance.choice(["on", "of", "good", "bad", "foul", "at"], int(chance.integers(0, 9)))) for _ in range(n)]
    parts = [hashed_text.features(t, True) for t in texts]
    start = np.concatenate(([0], np.cumsum([len(k) for k, _ in parts])))
    dense = [{int(k): float(v) for k, v in zip(*p)} for p in parts]
    return texts, dense, start, np.concatenate([k for k, _ in parts]), np.concatenate([v for _, v in parts])


def _slow_telling(dense, y):
    """Features that enough rows have and whose correlation with ``y`` is beyond chance, one by one."""
    mean = sum(y) / len(y)
    spread = sum((v - mean) ** 2 for v in y) / len(y)
    used = []
    for k in sorted({k for row in dense for k in row}):
        together = sum(row[k] * (v - mean) for row, v in zip(dense, y) if k in row)
        alone = sum(row[k] ** 2 for row in dense if k in row) * spread
        if sum(row.get(k, 0) > 0 for row in dense) >= hashed_text.LEAST_ROWS and alone > 0 and abs(together) >= hashed_text.DEVIATIONS * math.sqrt(alone):
            used.append(k)
    return used


def _slope(loss, at, i):
    up, down = list(at), list(at)
    up[i] += 1e-5
    down[i] -= 1e-5
    return (loss(up) - loss(down)) / 2e-5


def test_ordinal_fit_against_differences_of_the_likelihood():
    texts, dense, start, number, value = _sample(1, 160)
    rank = [2 if "good" in t else 0 if "bad" in t else 1 for t in texts]
    model = quality.fit_ordinal(start, number, value, np.array([10, 20, 40])[rank], steps=6)
    used = _slow_telling(dense, rank)
    assert used

    def logistic(x):
        return 1 / (1 + math.exp(-x))

    def loss(p):
        weights, cuts = p[:len(used)], p[len(used):]
        total = 0.0
        for row, r in zip(dense, rank):
            score = sum(row.get(k, 0.0) * w for k, w in zip(used, weights))
            at_most = logistic(cuts[r] - score) if r < 2 else 1.0
            total -= math.log(at_most - (logistic(cuts[r - 1] - score) if r else 0.0))
        return total / len(rank) + quality.PENALTY / 2 * sum(w * w for w in weights)

    shares = [sum(r < j for r in rank) / len(rank) for j in (1, 2)]
    at = [0.0] * len(used) + [math.log(s / (1 - s)) for s in shares]
    seen = [1e-8] * len(at)
    for _ in range(6):
        slopes = [_slope(loss, at, i) for i in range(len(at))]
        seen = [q + g * g for q, g in zip(seen, slopes)]
        at = [a - quality.RATE * g / math.sqrt(q) * (2 if i < len(used) else 1) for i, (a, g, q) in enumerate(zip(at, slopes, seen))]
        at[-1] = max(at[-2:])
    assert np.abs(model.weights[used] - at[:len(used)]).max() < 1e-3 and np.abs(model.thresholds - at[len(used):]).max() < 1e-3
    assert np.count_nonzero(model.weights) == len(used) and model.grades.tolist() == [10, 20, 40]


def test_chain_against_folds_fitted_one_by_one(monkeypatch):
    monkeypatch.setattr(toxicity, "STEPS", 5)
    texts, dense, start, number, value = _sample(2, 200)
    y = np.array([("bad" in t, "foul" in t or "bad" in t) for t in texts], int)
    ids = np.arange(200) * 7 - 300
    links = toxicity.fit_chain(start, number, value, y, ids)

    def probability(row, seen, fit):
        weights, chain, bias = fit
        return 1 / (1 + math.exp(-(sum(row.get(k, 0.0) * w for k, w in weights.items()) + sum(a * b for a, b in zip(seen, chain)) + bias)))

    def fit(rows, seen, want):
        used = _slow_telling(rows, want)
        width, share = len(seen[0]), sum(want) / len(want)

        def loss(p):
            model = dict(zip(used, p)), p[len(used):len(used) + width], p[-1]
            got = [probability(r, s, model) for r, s in zip(rows, seen)]
            nll = -sum(math.log(q if t else 1 - q) for q, t in zip(got, want)) / len(want)
            return nll + toxicity.PENALTY / 2 * sum(w * w for w in p[:-1])

        at = [0.0] * (len(used) + width) + [math.log(share / (1 - share))]
        squares = [1e-8] * len(at)
        for _ in range(5):
            slopes = [_slope(loss, at, i) for i in range(len(at))]
            squares = [q + g * g for q, g in zip(squares, slopes)]
            at = [a - toxicity.RATE * g / math.sqrt(q) for a, g, q in zip(at, slopes, squares)]
        return dict(zip(used, at)), at[len(used):len(used) + width], at[-1]

    fold = [(int(i) * 0x9E3779B97F4A7C15 % (1 << 64) >> 32) % toxicity.FOLDS for i in ids]
    assert set(fold) == set(range(toxicity.FOLDS))
    none = [[] for _ in texts]
    unseen = [0.0] * len(texts)
    for f in set(fold):
        inside = [i for i in range(len(texts)) if fold[i] != f]
        model = fit([dense[i] for i in inside], [none[i] for i in inside], y[inside, 0].tolist())
        for i in range(len(texts)):
            if fold[i] == f:
                unseen[i] = probability(dense[i], [], model)
    for link, want in zip(links, (fit(dense, none, y[:, 0].tolist()), fit(dense, [[p] for p in unseen], y[:, 1].tolist()))):
        assert want[0] and max(abs(link.weights[k] - w) for k, w in want[0].items()) < 5e-3
        assert abs(link.bias - want[2]) < 5e-3 and np.abs(link.earlier - want[1]).sum() < 5e-3


def test_the_sample_holds_one_document_of_an_id(spark):
    docs = spark.createDataFrame([(i % 10, f"{i // 10} text of words") for i in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    start, number, _, y, ids = hashed_text.labelled_sample(docs, labels, ("quality",), 6, True)
    assert len(ids) == len(set(ids.tolist())) == len(y) == 6 and len(start) == 7
    least = hashed_text.features("0 text of words", True)[0].tolist()
    assert all(number[a:b].tolist() == least for a, b in zip(start, start[1:]))
