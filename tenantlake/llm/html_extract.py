"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams its events into lines (blocks of text between block-level tags). Each line
has a ratio of characters to tags; the ratios are smoothed with a Gaussian along the page and cut at a threshold
into content and the rest. A content region is the element that holds lines above the threshold: all its lines
are taken, so short paragraphs and headings of an article stay. ``<article>`` and ``<main>`` join the regions inside
them and discard nothing elsewhere. Elements that are no article text by what they are (menus, scripts) yield no lines
at all, nor do those named as comments, notices or adverts, however much text they hold; a ``<main>`` inside, or inside
a notice or advert an ``<article>``, is read again. A form or a name of the layout (``class="sidebar"``) is evidence that
lowers the ratios of the lines inside, unless the element holds most of the page's text or its largest cluster.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing, in lines.
SIGMA = 1.0

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr "
    "math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder "
    "mover munderover mmultiscripts mtable mtr mtd annotation annotation-xml".split())
_NEVER = frozenset(
    "head title script style noscript template iframe object svg canvas button select option textarea input "
    "label nav footer aside dialog menu audio video annotation annotation-xml".split())
_FORMS = frozenset("form fieldset".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Block elements whose lines belong to the element around them.
_PARTS = _HEADINGS | {"p", "li", "html"}
_ROOTS = frozenset("article main".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar".split())
_NOTICE_ROLES = frozenset("dialog alert alertdialog".split())
#: Names of the layout, which an article's own holder may bear.
_NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar toolbar footer foot copyright sidebar "
    "side aside rail search form share sharing social related recommended pagination pager widget widgets skip hidden".split())
#: Names of what is no part of an article, of whatever size.
_COMMENTS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())
_NOTICES = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notification notifications alert popup modal overlay dialog newsletter subscribe subscription signup login "
    "disclaimer".split())
#: Last parts of a name that say nothing: ``ad-container`` is named ``ad``.
_HOLDERS = frozenset(
    "area bar block body box container content group holder inner item items left link links list outer panel posts right row "
    "section slot text thread unit wrap wrapper".split())
#: First parts of a name that says what an element has or is about, not what it is.
_ABOUT = frozenset("has no with without category tag".split())
_OWN_HEADERS = frozenset("article content entry post story".split())
#: What a line's ratio is multiplied by in a form or an element named as layout.
LOWERED = 0.1
#: One line of fewer characters in an element so named is a notice, even if the page has less text elsewhere.
NOTICE = 140
_LETTERS = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")


def _name(token: str) -> str:
    """The part of a class or id token that says what an element is; empty if it says what the element has."""
    parts = _LETTERS.findall(token)
    if not parts or parts[0] in _ABOUT:
        return ""
    while len(parts) > 1 and parts[-1] in _HOLDERS:
        parts.pop()
    return "own header" if parts[-1] == "header" and parts[0] in _OWN_HEADERS else parts[-1]


def _is_boilerplate(tag: str, attrs: list, in_root: bool) -> bool:
    """No article text by what it is."""
    if tag in _NEVER or (tag == "header" and not in_root):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    return any(name == "hidden" or (name == "aria-hidden" and value == "true")
               or (name == "style" and value and "display:none" in value.replace(" ", "").lower()) for name, value in attrs)


#: What the names around a line say: nothing, that it is in a notice or advert, or in a comment.
_PLAIN, _NOTICE, _COMMENT = range(3)


def _judged(tag: str, attrs: list, in_root: bool) -> tuple[bool, int]:
    """Whether an element is a form or named as layout, and whether it is named as a notice or comment."""
    doubt, kind = tag in _FORMS, _PLAIN
    if tag in ("html", "body", "main"):
        return doubt, kind
    for key, value in attrs:
        if not value or key not in ("class", "id", "role"):
            continue
        if key == "role":
            doubt |= value.lower() in _ROLES
            kind = max(kind, _NOTICE * (value.lower() in _NOTICE_ROLES))
            continue
        for token in value.lower().split():
            name = _name(token)
            doubt |= name in _NAMES and not (name == "header" and in_root)
            if name in _COMMENTS:
                kind = _COMMENT
            elif name in _NOTICES and tag != "article":  # a sponsored article is one
                kind = max(kind, _NOTICE)
    return doubt, kind


class _Open(NamedTuple):
    """An open element: its tag and number, whether it is dropped, the outermost article around it, the innermost
    doubtful element around it (a place in ``_Lines.doubts``), and what the names around it say."""

    tag: str
    number: int
    drop: bool
    root: int
    doubt: int
    kind: int


_PAGE = _Open("", 0, False, 0, 0, _PLAIN)


class _Lines(HTMLParser):
    """Collects (text, tags, element, root, doubt, heading, linked) of each line.

    Element and root are numbers of elements that hold the line; doubt is the place of the innermost doubtful one.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int, bool, bool]] = []
        self.open: list[_Open] = []
        self.blocks: list[int] = []  # places of the block elements in ``open``
        self.named: Counter = Counter()  # open elements by tag
        self.doubts: list[int] = [0]  # of each doubtful element the one around it; place 0 is the page
        self.parts: list[str] = []
        self.tags = self.numbered = self.skipped = self.linked = 0
        self.in_link = False

    def _break(self) -> None:
        if self.parts:
            text = _WHITE.sub(" ", "".join(self.parts)).strip()
            self.parts.clear()
            if text:
                at = self.open[self.blocks[-1]] if self.blocks else _PAGE
                self.lines.append((text, self.tags, at.number, at.root, at.doubt, at.tag in _HEADINGS, 2 * self.linked > len(text)))
                self.tags = 0
        self.linked = 0

    def _push(self, element: _Open) -> None:
        if element.tag not in _INLINE:
            self.blocks.append(len(self.open))
        self.open.append(element)
        self.named[element.tag] += 1
        self.skipped += element.drop

    def _pop(self) -> None:
        gone = self.open.pop()
        if self.blocks and self.blocks[-1] == len(self.open):
            self.blocks.pop()
        self.named[gone.tag] -= 1
        self.skipped -= gone.drop

    def handle_starttag(self, tag, attrs):
        block = tag not in _INLINE
        if block:
            self._break()
            self._end_at_block("p")  # an open paragraph ends at the next block
            if tag == "li":
                self._end_at_block("li")
        self.tags += 1
        if tag == "a":
            self.in_link = True
        if tag in _VOID:
            if tag == "br" and self._read():
                self.parts.append(" ")
            return
        around = self.open[-1] if self.open else _PAGE
        number, root, kind = around.number, around.root, around.kind
        drop = _is_boilerplate(tag, attrs, root > 0)
        doubt, own = _judged(tag, attrs, root > 0)
        drop |= (doubt or own > _PLAIN) and not block  # a part of a line can't be judged as a line
        if drop or block:
            if tag == "main" or (tag == "article" and kind == _NOTICE):
                kind = _PLAIN
            if drop or doubt or own or tag not in _PARTS:
                self.numbered += 1
                number = self.numbered
            if tag in _ROOTS and not root:
                root = number
            place = around.doubt
            if doubt and block:
                self.doubts.append(place)
                place = len(self.doubts) - 1
            self._push(_Open(tag, number, drop, root, place, max(kind, own)))

    def _read(self) -> bool:
        return not self.skipped and not (self.open and self.open[-1].kind)

    def _end_at_block(self, tag: str) -> None:
        """Close the innermost block if it is such a one, with the inline elements left open in it."""
        if self.blocks and self.open[self.blocks[-1]].tag == tag:
            at = self.blocks[-1]
            while len(self.open) > at:
                self._pop()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in ("svg", "math", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in _INLINE:
            self._break()
            self.in_link = False
        elif tag == "a":
            self.in_link = False
        if self.named[tag]:
            while self.open[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if self._read():
            self.parts.append(data)
            self.linked += len(data) * self.in_link


def _smoothed(ratios: list[float], sigma: float) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(ratios)):
        lo, hi = max(0, i - reach), min(len(ratios), i + reach + 1)
        weights = kernel[lo - i + reach:hi - i + reach]
        out.append(sum(w * r for w, r in zip(weights, ratios[lo:hi])) / sum(weights))
    return out


def _cut(ratios: list[float], sigma: float) -> tuple[list[bool], float]:
    """Whether each line is content by its smoothed ratio, and the threshold."""
    smooth = _smoothed(ratios, sigma)
    mean = sum(smooth) / len(smooth)
    threshold = min(max(smooth), math.sqrt(sum((x - mean) ** 2 for x in smooth) / len(smooth)))
    return [x >= threshold for x in smooth], threshold


def _mistrusted(lines: list[tuple], ratios: list[float], content: list[bool], doubts: list[int]) -> list[bool]:
    """Of each doubtful element whether its lines, or those of one around it, are doubted.

    An element is trusted if it holds most of the page's text, by its ratio, or all of its largest cluster, and more than
    one line or a long one. What an element holds is added up from the innermost ones outwards.
    """
    weights = [len(x[0]) * r for x, r in zip(lines, ratios)]
    total, largest, start = sum(weights), (0.0, 0, 0), 0
    for i in range(len(lines) + 1):
        if i == len(lines) or not content[i]:
            largest = max(largest, (sum(weights[start:i]), start, i))
            start = i + 1
    held, rows, chars, cluster = ([0.0] * len(doubts) for _ in range(4))
    for i, (x, weight) in enumerate(zip(lines, weights)):
        held[x[4]] += weight
        rows[x[4]] += 1
        chars[x[4]] += len(x[0])
        cluster[x[4]] += largest[1] <= i < largest[2]
    for e in range(len(doubts) - 1, 0, -1):
        for sums in (held, rows, chars, cluster):
            sums[doubts[e]] += sums[e]
    out = [False]
    for e in range(1, len(doubts)):
        most = 2 * held[e] > total or largest[2] > largest[1] and cluster[e] == largest[2] - largest[1]
        out.append(out[doubts[e]] or not (most and (rows[e] > 1 or chars[e] >= NOTICE)))
    return out


def main_text(html: str | None, sigma: float = SIGMA) -> str:
    """The article of one page, its blocks joined by a newline; empty for null, empty and boilerplate-only pages."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser._break()
    lines = parser.lines
    if not lines:
        return ""
    ratios = [len(x[0]) / max(1, x[1]) for x in lines]
    doubted = [False] * len(lines)
    if any(x[4] for x in lines):
        mistrusted = _mistrusted(lines, ratios, _cut(ratios, sigma)[0], parser.doubts)
        doubted = [mistrusted[x[4]] for x in lines]
        ratios = [r * LOWERED if d else r for r, d in zip(ratios, doubted)]
    content, threshold = _cut(ratios, sigma)
    strong = [yes and r >= threshold for yes, r in zip(content, ratios)]
    # an element is content if one of its own lines is, not only its neighbours'
    holders = {x[2] for x, yes, d in zip(lines, strong, doubted) if yes and not d}
    keep = [yes if d else x[2] in holders or (yes_too and not holders)
            for x, yes, yes_too, d in zip(lines, strong, content, doubted)]
    spans: dict[int, tuple[int, int]] = {}
    for i, (x, yes, d) in enumerate(zip(lines, keep, doubted)):
        if x[3] and yes and not d:
            spans[x[3]] = (spans.get(x[3], (i, i))[0], i)
    for root, (first, last) in spans.items():  # regions of one article are joined, link lists between them are not
        for i in range(first, last):
            keep[i] |= lines[i][3] == root and not lines[i][6] and not doubted[i]
        while first and lines[first - 1][3] == root and lines[first - 1][5] and not doubted[first - 1]:
            first -= 1  # headings in an element of their own
            keep[first] = True
    return "\n".join(x[0] for x, yes in zip(lines, keep) if yes)


def extract_pages(pages: DataFrame, html: str = "html", sigma: float = SIGMA) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` added (replacing columns so named); no shuffle, whole pages.

    A null or empty page has the empty text and 0 characters. Repeated rows are each extracted. Malformed markup
    is read as the parser reads it; an unclosed element reaches to the end of the page.
    """
    @F.arrow_udf("string")
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(x, sigma) for x in batch.to_pylist()], pa.string())

    out = pages.withColumn("text", text_of(F.col(html).cast("string")))
    return out.withColumn("n_chars", F.length("text").cast("long"))
