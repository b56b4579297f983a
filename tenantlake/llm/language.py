"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (n = 1..3, words marked off by a blank), most
frequent first. A document is ranked the same way and compared with each profile by out-of-place distance: the sum
over its n-grams of the difference in rank, a fixed maximum for one that the profile lacks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import as_text, chunks, crc_bucket

#: N-grams in a profile, of a language or of a document.
PROFILE = 400
ORDERS = 3
UNKNOWN = "und"
#: Distinct (language, n-gram) counts that a counting task holds before it passes them on.
HELD = 1 << 20
#: Characters of text counted or ranked at once: each gives several n-grams, held and sorted as 64-bit integers.
PIECE = 1 << 18
#: Texts counted or ranked at once: their numbers share 64 bits with an n-gram's 48.
ROWS = 1 << 16
_BLANK = 1
_fold: np.ndarray | None = None


def _folding() -> np.ndarray:
    """For every code point below 65,536 the lower-case letter's, or a blank for what isn't a letter."""
    global _fold
    if _fold is None:
        table = np.full(0x10000, _BLANK, np.uint16)
        for i in range(0x10000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                table[i] = ord(low[0]) if len(low) == 1 and ord(low) < 0x10000 else i
        _fold = table
    return _fold


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, n-gram) of every n-gram of the texts; 16 bits a letter, letters above U+FFFF folded into 16."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("".join(f"\x01{t}\x01" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    high = points > 0xFFFF
    letters = _folding()[np.where(high, 0, points)]
    if high.any():
        at = np.flatnonzero(high)
        alpha = np.array([chr(p).isalpha() for p in points[at].tolist()])
        letters[at] = np.where(alpha, points[at] & 0xFFFF | 2, _BLANK)
    owner = np.repeat(np.arange(len(texts)), sizes + 2)
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] != _BLANK) | (letters[:-1] != _BLANK) | (owner[1:] != owner[:-1])
    letters, owner = letters[keep].astype(np.uint64), owner[keep]
    blank = letters == _BLANK
    found = [(owner[~blank], letters[~blank])]
    for n in range(2, ORDERS + 1):
        if len(letters) < n:
            break
        last = len(letters) - n + 1
        key = np.zeros(last, np.uint64)
        ok = owner[:last] == owner[n - 1:]
        for i in range(n):
            key = key << np.uint64(16) | letters[i:last + i]
            if 0 < i < n - 1:
                ok &= ~blank[i:last + i]
        found.append((owner[:last][ok], key[ok]))
    return np.concatenate([o for o, _ in found]), np.concatenate([k for _, k in found])


def _counted(owner: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) with their counts, ordered by both."""
    both = owner.astype(np.uint64) << np.uint64(48) | key
    distinct, n = np.unique(both, return_counts=True)
    return (distinct >> np.uint64(48)).astype(np.int64), distinct & np.uint64((1 << 48) - 1), n


def _ranked(owner: np.ndarray, key: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``size`` most frequent keys of each owner with their ranks from 0; ties by key."""
    order = np.lexsort((key, -n, owner))
    owner, key = owner[order], key[order]
    first = np.concatenate(([True], owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, bool)
    start = np.flatnonzero(first)
    rank = np.arange(len(owner)) - np.repeat(start, np.diff(np.concatenate((start, [len(owner)]))))
    top = rank < size
    return owner[top], key[top], rank[top]


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of every language, counted over all rows with a text and a language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names: dict[str, int] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                owner, key, n = (np.concatenate(x) for x in zip(*held))
                both, where = np.unique(owner.astype(np.uint64) << np.uint64(48) | key, return_inverse=True)
                total = np.bincount(where, n, len(both)).astype(np.int64)
                label = pa.DictionaryArray.from_arrays(pa.array((both >> np.uint64(48)).astype(np.int32)), pa.array(list(names)))
                gram = (both & np.uint64((1 << 48) - 1)).astype(np.int64)
                held.clear()
                yield pa.RecordBatch.from_arrays([label.cast(pa.string()), pa.array(gram), pa.array(total)],
                                                 names=["lang", "gram", "n"])

        for batch in batches:
            texts, langs = as_text(batch.column(0)), batch.column(1).to_pylist()
            for lo, hi in chunks(texts, PIECE, ROWS):
                owner, key = _grams(texts[lo:hi])
                number = np.array([names.setdefault(x, len(names)) for x in langs[lo:hi]], np.int64)
                held.append(_counted(number[owner], key))
                if sum(len(x[0]) for x in held) > HELD:
                    yield from flush()
        yield from flush()

    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(
        F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = labelled.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # the top of each language by a struct comparison, so that no language's whole list is sorted in one task
    part = F.pmod(F.xxhash64("gram"), F.lit(64))
    best = counts.groupBy("lang", part.alias("part")).agg(_top(size).alias("top"))
    best = best.select("lang", F.explode("top").alias("t")).select("lang", F.col("t.gram").alias("gram"), (-F.col("t.less")).alias("n"))
    best = best.groupBy("lang").agg(_top(size).alias("top"))
    return best.select("lang", F.posexplode("top").alias("rank", "t")).select("lang", F.col("t.gram").alias("gram"), "rank")


def _top(size: int) -> Column:
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col("gram").alias("gram"))))
    return F.slice(items, 1, size)


class Profiles:
    """Learned profiles as arrays: at most languages x profile size entries."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size = size
        self.langs = sorted({r[0] for r in rows})
        self.keys = np.array(sorted({r[1] for r in rows}), np.uint64)
        self.ranks = np.full((len(self.keys), len(self.langs)), -1, np.int64)
        place = {k: i for i, k in enumerate(self.keys.tolist())}
        for lang, gram, rank in rows:
            self.ranks[place[gram], self.langs.index(lang)] = rank

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; ``und`` and 0 without letters or without any profile."""
        owner, key, rank = _ranked(*_counted(*_grams(texts)), self.size)
        grams = np.bincount(owner, minlength=len(texts))
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        theirs = np.where((self.keys[at] == key)[:, None], self.ranks[at], -1)
        gap = np.where(theirs < 0, self.size, np.abs(theirs - rank[:, None]))
        distance = np.stack([np.bincount(owner, gap[:, i], len(texts)) for i in range(len(self.langs))], 1)
        best = distance.argmin(1)
        score = np.where(grams > 0, 1 - distance.min(1) / np.maximum(1, grams * self.size), 0.0)
        return [self.langs[b] if g else UNKNOWN for b, g in zip(best.tolist(), grams.tolist())], score


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles of all labelled rows of ``docs``; the driver gets ``size`` n-grams a language."""
    rows = [tuple(r) for r in profiles(docs, text, lang, size).select("lang", "gram", "rank").collect()]
    return Profiles(rows, size)


def predicted(text: Column, model: Profiles) -> Column:
    """struct(lang_pred, score) of a text column; whole texts, no shuffle."""
    @F.arrow_udf("lang_pred string, score double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = as_text(batch)
            langs, scores = [], [np.zeros(0)]
            for lo, hi in chunks(texts, PIECE, ROWS):
                a, b = model.predict(texts[lo:hi])
                langs += a
                scores.append(b)
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(np.concatenate(scores), pa.float64())], names=["lang_pred", "score"])

    return run(text.cast("string"))


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return crc_bucket(doc_id, modulus) == remainder


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, learned from the rows that aren't held out.

    Ties in distance go to the language first in order, ties in frequency to the smaller n-gram code. A null, empty
    or letterless text is ``und`` with score 0, as is every text when nothing was learned. The score is the share
    of the largest possible distance that the best language leaves. Repeated rows count as often as they occur.
    """
    out = held_out(F.col("doc_id"))
    model = fit(docs.select("doc_id", "text", "lang").where(~out), size=size)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"),
                       predicted(F.col("text"), model).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
