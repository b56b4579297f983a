"""Benchmark passages in documents, found by CGK embedding and bit sampling and verified by edit distance.

Symbols are words (runs of letters and digits after lower-casing). A window of an item's length is embedded by a
random walk: at each of three times its length steps the present word is copied out, and a random bit of (step,
word) says whether to move on to the next. Windows few edits apart walk in step again soon after each edit, so
their embeddings differ in few places. Repeated samples of places are the hash keys under which windows and items
meet, and so do a window and an item with one of the item's rarest runs of two words, of which one more is taken than
the allowed edits can break: walks lose step when words are inserted or removed, a whole run does not. Pairs that meet
are verified exactly, with a free end: the passage may have up to the allowed edits more or fewer words than the item.
Windows that share too few runs of q words with the items to be within the allowed edits (an edit takes away q of an
item's runs at most) are not embedded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import HashIndex, as_text, chunks, doc_texts, slice_hashes

SIMILARITY = 0.8
WALKS = 8
SAMPLES_PER_WALK = 8
PLACES = 3
#: Items that one pass over the documents holds; more are searched for in several passes.
ITEM_ROWS = 50_000
#: Lengths of the runs of words that are counted before a window is embedded.
RUNS = (3, 2)
#: Length of the runs of which an item's rarest are looked up.
_RARE = 2
_BLOCK = 2048
_ROWS = 1 << 14
_PART_OF_WORD = np.array([97 <= c < 123 or 48 <= c < 58 or c >= 128 for c in range(256)], np.int8)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's begin (one more entry than texts)."""
    raw = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    change = np.diff(np.concatenate(([0], _PART_OF_WORD[data], [0])).astype(np.int8))
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    return slice_hashes(data, starts, ends), np.searchsorted(starts, np.cumsum([0, *map(len, raw)]))


def allowed(length: int, similarity: float = SIMILARITY) -> int:
    """Edits that an item of so many words may differ by."""
    return math.floor((1 - similarity) * length + 1e-9)


def embed(windows: np.ndarray, steps: int) -> np.ndarray:
    """Each walk's embedding of each row of word hashes (0 past a row's end): walks x rows x steps."""
    n, length = windows.shape
    padded = np.concatenate((windows, np.zeros((n, 1), np.uint64)), axis=1).ravel()
    base = np.tile(np.arange(n) * (length + 1), (WALKS, 1))
    at = np.zeros((WALKS, n), np.int64)
    out = np.empty((steps, WALKS, n), np.uint64)
    walks = np.arange(WALKS, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for step in range(steps):
        word = padded[base + at]
        out[step] = word
        seed = walks + np.uint64((step * 0xC2B2AE3D27D4EB4F + 1) & 0xFFFFFFFFFFFFFFFF)
        at += (_mixed(word ^ seed) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, length, out=at)
    return out


def sampled_keys(embedded: np.ndarray, length: int) -> np.ndarray:
    """Hash keys of each row of ``length`` words, one column for each sample of places of each walk."""
    steps = 3 * length
    chance = np.random.default_rng(length)
    out = []
    for walk in range(WALKS):
        for s in range(SAMPLES_PER_WALK):
            key = np.full(embedded.shape[2], walk * SAMPLES_PER_WALK + s + 1, np.uint64)
            for place in chance.choice(steps, min(PLACES, steps), replace=False):
                key = _mixed(key ^ embedded[place, walk])
            out.append(key)
    return np.stack(out, 1)


def edit_distances(a: np.ndarray, b: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Least word edit distance of each row of ``a`` to a beginning, of up to ``lengths`` words, of the row of ``b``."""
    n, width = len(a), b.shape[1]
    row = np.tile(np.arange(width + 1), (n, 1))
    for i in range(a.shape[1]):
        above = row
        row = np.empty_like(above)
        row[:, 0] = i + 1
        swap = above[:, :-1] + (b != a[:, i:i + 1])
        for j in range(width):
            row[:, j + 1] = np.minimum(np.minimum(above[:, j + 1], row[:, j]) + 1, swap[:, j])
    return np.where(np.arange(width + 1) <= lengths[:, None], row, a.shape[1] + 1).min(1)


class Items:
    """Benchmark items by length, with the keys they meet windows under."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        hashes, edges = word_hashes(texts)
        sizes = np.diff(edges)
        runs = {q: [_runs(hashes[s:e], q) for s, e in zip(edges, edges[1:])] for q in RUNS}
        self.runs = {q: HashIndex(np.unique(np.concatenate([np.zeros(0, np.uint64), *runs[q]]))) for q in RUNS}
        number = [np.unique(self.runs[_RARE].find(r)) for r in runs[_RARE]]
        often = np.bincount(np.concatenate([np.zeros(0, np.int32), *number]), minlength=len(self.runs[_RARE].keys))
        self.groups = {}
        self.rare = {}
        for length in np.unique(sizes[sizes > 0]).tolist():
            which = np.flatnonzero(sizes == length)
            words = np.stack([hashes[edges[i]:edges[i + 1]] for i in which])
            key = sampled_keys(embed(words, 3 * length), length)
            order = np.argsort(key, axis=0)
            # runs of words that an item of this length has more than once
            again = {q: max(len(runs[q][i]) - len(np.unique(runs[q][i])) for i in which.tolist()) for q in RUNS}
            edits = allowed(length, similarity)
            needed = {q: length - q + 1 - q * edits - again[q] for q in RUNS}
            kept = _RARE * edits + 1  # of so many different runs one is left whole
            rare = [(r, k) for k, i in enumerate(which.tolist()) if len(number[i]) >= kept
                    for r in number[i][np.argsort(often[number[i]], kind="stable")[:kept]].tolist()]
            self.rare[length] = np.array(sorted(rare), np.int64).reshape(-1, 2)
            own = {}
            for q in RUNS:
                own[q] = np.zeros(len(self.runs[q].keys) + 1, bool)  # the last is for no run
                own[q][self.runs[q].find(np.concatenate([runs[q][i] for i in which]))] = True
                own[q][-1] = False
            self.groups[length] = (np.array([ids[i] for i in which], np.int64), words, np.take_along_axis(key, order, 0), order,
                                   edits, needed, own)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, int, int]]:
        """(text number, item id, first word, distance, words in the item) of the best window for each text and item."""
        hashes, edges = word_hashes(texts)
        n = len(hashes)
        if not n or not self.groups:
            return []
        owner = np.repeat(np.arange(len(texts)), np.diff(edges))
        end = edges[1:][owner]
        run, total = {}, {}
        for q in RUNS:
            number = np.full(n, -1, np.int32)
            number[:max(0, n - q + 1)] = self.runs[q].find(_runs(hashes, q))
            number[np.arange(n) + q > end] = -1
            # a run like the one before it counts once in a window, as its first
            fresh = (number >= 0) & (np.concatenate(([-1], number[:-1])) != number)
            run[q], total[q] = number, np.concatenate(([0], np.cumsum(fresh)))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        longest = max(length + edits for length, (*_, edits, _, _) in self.groups.items())
        start = np.arange(n)
        for q in RUNS:  # starts at which no item of any length can be
            least = min(needed[q] for *_, needed, _ in self.groups.values()) - 1
            start = start[total[q][np.minimum(start + longest, n)] - total[q][start] >= least]
        windows, lengths = [], []
        for length, (*_, edits, needed, own) in self.groups.items():
            here, stop = start, np.minimum(start + length + edits, end[start])
            fits = stop - start >= length - edits
            for q in RUNS:
                fits &= total[q][np.maximum(stop - q + 1, start)] - total[q][start] + 1 >= needed[q]
            here = here[fits]
            for q in RUNS:
                if needed[q] > 0:
                    here = np.concatenate([here[:0], *[
                        x[_distinct(run[q], own[q], x, np.minimum(x + length + edits, end[x]) - q + 1, length + edits - q + 1)
                          >= needed[q]]
                        for x in np.split(here, range(_ROWS, len(here), _ROWS))]])
            windows.append(here)
            lengths.append(np.full(len(here), length))
        windows, lengths = np.concatenate(windows), np.concatenate(lengths)
        for lo in range(0, len(windows), _BLOCK):
            here, longest = windows[lo:lo + _BLOCK], int(lengths[lo:lo + _BLOCK].max())
            reach = lengths[lo:lo + _BLOCK] + np.array([self.groups[x][4] for x in lengths[lo:lo + _BLOCK].tolist()])
            size = np.minimum(reach, end[here] - here)
            at = here[:, None] + np.arange(reach.max())
            rows = np.where(np.arange(reach.max()) < size[:, None], hashes[np.minimum(at, n - 1)], np.uint64(0))
            embedded = embed(np.where(np.arange(longest) < lengths[lo:lo + _BLOCK, None], rows[:, :longest], np.uint64(0)), 3 * longest)
            inside = np.where(np.arange(reach.max()) + _RARE <= size[:, None], run[_RARE][np.minimum(at, n - 1)], -1)
            for length in np.unique(lengths[lo:lo + _BLOCK]).tolist():
                ids, words, sorted_keys, order, edits, _, _ = self.groups[length]
                mine = np.flatnonzero(lengths[lo:lo + _BLOCK] == length)
                pairs = np.unique(np.concatenate((_meet(sampled_keys(embedded[:3 * length, :, mine], length), sorted_keys, order),
                                                  _share(inside[mine], self.rare[length]))), axis=0)
                for p in range(0, len(pairs), _BLOCK):
                    w, i = pairs[p:p + _BLOCK].T
                    w = mine[w]
                    distance = edit_distances(words[i], rows[w, :length + edits], size[w])
                    for k in np.flatnonzero(distance <= edits).tolist():
                        text = int(owner[here[w[k]]])
                        found = (int(distance[k]), int(here[w[k]] - edges[text]), length)
                        place = (text, int(ids[i[k]]))
                        if place not in best or found < best[place]:
                            best[place] = found
        return [(t, i, s, d, length) for (t, i), (d, s, length) in sorted(best.items())]


def _runs(hashes: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of ``q`` words."""
    n = max(0, len(hashes) - q + 1)
    out = np.zeros(n, np.uint64)
    for i in range(q):
        out = _mixed(out * np.uint64(3) ^ hashes[i:i + n])
    return out


def _distinct(run: np.ndarray, own: np.ndarray, start: np.ndarray, stop: np.ndarray, width: int) -> np.ndarray:
    """Different runs, of those that are some items' own, in each range of at most ``width`` runs."""
    at = start[:, None] + np.arange(max(1, width))
    rows = run[np.minimum(at, len(run) - 1)]
    rows = np.where((at < stop[:, None]) & own[rows], rows, -1)
    rows.sort(axis=1)
    return (rows[:, :1] >= 0).sum(1) + ((rows[:, 1:] != rows[:, :-1]) & (rows[:, 1:] >= 0)).sum(1)


def _meet(mine: np.ndarray, theirs: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Distinct (window, item) pairs that have a key in common."""
    found = []
    for c in range(mine.shape[1]):
        lo, hi = np.searchsorted(theirs[:, c], mine[:, c], "left"), np.searchsorted(theirs[:, c], mine[:, c], "right")
        n = hi - lo
        w = np.repeat(np.arange(len(mine)), n)
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        found.append(np.stack((w, order[at, c]), 1))
    return np.unique(np.concatenate(found), axis=0)


def _share(runs: np.ndarray, rare: np.ndarray) -> np.ndarray:
    """Distinct (row, item) pairs of rows of run numbers and items with one of those runs; ``rare``: (run, item), sorted."""
    lo, hi = np.searchsorted(rare[:, 0], runs.ravel(), "left"), np.searchsorted(rare[:, 0], runs.ravel(), "right")
    n = hi - lo
    at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    return np.unique(np.stack((np.repeat(np.arange(runs.size) // runs.shape[1], n), rare[at, 1]), 1), axis=0)


def _slices(benchmark: DataFrame, rows: int) -> Iterator[tuple[list, list]]:
    """Items in parts of about ``rows``; the driver holds one part at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset=["text"])
    n = max(1, -(-items.count() // rows))
    place = F.xxhash64(F.coalesce("item_id", F.xxhash64("text")))  # items without an id are spread by their texts
    for i in range(n):
        part = items.where(F.pmod(place, F.lit(n)) == i).toArrow()
        yield part.column(0).to_pylist(), part.column(1).to_pylist()


def _numbered(ids: list[int | None]) -> tuple[list[int], set[int]]:
    """The ids, those that are null replaced by numbers that no item has; and these numbers."""
    taken = set(ids)
    free = (i for i in count() if i not in taken)
    numbers = [next(free) if i is None else i for i in ids]
    return numbers, {n for n, i in zip(numbers, ids) if i is None}


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, item_rows: int = ITEM_ROWS) -> DataFrame:
    """doc_id, item_id, first_word, distance, similarity: the best window of each document that holds an item.

    An item is held if a passage of the document, longer or shorter than the item by as many words as edits are allowed,
    is within (1 - similarity) of the item's words in word edits. Items without words and null texts are never held, nor does
    a null or empty text hold any; items of equal texts are each reported, items without an id with a null one. Repeated
    documents are each searched.
    """
    spark = docs.sparkSession
    out = None
    for ids, texts in _slices(benchmark, item_rows):
        shared = spark.sparkContext.broadcast((ids, texts))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, unnamed = _numbered(shared.value[0])
            items = Items(ids, shared.value[1], similarity)
            for batch in batches:
                texts, doc_ids = as_text(batch.column(1)), batch.column(0).to_pylist()
                for lo, hi in chunks(texts):
                    rows = [(doc_ids[lo + t], None if i in unnamed else i, s, d, 1 - d / n) for t, i, s, d, n in items.find(texts[lo:hi])]
                    if rows:
                        columns = list(zip(*rows))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))],
                            names=["doc_id", "item_id", "first_word", "distance", "similarity"])

        got = doc_texts(docs).mapInArrow(run, "doc_id long, item_id long, first_word long, distance long, similarity double")
        out = got if out is None else out.union(got)
    return out


def _holds(shared: Broadcast, similarity: float):
    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        items = Items(_numbered(shared.value[0])[0], shared.value[1], similarity)
        for batch in batches:
            texts = as_text(batch)
            held = np.zeros(len(texts), bool)
            for lo, hi in chunks(texts):
                held[[lo + t for t, *_ in items.find(texts[lo:hi])]] = True
            yield pa.array(held)

    return holds


def clean(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY, item_rows: int = ITEM_ROWS) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns stay, no shuffle."""
    for ids, texts in _slices(benchmark, item_rows):
        shared = docs.sparkSession.sparkContext.broadcast((ids, texts))
        docs = docs.where(~_holds(shared, similarity)(F.col("text").cast("string")))
    return docs
