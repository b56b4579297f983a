"""Document fingerprints from improbable features.

Every window of 32 bytes has an entropy; the higher it is, the rarer such a window is in text, so windows are ranked
by it, and windows of next to no entropy (runs, padding) are never taken. A window that is the rarest of many
overlapping neighbourhoods is a selected feature. Features go, in text order, into a chain of Bloom filters of a
fixed fill. Two fingerprints are compared by the overlap of their filters' bits, normalised between what chance
gives and all bits of the smaller filter.

Counts of bytes in the rolling window are taken from the positions of equal bytes, in integers, so a window's rank
doesn't depend on what stands around it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import CHUNK_BYTES, doc_texts

WINDOW = 32
NEIGHBOURHOOD = 32
#: Neighbourhoods in which a window must be the rarest.
POPULAR = 8
#: Bits of a window's entropy below which it is no feature.
WEAK_BITS = 1.0
FILTER_BITS = 1024
FILTER_HASHES = 4
FILTER_FEATURES = 48
#: Share of the way from chance to full overlap that still counts as chance.
CUT = 0.1
#: Text in one range of document ids, about.
RANGE_BYTES = 8 << 20
#: Percentiles asked for at once, and partitions that the ranges are dealt to, at most.
MOST_CUTS = 2_048
MOST_PARTITIONS = 65_536

_SCALE = 1 << 12
_STEP = np.concatenate(([0], np.round(np.diff([c * np.log2(c) if c else 0.0 for c in range(WINDOW + 2)]) * _SCALE))).astype(np.int64)
_SUM = np.cumsum(_STEP)  # scaled c*log2(c) of a count c
_WEAK = int((np.log2(WINDOW) - WEAK_BITS) * WINDOW * _SCALE)
_NEVER = np.int64(1 << 62)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def window_ranks(data: np.ndarray) -> np.ndarray:
    """For each window of ``data`` the scaled sum of c*log2(c) over its byte counts: the smaller, the rarer."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int64)
    order = np.argsort(data, kind="stable")
    apart = order + data[order].astype(np.int64) * (n + WINDOW)
    after, before = np.ones(n, np.int16), np.ones(n, np.int16)
    live = np.arange(n - 1)
    for k in range(1, WINDOW):
        live = live[: np.searchsorted(live, n - k)]
        live = live[apart[live + k] - apart[live] < WINDOW]
        if not len(live):
            break
        after[live] += 1
        before[live + k] += 1
    ahead, behind = np.empty(n, np.int16), np.empty(n, np.int16)
    ahead[order], behind[order] = after, before
    ranks = np.empty(n - WINDOW + 1, np.int64)
    ranks[0] = _SUM[np.bincount(data[:WINDOW])].sum()
    np.cumsum(_STEP[behind[WINDOW:]] - _STEP[ahead[:n - WINDOW]], out=ranks[1:])
    ranks[1:] += ranks[0]
    return ranks


def _selected(ranks: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions of the selected windows; ``sizes`` are the texts' numbers of windows, in ``ranks`` one after another."""
    n = len(ranks)
    if not n:
        return np.zeros(0, np.int64)
    bits = max(1, int(n).bit_length())
    key = np.where(ranks >= _WEAK, _NEVER, ranks << bits | np.arange(n))
    stops = np.cumsum(sizes)
    starts = stops - sizes
    has = sizes > 0
    votes = np.zeros(n, np.int64)
    if n >= NEIGHBOURHOOD:
        least = key
        for k in range(NEIGHBOURHOOD.bit_length() - 1):
            least = np.minimum(least[:-(1 << k)], least[1 << k:])
        inside = np.repeat(stops[has], sizes[has])[:len(least)] - np.arange(len(least)) >= NEIGHBOURHOOD
        least = least[inside & (least < _NEVER)]
        votes = np.bincount(least & ((1 << bits) - 1), minlength=n)
    chosen = votes >= POPULAR
    # a text without one, for being short or even: its rarest window
    best = np.minimum.reduceat(key, starts[has])
    none = (np.add.reduceat(chosen, starts[has]) == 0) & (best < _NEVER)
    chosen[best[none] & ((1 << bits) - 1)] = True
    return np.flatnonzero(chosen)


def _digests(texts: list[bytes], ranks: list[np.ndarray]) -> list[np.ndarray]:
    """Each text's filters as rows of 16 unsigned 64-bit integers."""
    sizes = np.fromiter(map(len, ranks), np.int64, len(ranks))
    at = _selected(np.concatenate(ranks) if len(ranks) else np.zeros(0, np.int64), sizes)
    owner = np.searchsorted(np.cumsum(sizes), at, side="right")
    place = at - (np.cumsum(sizes) - sizes)[owner]
    data = np.frombuffer(b"".join(texts), np.uint8)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    first = (np.cumsum(length) - length)[owner] + place
    hashes = np.zeros(len(at), np.uint64)
    for i in range(0, len(at), 1 << 16):
        words = np.ascontiguousarray(data[first[i:i + (1 << 16), None] + np.arange(WINDOW)]).view(np.uint64)
        mixed = (words ^ (words >> np.uint64(29))) * _MIX
        hashes[i:i + (1 << 16)] = (mixed ^ (mixed >> np.uint64(32))).sum(1, dtype=np.uint64)
    bare = [i for i, (t, r) in enumerate(zip(texts, sizes.tolist())) if t and not r]  # shorter than a window: whole
    owner = np.concatenate((owner, np.array(bare, np.int64)))
    hashes = np.concatenate((hashes, np.array([xxhash.xxh64_intdigest(texts[i]) for i in bare], np.uint64)))
    hashes = (hashes ^ (hashes >> np.uint64(31))) * _MIX[0]
    hashes ^= hashes >> np.uint64(29)
    order = np.lexsort((np.arange(len(owner)), hashes, owner))
    again = np.zeros(len(owner), bool)
    again[order[1:]] = (owner[order[1:]] == owner[order[:-1]]) & (hashes[order[1:]] == hashes[order[:-1]])
    keep = np.flatnonzero(~again)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    owner, hashes = owner[keep], hashes[keep]
    count = np.bincount(owner, minlength=len(texts))
    number = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    filters = -(-count // FILTER_FEATURES)
    row = (np.cumsum(filters) - filters)[owner] + number // FILTER_FEATURES
    bits = np.zeros((int(filters.sum()), FILTER_BITS), np.uint8)
    for k in range(FILTER_HASHES):
        bits[row, ((hashes >> np.uint64(16 * k)) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    packed = np.packbits(bits, axis=1).view(np.uint64)
    return np.split(packed, np.cumsum(filters)[:-1])


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: the mean, over the filters of the shorter chain, of the best normalised overlap with the other's."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if a.shape == b.shape and np.array_equal(a, b):
        return 1.0
    if (len(b), int(np.bitwise_count(b).sum())) < (len(a), int(np.bitwise_count(a).sum())):
        a, b = b, a
    mine, theirs = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    best = np.zeros(len(a))
    for i in range(len(a)):
        shared = np.bitwise_count(b & a[i]).sum(1, dtype=np.int64)
        most = np.minimum(mine[i], theirs)
        chance = mine[i] * theirs / FILTER_BITS
        low = chance + CUT * (most - chance)
        best[i] = np.clip((shared - low) / np.maximum(most - low, 1e-9), 0, 1).max()
    return float(best.mean())


def encoded(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of ``following`` as there is."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def _compared(doc_ids: list, texts: list[str]) -> pa.RecordBatch:
    """Rows of all texts but the last, which only follows the one before it."""
    raw = [t.encode() for t in texts]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    joined = window_ranks(np.frombuffer(b"".join(raw), np.uint8))
    begin = np.cumsum(length) - length
    ranks = [joined[b:b + max(0, n - WINDOW + 1)] for b, n in zip(begin.tolist(), length.tolist())]
    own = _digests(raw, ranks)
    changed, heads, tails = [], [], []
    for i in range(len(texts) - 1):
        half = len(texts[i]) // 2
        head = texts[i][:len(texts[i]) - half].encode()
        tail = texts[i + 1][:half].encode()
        heads.append(len(head))
        tails.append(len(tail))
        changed.append(head + tail)
    # windows of an edited text are those of its two parts and the few across the seam
    seams = [t[max(0, h - WINDOW + 1):h + WINDOW - 1] for t, h in zip(changed, heads)]
    seam_ranks = window_ranks(np.frombuffer(b"".join(seams), np.uint8))
    at, their_ranks = 0, []
    for i, seam in enumerate(seams):
        across = seam_ranks[at:at + max(0, len(seam) - WINDOW + 1)]
        at += len(seam)
        their_ranks.append(np.concatenate((ranks[i][:max(0, heads[i] - WINDOW + 1)], across,
                                           ranks[i + 1][:max(0, tails[i] - WINDOW + 1)])))
    theirs = _digests(changed, their_ranks)
    n = len(changed)
    return pa.RecordBatch.from_arrays([
        pa.array(doc_ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in changed], pa.string()),
        pa.array([encoded(x) for x in own[:n]], pa.string()), pa.array([encoded(x) for x in theirs], pa.string()),
        pa.array([likeness(own[i], theirs[i]) for i in range(n)], pa.float64()),
        pa.array([likeness(own[i], own[i + 1]) for i in range(n)], pa.float64()),
    ], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def _range_starts(docs: DataFrame, range_bytes: int) -> np.ndarray:
    """The first place of each range of about ``range_bytes``, rising; the driver gets these numbers alone.

    Places are cut at percentiles, and beyond ``MOST_CUTS`` each piece again, so the plan doesn't grow with the texts.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-total // range_bytes))

    def cuts(k: int) -> Column:
        return F.percentile_approx("place", [i / k for i in range(1, k)], max(10_000, 4 * k))

    def part_of(bounds: np.ndarray) -> Column:
        @F.arrow_udf("int")
        def run(place: pa.Array) -> pa.Array:
            return pa.array(np.searchsorted(bounds, place.to_numpy(zero_copy_only=False), side="left").astype(np.int32))

        return run("place")

    bounds = np.zeros(0, np.int64)
    coarse = min(n, MOST_CUTS)
    if coarse > 1:
        bounds = np.unique(np.array(docs.agg(cuts(coarse)).first()[0] or [], np.int64))
    if n > coarse:
        finer = docs.groupBy(part_of(bounds).alias("part")).agg(cuts(-(-n // coarse)).alias("cuts")).select(F.explode("cuts").alias("cut"))
        bounds = np.unique(np.concatenate((bounds, finer.toArrow().column("cut").to_numpy())))
    # percentiles of large numbers are rounded; a range starts at a place that is there
    firsts = docs.groupBy(part_of(bounds).alias("part")).agg(F.min("place").alias("place"))
    return np.unique(firsts.toArrow().column("place").to_numpy())


def fingerprints(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per row its fingerprint, its edited text's, and its likeness to the edited text's and the next document's.

    Documents are dealt into ranges of ids of about equal text (an id's rows are together); the first row of each
    range is also given to the range before it, the very first to the last. That is one shuffle of the texts; the
    driver gets one id a range. A null text is empty, with an empty fingerprint, which is like another empty one
    (1) and like nothing else (0). Rows of one id follow each other in the order of their texts; null ids come
    first. A single row is followed by itself.
    """
    docs = doc_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"),
                                  F.coalesce("doc_id", F.lit(-(1 << 63))).alias("place"))
    starts = _range_starts(docs, range_bytes)
    if not len(starts):
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    last = len(starts) - 1

    @F.arrow_udf("array<struct<part:int,extra:boolean>>")
    def ranges_of(place: pa.Array) -> pa.Array:
        places = place.to_numpy(zero_copy_only=False)
        part = np.searchsorted(starts, places, side="right") - 1
        first = starts[part] == places
        where = np.concatenate(([0], np.cumsum(1 + first)))
        parts = np.repeat(part, 1 + first)
        extra = np.zeros(len(parts), bool)
        extra[where[1:][first] - 1] = True
        parts[extra] = np.where(parts[extra] > 0, parts[extra] - 1, last)
        pairs = pa.StructArray.from_arrays([pa.array(parts.astype(np.int32)), pa.array(extra)], names=["part", "extra"])
        return pa.ListArray.from_arrays(pa.array(where.astype(np.int32)), pairs)

    rows = docs.withColumn("at", F.explode(ranges_of("place"))).select("at.part", "at.extra", "doc_id", "place", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, texts, size = None, [], [], 0
        for batch in batches:
            for p, extra_row, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if p != part:
                    part, ids, texts, size = p, [], [], 0
                if extra_row:
                    if texts:  # the range's last row; further rows of the same id are none's neighbours
                        yield _compared(ids, [*texts, text])
                        ids, texts = [], []
                    continue
                ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size > CHUNK_BYTES and len(texts) > 1:
                    yield _compared(ids, texts)
                    ids, texts, size = ids[-1:], texts[-1:], len(text)

    placed = rows.repartition(min(last + 1, MOST_PARTITIONS), "part").sortWithinPartitions("part", "extra", "place", "text")
    return placed.select("part", "extra", "doc_id", "text").mapInArrow(run, _SCHEMA)
