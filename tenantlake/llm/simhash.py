"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints within an even radius 2r share a variant at distance r from both. The radius here is 3, which is odd:
each fingerprint is also seen with one of four 16-bit blocks masked out, so that a block can be chosen which takes
up at least one of the differing bits and leaves two at most. Every fingerprint therefore emits, for each masked
block, the 48 remaining bits and all 48 variants at distance one: 196 keys. Keys are shuffled; the fingerprints
that meet under a key are verified on all 64 bits. A chain of verified links is kept for each group that meets,
never all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import as_bytes, chunks, doc_texts, unused_name
from tenantlake.llm.components import components
from tenantlake.session import stage

RADIUS = 3
BLOCKS = 4
SEED = 42
WORDS = 3
#: Groups up to this size are compared directly; larger ones by looking up neighbouring values of the masked block.
DIRECT = 512


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """64-bit fingerprint of one text; 0 without words."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    n = max(1, len(tokens) - words + 1)
    starts = [0, *(ends[:n - 1] + 1).tolist()]
    stops = ends[min(words, len(tokens)) - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(joined[s:e], seed) for s, e in zip(starts, stops)], np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in chunks(texts):
                fps = np.array([simhash(t) for t in texts[lo:hi]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fps)], names=["doc_id", "fp"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(block, key, fp): for each masked block the remaining bits and their variants at distance one."""
    width = 64 // BLOCKS
    keys = []
    for block in range(BLOCKS):
        mask = ~(((1 << width) - 1) << (block * width)) & 0xFFFFFFFFFFFFFFFF
        flips = [0, *(1 << b for b in range(64) if mask >> b & 1)]
        signed = [x - (1 << 64) if x >> 63 else x for x in flips]
        # the masked block's place holds the block number, so one long is the whole key
        tag = block << (block * width)
        tag = tag - (1 << 64) if tag >> 63 else tag
        keep = F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).bitwiseOR(F.lit(tag))
        keys.extend(keep.bitwiseXOR(F.lit(x)) for x in signed)
    return fps.select("fp", F.posexplode(F.array(*keys)).alias("pos", "key")).select(
        (F.col("pos") / (1 + 64 - width)).cast("int").alias("block"), "key", "fp")


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _roots(n: int) -> tuple[list[int], callable]:
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    return parent, find


_WITHIN = {r: np.array([x for x in range(1 << 16) if x.bit_count() <= r], np.uint64) for r in (1, 2, 3)}


def group_links(fps: np.ndarray, key: int, block: int) -> list[tuple[int, int]]:
    """Links (positions in ``fps``, distinct fingerprints that share a key) that connect all within the radius.

    All members have at most one bit beside the masked block that differs from the key. Small groups are compared
    pairwise. In a large one the members with the same masked 16 bits and one flipped bit are within two of each
    other, so they are chained; what is left are at most 2 x 65,536 values, whose neighbours are looked up.
    """
    n = len(fps)
    parent, find = _roots(n)
    out: list[tuple[int, int]] = []

    def unite(i: int, j: int) -> None:
        a, b = find(i), find(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((i, j))

    if n <= DIRECT:
        for i in range(n - 1):
            for j in np.flatnonzero(_popcount(fps[i + 1:] ^ fps[i]) <= RADIUS).tolist():
                unite(i, i + 1 + j)
        return out
    width = 64 // BLOCKS
    low = np.uint64((1 << width) - 1)
    shift = np.uint64(block * width)
    inside = (fps >> shift) & low
    outside = fps & ~(low << shift)
    plain = np.uint64(key) & ~(low << shift)
    flipped = outside != plain
    first: dict[tuple[bool, int], int] = {}
    for i, (f, v) in enumerate(zip(flipped.tolist(), inside.tolist())):
        j = first.setdefault((f, v), i)
        if j != i:
            unite(j, i)
    for f, g, r in ((True, True, 1), (True, False, 2), (False, False, 3)):
        for (kind, v), i in list(first.items()):
            if kind == f:
                for w in (np.uint64(v) ^ _WITHIN[r]).tolist():
                    j = first.get((g, w))
                    if j is not None and j != i:
                        unite(i, j)
    return out


def _meetings(variants: DataFrame) -> DataFrame:
    """Verified links (a, b) between fingerprints that meet under a key; one task holds one key's group at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, int] = {}

        def find(i: int) -> int:
            while (p := known.setdefault(i, i)) != i:
                known[i] = known[p]
                i = p
            return i

        def links(block: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch | None:
            change = np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1
            start = np.concatenate(([0], change))
            size = np.diff(np.concatenate((start, [len(key)])))
            found: list[tuple[int, int]] = []
            pairs = start[size == 2]
            near = pairs[_popcount(fp[pairs] ^ fp[pairs + 1]) <= RADIUS]
            found.extend(zip(fp[near].tolist(), fp[near + 1].tolist()))
            for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist()):
                group = fp[s:s + n]
                found.extend((int(group[i]), int(group[j])) for i, j in group_links(group, int(key[s]), int(block[s])))
            new = []
            for a, b in found:
                x, y = find(a), find(b)
                if x != y:
                    known[max(x, y)] = min(x, y)
                    new.append((a, b))
            if not new:
                return None
            return pa.RecordBatch.from_arrays(
                [pa.array(np.array([p[k] for p in new], np.uint64).view(np.int64)) for k in (0, 1)], names=["a", "b"])

        held = None
        for batch in batches:
            now = [batch.column(0).to_numpy(zero_copy_only=False)] + [
                batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in (1, 2)]
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            block, key, _ = now
            if not len(key):
                continue
            other = np.flatnonzero((key != key[-1]) | (block != block[-1]))
            cut = int(other[-1]) + 1 if len(other) else 0  # the last key's group may go on in the next batch
            if cut and (got := links(*[x[:cut] for x in now])) is not None:
                yield got
            held = [x[cut:] for x in now]
        if held is not None and len(held[0]) and (got := links(*held)) is not None:
            yield got

    dealt = variants.repartition("key").sortWithinPartitions("key", "block")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits), ``component_id`` (the smallest doc_id reachable) of every row.

    Words are split at ASCII white space after lower-casing A-Z; shingles are of three words, repeats included.
    A null, empty or blank text has the zero fingerprint and is linked like any other. Rows of equal fingerprints
    are one node, so a group of copies of any size costs one fingerprint. Repeated rows stay; a null doc_id takes
    part in its group but is never the id of a group that has another (a group of nulls only has a null id).
    """
    prints = stage(_fingerprints(docs), "fingerprints")
    nodes = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    links = _meetings(_variants(nodes.select("fp")))
    roots = components(links)
    joined = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    joined = stage(joined, "classes")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "component").select("fp", "component_id")
    return prints.join(classes, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest doc_id, without an id only if none has one.

    Of rows repeated with that id one stays. Rows are told apart by a number of their own, given once.
    """
    row = unused_name(docs, "row_number")
    rows = stage(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    ids = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    found = stage(found.join(ids, "row").select("row", "component_id", F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("place")), "groups")
    stays = found.groupBy("component_id").agg(F.min("place").alias("stays"))
    gone = found.join(stays, "component_id").where(F.col("row") != F.col("stays.row")).select(F.col("row").alias("gone"))
    return rows.join(gone, rows[row] == gone["gone"], "left_anti").drop(row)
