"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

A solution is a set of bins. Crossover takes whole well-filled bins of one parent, drops the other parent's bins
that hold a document taken twice, and puts the displaced documents back by best fit, the longest first. Pieces are
dealt into shards of a bounded number; each shard is evolved by several islands, which pass their best solution to
the next island between epochs. Bins that a shard could not fill well are opened again and packed with those of
other shards, so that what is left over doesn't add up over shards.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.llm.common import as_text, chunks, doc_texts
from tenantlake.llm.tokens import WORD_BPE, Vocabulary, public_path
from tenantlake.session import stage

CAPACITY = 2048
#: Pieces in a shard, about; a shard is one group on one task.
SHARD = 8192
ISLANDS = 2
POPULATION = 4
GENERATIONS = 3
EPOCHS = 2
#: Bins with at least this share filled stay as they are; the others are packed again across shards.
WELL_FILLED = 0.985


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Each row's ids followed by one 0, cut into pieces: doc_id, piece, start, length, ids_crc32, deal (a number)."""
    path = tokenizer or public_path(WORD_BPE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.at(path)
        count = 0
        for batch in batches:
            texts, doc_ids = as_text(batch.column(1)), batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                rows = []
                for doc_id, ids in zip(doc_ids[lo:hi], vocabulary.ids(texts[lo:hi])):
                    ids += b"\0\0\0\0"
                    count += 1
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at:at + 4 * capacity]
                        rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), count))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[i], t) for i, t in enumerate(
                        [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return doc_texts(docs).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, deal long")


class _Bins:
    """Bins being filled: room by (room, bin), so that the best fit is the first with room enough."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[int]] = []
        self.rooms: list[tuple[int, int]] = []

    def put(self, item: int, length: int) -> None:
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, b = self.rooms.pop(at)
        else:
            room, b = self.capacity, len(self.items)
            self.items.append([])
        self.items[b].append(item)
        if room > length:
            insort(self.rooms, (room - length, b))

    def add_bin(self, items: list[int], room: int) -> None:
        self.items.append(items)
        if room:
            insort(self.rooms, (room, len(self.items) - 1))


def best_fit(lengths: list[int], order: list[int], capacity: int) -> list[list[int]]:
    bins = _Bins(capacity)
    for i in order:
        bins.put(i, lengths[i])
    return bins.items


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, chance: random.Random) -> list[list[int]]:
    """A child of two packings: full and randomly chosen well-filled bins of ``a``, the untouched bins of ``b``."""
    fills = [sum(lengths[i] for i in x) for x in a]
    taken = [x for x, f in zip(a, fills) if f == capacity or (f >= WELL_FILLED * capacity and chance.random() < 0.5)]
    used = {i for x in taken for i in x}
    bins = _Bins(capacity)
    for x in taken:
        bins.add_bin(list(x), capacity - sum(lengths[i] for i in x))
    displaced = []
    for x in b:
        if used.isdisjoint(x):
            room = capacity - sum(lengths[i] for i in x)
            if room < (1 - WELL_FILLED) * capacity or chance.random() < 0.9:
                bins.add_bin(list(x), room)
            else:  # mutation: a badly filled bin is emptied now and then
                displaced.extend(x)
        else:
            displaced.extend(i for i in x if i not in used)
    for i in sorted(displaced, key=lambda i: -lengths[i]):
        bins.put(i, lengths[i])
    return bins.items


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((sum(lengths[i] for i in x) / capacity) ** 2 for x in bins)


def evolve(lengths: list[int], capacity: int, seed: int, guests: list[list[list[int]]] = (), population: int = POPULATION,
           generations: int = GENERATIONS) -> list[list[int]]:
    """The best packing found; stops as soon as it has no more bins than the total length needs."""
    chance = random.Random(seed)
    least = -(-sum(lengths) // capacity)
    down = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    group = [*guests, best_fit(lengths, down, capacity)]
    while min(map(len, group)) > least and len(group) < population:
        order = sorted(down, key=lambda i: -lengths[i] * (1 + 0.1 * chance.random()))
        group.append(best_fit(lengths, order, capacity))
    for _ in range(generations):
        group.sort(key=lambda x: fitness(x, lengths, capacity), reverse=True)
        if len(group[0]) <= least:
            break
        children = [crossover(*chance.sample(group, 2), lengths, capacity, chance) for _ in range(len(group))]
        group = sorted([*group, *children], key=lambda x: fitness(x, lengths, capacity), reverse=True)[:population]
    return max(group, key=lambda x: fitness(x, lengths, capacity))


def _assignment(bins: list[list[int]], n: int) -> np.ndarray:
    out = np.zeros(n, np.int32)
    for b, items in enumerate(bins):
        out[items] = b
    return out


def _bins_of(assignment: np.ndarray) -> list[list[int]]:
    order = np.argsort(assignment, kind="stable")
    cuts = np.flatnonzero(np.diff(assignment[order])) + 1
    return [x.tolist() for x in np.split(order, cuts)]


_NULL_ID = -(1 << 63)
_KEYS = ["length", "doc_id", "piece", "start", "deal", "ids_crc32"]


def _pack_round(pieces: DataFrame, total: int, capacity: int, shard_size: int, islands: int, epochs: int, tag: int) -> DataFrame:
    """One packing of the pieces: their columns with ``sequence_id``."""
    n = max(1, -(-total // shard_size))
    dealt = stage(pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "deal", F.lit(tag)), F.lit(n))), "shards")
    lengths = dealt.select("shard", *_KEYS, F.explode(F.array(*map(F.lit, range(islands)))).alias("island"))
    schema = "shard long, island int, bins long, fill double, packing binary"

    def epoch(key, items: pd.DataFrame, guests: pd.DataFrame | None, step: int) -> pd.DataFrame:
        items = items.sort_values(_KEYS, ascending=False)
        sizes = items["length"].tolist()
        if not sizes:
            return pd.DataFrame({"shard": [], "island": [], "bins": [], "fill": [], "packing": []})
        known = [] if guests is None else [_bins_of(np.frombuffer(x, np.int32)) for x in guests["packing"]]
        best = evolve(sizes, capacity, hash((*map(int, key), step)) & 0xFFFF, known)
        bins, fill = fitness(best, sizes, capacity)
        return pd.DataFrame({"shard": [key[0]], "island": [key[1]], "bins": [-bins], "fill": [fill],
                             "packing": [_assignment(best, len(sizes)).tobytes()]})

    def first(key, items: pd.DataFrame) -> pd.DataFrame:
        return epoch(key, items, None, 0)

    def later(step: int):
        def run(key, items: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
            return epoch(key, items, guests, step)
        return run

    elite = stage(lengths.groupBy("shard", "island").applyInPandas(first, schema), "elite")
    for step in range(1, epochs):  # each island keeps its own best and gets its neighbour's
        moved = elite.union(elite.withColumn("island", ((F.col("island") + 1) % islands).cast("int")))
        elite = stage(lengths.groupBy("shard", "island").cogroup(moved.groupBy("shard", "island"))
                      .applyInPandas(later(step), schema), "elite")
    best = elite.groupBy("shard").agg(F.max_by("packing", F.struct(-F.col("bins"), F.col("fill"), -F.col("island"))).alias("packing"))
    columns = pieces.columns

    def place(key, items: pd.DataFrame, packing: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(_KEYS, ascending=False)
        if not len(items):
            return items[columns].assign(sequence_id=[])
        number = np.frombuffer(packing["packing"].iloc[0], np.int32).astype(np.int64)
        return items[columns].assign(sequence_id=(np.int64(tag) << 56) | (np.int64(key[0]) << 20) | number)

    placed = dealt.groupBy("shard").cogroup(best.groupBy("shard")).applyInPandas(
        place, pieces.select("*", F.lit(0).cast("long").alias("sequence_id")).schema)
    return stage(placed, "placed")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, shard_size: int = SHARD,
         islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row.

    A null or empty text is the single id 0. Pieces of equal length are ordered by their keys, so a retried task
    packs as before; repeated rows are packed as often as they occur; an empty table gives no pieces. Offsets
    follow length, then the keys, within a sequence, which never holds more than ``capacity`` pieces.
    """
    # pandas would make a column of ids with a null into floats
    pieces = stage(token_pieces(docs, capacity, tokenizer).withColumn("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID))), "pieces")
    first = _pack_round(pieces, pieces.count(), capacity, shard_size, islands, epochs, 0)
    fill = first.groupBy("sequence_id").agg(F.sum("length").alias("filled")).where(F.col("filled") < WELL_FILLED * capacity)
    open_ids = stage(fill.select("sequence_id"), "open")
    again = stage(first.join(open_ids, "sequence_id", "left_semi").drop("sequence_id"), "again")
    second = _pack_round(again, again.count(), capacity, shard_size, islands, epochs, 1)
    placed = first.join(open_ids, "sequence_id", "left_anti").select(*second.columns).union(second)

    order = Window.partitionBy("sequence_id").orderBy(*[F.col(k).desc() for k in _KEYS])
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(F.nullif("doc_id", F.lit(_NULL_ID)).alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id",
                         F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
