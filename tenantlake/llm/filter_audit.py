"""Which filter removes what: an audit of five document filters in all their orders, from a sparse document-term matrix.

Tasks turn chunks of texts into shards of compressed sparse rows (CSR): one row per document, one column per word of
the shard. The shards' words, one row per shard and word, are sorted together and numbered as one dictionary without
gaps, which names every shard's columns. Row sums (words) and nonzero counts (different words) of the
matrix decide the filters A and B, the other flags come with the shards. Counts per part and
set of failed filters are all that the 120 orders need.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.llm.common import as_bytes, chunks
from tenantlake.session import stage

FILTERS = "ABCDE"
LEAST_WORDS = 100
#: B fails under this percentage of distinct words, C over this percentage of capitals.
DISTINCT_PERCENT = 80
CAPITAL_PERCENT = 10
SYMBOLS = b"#$%&*|"
#: Bytes of text of a shard; a longer text is cut into several.
SHARD_BYTES = 16 << 20

_UPPER, _POINT, _SYMBOL = (np.array([f(b) for b in range(256)]) for f in (
    lambda b: 65 <= b <= 90, lambda b: b & 0xC0 != 0x80, lambda b: b in SYMBOLS))

_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_DOC = pa.struct([("doc_id", pa.int64()), ("part", pa.string()), ("c", pa.bool_()), ("d", pa.bool_()), ("digest", pa.binary()),
                  ("row", pa.int64()), ("pieces", pa.int32())])
_SHARD = ("shard long, docs array<struct<doc_id:long,part:string,c:boolean,d:boolean,digest:binary,row:long,pieces:int>>, "
          "starts array<int>, columns array<int>, counts array<int>, words array<string>")


def _characters(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Flags C and D of each text."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    some = np.flatnonzero(size)
    upper, points, symbols = (np.zeros(len(texts), np.int64) for _ in range(3))
    if len(some):
        data = np.frombuffer(b"".join(texts), np.uint8)
        starts = (np.cumsum(size) - size)[some]
        for total, table in ((upper, _UPPER), (points, _POINT), (symbols, _SYMBOL)):
            total[some] = np.add.reduceat(table[data], starts, dtype=np.int64)
    return 100 * upper > CAPITAL_PERCENT * points, symbols > 0


def _pieces(text: bytes, limit: int) -> list[bytes]:
    """A text cut at white space behind every ``limit`` bytes."""
    out, at = [], 0
    while len(text) - at > limit and (gap := _SPACE.search(text, at + limit)):
        out.append(text[at:gap.start()])
        at = gap.end()
    return [*out, text[at:]]


def _shard(number: int, docs: list[pa.Array], texts: list[bytes]) -> pa.RecordBatch:
    words: dict[bytes, int] = {}
    starts, columns, counts = [0], [], []
    for text in texts:
        bag = Counter(text.split())  # bytes split at ASCII white space only
        columns.extend(words.setdefault(w, len(words)) for w in bag)
        counts.extend(bag.values())
        starts.append(len(columns))
    one = [pa.array([number], pa.int64()),
           pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.StructArray.from_arrays(docs, fields=list(_DOC)))]
    for values in (starts, columns, counts):
        one.append(pa.array([np.array(values, np.int32)], pa.list_(pa.int32())))
    one.append(pa.array([[w.decode("utf-8") for w in words]], pa.list_(pa.string())))
    return pa.RecordBatch.from_arrays(one, names=["shard", "docs", "starts", "columns", "counts", "words"])


def shards(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per shard, with columns numbered within the shard; its number is unique in one evaluation only.

    A text longer than ``limit`` is several rows, cut at white space, each a shard of its own; ``row`` is the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 12
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for lo, hi in chunks(texts, limit):
                some = texts[lo:hi]
                c, d = _characters(some)
                facts = [batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo), pa.array(c), pa.array(d),
                         pa.array([hashlib.sha256(t).digest() for t in some], pa.binary())]
                parts = _pieces(some[0], limit) if hi == lo + 1 else [b""]
                row = pa.array((number << 28) + np.arange(hi - lo))
                facts += [row, pa.array(np.full(hi - lo, len(parts), np.int32))]
                for piece in [some] if len(parts) == 1 else [[x] for x in parts]:
                    yield _shard(number, facts, piece)
                    number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, _SHARD)


def _numbered(uses: DataFrame) -> DataFrame:
    """(word, place, id) for (word, place): one number per different word, from 0 without gaps; ``word`` once for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(0)
            new = np.ones(len(words), bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            new[0] = words[0].as_py() != last
            number = n + np.cumsum(new)
            last, n = words[-1].as_py(), int(number[-1])
            yield pa.RecordBatch.from_arrays(
                [pc.if_else(pa.array(new), words, pa.scalar(None, words.type)), batch.column(1), pa.array(number),
                 pa.array(np.full(len(words), TaskContext.get().partitionId(), np.int32))], names=["word", "place", "n", "slice"])

    told = stage(uses.repartition("word").sortWithinPartitions("word").select("word", "place").mapInArrow(
        run, "word string, place long, n long, slice int"), "dictionary")
    # one row per task that wrote words
    sizes = told.groupBy("slice").agg((F.max("n") + 1).alias("size"))
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("slice", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("first"))
    return told.join(first, "slice").select("word", "place", (F.col("first") + F.col("n")).alias("id"))


def document_terms(docs: DataFrame, limit: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """The CSR shards of all documents, and their dictionary: (word, place, id).

    A place is a shard's number and a column's in it; every place has the id of its word, and each word stands once.
    """
    local = stage(shards(docs, limit), "shards")
    # one long for a place: a shard has fewer than 2 ** 28 words
    return local, _numbered(local.select("shard", F.posexplode("words").alias("at", "word")).select(
        "word", (F.shiftleft("shard", 28) + F.col("at")).alias("place")))


def matrix(local: DataFrame, known: DataFrame) -> DataFrame:
    """The shards with their columns named by the dictionary: shard, docs, starts, columns, counts."""
    ids = known.groupBy(F.shiftright("place", 28).alias("shard")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("ids"))
    return local.drop("words").join(ids, "shard", "left").select(
        "shard", "docs", "starts", F.transform("columns", lambda i: F.get("ids", i)).alias("columns"), "counts")


def row_totals(local: DataFrame, known: DataFrame) -> DataFrame:
    """One row per document: doc_id, part, c, d, digest, n_words (the row's sum), n_distinct (its nonzero counts).

    Rows of one long text are added up; their columns meet in the dictionary, where a word has one id in all of them.
    """
    def row(doc: Column, i: Column) -> Column:
        start, end = F.get("starts", i), F.get("starts", i + 1)
        total = F.aggregate(F.slice("counts", start + 1, end - start), F.lit(0).cast("long"), lambda a, x: a + x)
        return F.struct(doc.alias("doc"), total.alias("n_words"), (end - start).cast("long").alias("n_distinct"))

    facts = ("doc_id", "part", "c", "d", "digest")
    rows = local.select(F.inline(F.transform("docs", row))).select("doc.*", "n_words", "n_distinct")
    whole = rows.where("pieces = 1").select(*facts, "n_words", "n_distinct")
    long = local.where(F.get("docs", F.lit(0))["pieces"] > 1)
    if long.isEmpty():
        return whole
    sums = rows.where("pieces > 1").groupBy("row").agg(*[F.first(c).alias(c) for c in facts], F.sum("n_words").alias("n_words"))
    used = long.select(F.col("docs")[0]["row"].alias("row"), "shard", F.explode("columns").alias("at"))
    used = used.select("row", (F.shiftleft("shard", 28) + F.col("at")).alias("place")).join(known, "place")
    return whole.unionByName(sums.join(used.groupBy("row").agg(F.count_distinct("id").alias("n_distinct")), "row").drop("row"))


def failures(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, part, n_words, n_distinct and booleans A to E, true where a filter fails.

    A: under 100 words; B: distinct words under 80 % of words; C: capitals A-Z over 10 % of code points; D: any of
    ``#$%&*|``; E: equal to the text of a row with a smaller doc_id (by SHA-256). A null text is empty and fails A, and
    E beside another empty text; a null lang is the empty one. Rows repeated with one doc_id don't fail E by each
    other. A row without an id neither fails E nor makes others fail it.
    """
    rows = stage(row_totals(*document_terms(docs, limit)), "totals")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"))
    return rows.join(first, "digest").select(
        "doc_id", "part", "n_words", "n_distinct", (F.col("n_words") < LEAST_WORDS).alias("A"),
        (100 * F.col("n_distinct") < DISTINCT_PERCENT * F.col("n_words")).alias("B"), F.col("c").alias("C"),
        F.col("d").alias("D"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("E"))


def _steps() -> Column:
    """All 120 orders with five steps each: the order, the step's number, its filter's bit and the bits before it."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return F.array(*[
        F.struct(F.lit("".join(order)).alias("filter_order"), F.lit(k + 1).alias("step"), F.lit(bit[f]).alias("own"),
                 F.lit(sum(bit[g] for g in order[:k])).alias("before"))
        for order in permutations(FILTERS) for k, f in enumerate(order)])


def audit(failed: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, zeros included.

    ``failed``: doc_id, part, A to E. ``labels``: doc_id, quality, toxic; several rows of one id count as good or
    toxic if any does, those without an id and unlabelled documents as neither. No documents, no rows.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    bits = F.lit(0)
    for i, f in enumerate(FILTERS):
        bits = bits + F.when(F.col(f), 1 << i).otherwise(0)
    flagged = failed.select("doc_id", "part", bits.alias("failed")).join(known, "doc_id", "left")
    classes = flagged.groupBy("part", "failed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    # at most 32 rows a part meet the 600 steps
    each = classes.select("*", F.inline(_steps()))
    own, earlier = F.col("failed").bitwiseAND(F.col("own")) != 0, F.col("failed").bitwiseAND(F.col("before")) != 0

    def counted(when: Column, what: str = "n") -> Column:
        return F.sum(F.when(when, F.col(what)).otherwise(0)).cast("long")

    # a document is removed by each of the filters that it fails in an equal share of the orders
    share = F.element_at(F.array(*[F.lit(120 // k) for k in range(1, 6)]), F.greatest(F.bit_count("failed"), F.lit(1)))
    removed = own & ~earlier
    return each.groupBy("part", "filter_order", "step").agg(
        counted(~own & ~earlier).alias("kept"), counted(removed).alias("removed"), counted(own & earlier).alias("redundant"),
        counted(F.col("failed") == F.col("own")).alias("unique_fails"), counted(removed, "good").alias("good_lost"),
        counted(removed, "toxic").alias("toxic_lost"),
        F.sum(F.when(own, F.col("n") * share).otherwise(0)).cast("long").alias("shapley"))
