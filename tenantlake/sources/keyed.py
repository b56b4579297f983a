"""Silver that is merged by key over several loads.

A load may bring a key that an earlier one has brought, on another day. Which files can hold it is told by a Bloom filter
per file, so a merge reads and rewrites those files only; all others stay as they are, under their names:

    {root}/data/load=N/...      files that load N wrote, in folders by ``levels``
    {root}/bloom/load=N/...     their filters: (levels, file, size, word, bits)
    {root}/files/version=V/     the files that make up the table, one version a load

A filter is an array of 64-bit words, sparse, with four bits of a key in one word; its size follows the file's rows. A
load is there when its list of files is committed: readers see all of it or none, and a load that failed is written over.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.operators.cleanse import deduplicate, orderable
from tenantlake.session import stage
from tenantlake.sources.tables import VersionedTable

#: Words of a filter are a power of two between these, a word for every four keys or more.
LEAST_SIZE, MOST_SIZE = 6, 24
#: One key in so many is asked of every file's filter; the others are asked of the files that none of these hits.
FEW = 64
_BITS = 4


class Merged(NamedTuple):
    load: int
    files_before: int
    rewritten: int
    written: int


def _hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*[F.col(f"`{k}`").cast("string") for k in keys], F.lit("silver"))


def _mask(h: Column) -> Column:
    """A few of the 64 bits, taken from the hash's upper half."""
    mask = F.lit(0).cast("long")
    for i in range(_BITS):
        bit = F.shiftrightunsigned(h, 64 - 6 * (i + 1)).bitwiseAND(63).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def _word(h: Column, size: Column) -> Column:
    return h.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), size) - 1)


class KeyedTable:
    """``keys`` identify a row; of several the last in ``order_by`` stays, ties broken by all columns.

    ``scope`` names level columns that belong to the key (a tenant's keys say nothing of another's): filters are asked
    within them only, and null keys equal each other. One writer at a time; a second one's commit fails.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], order_by: Sequence[str],
                 levels: Sequence[str] = (), scope: Sequence[str] = ()):
        self.spark, self.root = spark, root.rstrip("/")
        self.keys, self.order_by, self.levels, self.scope = list(keys), list(order_by), list(levels), list(scope)
        if not set(self.scope) <= set(self.levels):
            raise ValueError("scope must be some of the levels")
        self.files = VersionedTable(spark, f"{self.root}/files")

    def live(self) -> DataFrame:
        """(file, load): the files of the table."""
        return self.files.read("file string, load int")

    def _rows_of(self, files: list[str]) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/data").parquet(*files)

    def read(self) -> DataFrame:
        """All rows, one a key, levels as text."""
        files = [r.file for r in self.live().select("file").collect()]
        if not files:
            raise ValueError(f"table {self.root} is empty")
        return self._rows_of(files).drop("load")

    def _filters(self, load: int, wrote: DataFrame) -> None:
        """Filters of the files that a load wrote; ``wrote`` (file, number, rows) is staged, a row a file."""
        rows = self.spark.read.option("basePath", f"{self.root}/data").parquet(f"{self.root}/data/load={load}")
        sizes = wrote.select("file", "number", F.greatest(F.lit(LEAST_SIZE), F.least(
            F.lit(MOST_SIZE), F.ceil(F.log2(F.col("rows") / 4.0)).cast("int"))).alias("size"), *self.scope)
        hashed = rows.select(F.input_file_name().alias("file"), _hash([*self.keys, *self.scope]).alias("h"))
        # a file is read by few tasks, which send its words under a number; its name and scope come back afterwards
        words = hashed.join(sizes.drop(*self.scope), "file").groupBy("number", _word(F.col("h"), F.col("size")).alias("word")).agg(
            F.bit_or(_mask(F.col("h"))).alias("bits"))
        words.join(sizes, "number").select(*self.scope, "file", "size", "word", "bits").write.mode("overwrite").parquet(
            f"{self.root}/bloom/load={load}")

    def candidates(self, rows: DataFrame) -> DataFrame:
        """(file): live files whose filters say that they can hold a key of ``rows``.

        A few of the keys are asked first, and the files that these hit are not asked again: a load that brings keys of
        every file would otherwise try all its keys on all of them. A file that none of the few hits is asked for every key.
        """
        known = self.spark.read.parquet(f"{self.root}/bloom").join(self.live().select("file"), "file", "left_semi")
        sizes = [r[0] for r in known.select("size").distinct().collect()]  # at most as many as there are sizes
        asked = rows.select(*[F.col(f"`{s}`").cast("string").alias(f"_{s}") for s in self.scope],
                            _hash([*self.keys, *self.scope]).alias("h")).distinct()
        few = stage(self._hit(known, asked.where(F.pmod(F.xxhash64("h"), F.lit(FEW)) == 0), sizes), "hit")
        return few.unionByName(self._hit(known.join(few, "file", "left_anti"), asked, sizes))

    def _hit(self, known: DataFrame, asked: DataFrame, sizes: Sequence[int]) -> DataFrame:
        asked = asked.select("*", F.explode(F.array(*map(F.lit, sizes)).cast("array<int>")).alias("_size")).select(
            "*", _word(F.col("h"), F.col("_size")).alias("_word"), _mask(F.col("h")).alias("mask"))
        same = (known["size"] == asked["_size"]) & (known["word"] == asked["_word"])
        for s in self.scope:
            same = same & known[s].eqNullSafe(asked[f"_{s}"])
        return known.join(asked, same & (known["bits"].bitwiseAND(asked["mask"]) == asked["mask"]), "left_semi").select("file").distinct()

    def _last(self, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
        """One row a key of two tables that have each key once, the last in ``order_by`` and then by the other columns."""
        rest = [c for c in new.columns if c not in keys]
        types = dict(new.dtypes)

        def side(df: DataFrame, name: str) -> DataFrame:
            return df.select(_hash(keys).alias(f"_{name}_key"), *[F.col(f"`{k}`").alias(f"_{name}_{i}") for i, k in enumerate(keys)],
                             F.struct(F.lit(True).alias("_there"), *[F.col(f"`{c}`") for c in rest]).alias(f"_{name}"))

        def rank(name: str) -> Column:
            columns = [c for c in self.order_by if c in rest] + [c for c in rest if c not in self.order_by]
            return F.struct(F.lit(True), *[orderable(F.col(f"_{name}")[c], types[c]) for c in columns])

        same = F.col("_old_key") == F.col("_new_key")
        for i in range(len(keys)):
            same = same & F.col(f"_old_{i}").eqNullSafe(F.col(f"_new_{i}"))
        both = side(old, "old").join(side(new, "new"), same, "full")
        stays = F.col("_new").isNull() | F.col("_old").isNotNull() & (rank("old") > rank("new"))
        return both.withColumn("_stays", stays).select(*[
            F.when(F.col("_stays"), F.col(f"_old_{keys.index(c)}") if c in keys else F.col("_old")[c]).otherwise(
                F.col(f"_new_{keys.index(c)}") if c in keys else F.col("_new")[c]).alias(c) for c in new.columns])

    def merge(self, rows: DataFrame) -> Merged:
        """Take a load in: a key that is there already is one row afterwards, the last of the two."""
        version = self.files.current_version()
        load = version + 1
        keys = self.keys + [s for s in self.scope if s not in self.keys]
        before = self.live().count() if version else 0
        # led by a hash: keys that begin alike are slow to sort
        new = deduplicate(rows.withColumn("_key", _hash(keys)), ["_key", *keys], self.order_by).drop("_key")
        if before:  # read for the filters and for the merge
            new = stage(new, "merge")
        hit = [r.file for r in self.candidates(new).collect()] if version and before else []
        out = new
        if hit:
            old = self._rows_of(hit).drop("load")
            same = old.select(*[F.col(f"`{c}`").cast(new.schema[c].dataType).alias(c) for c in new.columns])
            # a key is one row in the files and one in the load, so they are joined; all are not ranked anew
            out = self._last(same, new, keys)
        path = f"{self.root}/data/load={load}"
        writer = out.hint("rebalance", *[F.col(c) for c in self.levels]) if self.levels else out
        writer.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*self.levels).parquet(path)
        written = self.spark.read.option("basePath", f"{self.root}/data").parquet(path).select(*self.scope, F.input_file_name().alias("file"))
        wrote = written.groupBy(*self.scope, "file").agg(F.count(F.lit(1)).alias("rows"))
        wrote = stage(wrote.select("*", F.lit(load).alias("load"), F.monotonically_increasing_id().alias("number")), "wrote")
        self._filters(load, wrote)
        gone = self.spark.createDataFrame([(f,) for f in hit], "file string")
        stay = self.live().join(gone, "file", "left_anti") if version else self.spark.createDataFrame([], "file string, load int")
        if self.files.write(stay.select("file", "load").unionByName(wrote.select("file", "load"))) != load:
            raise RuntimeError("another load was committed meanwhile")
        return Merged(load, before, len(hit), wrote.count())
