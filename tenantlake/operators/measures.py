"""Quality measures that combine: states per partition, from which a ruleset's results follow without the rows.

All measures but one are counts, whose states add up. Distinct values don't: a value may be in several partitions. They
are numbered by a dictionary that only grows, and a partition's state is the set of its numbers as bitmaps; the union of
the bitmaps is counted, so the result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.operators import quality
from tenantlake.session import stage
from tenantlake.sources.states import PartitionStates

_WORDS = "column_name string, value string, number long"


class MeasureStore:
    """States of a ruleset per partition (``levels``) of a table; rules that need other rows (``CustomSql``) are skipped."""

    def __init__(self, spark: SparkSession, root: str, rules: Sequence[quality.QualityRule], levels: Sequence[str]):
        self.spark, self.root, self.rules, self.levels = spark, root.rstrip("/"), list(rules), list(levels)
        named = [f"_{c}" for c in levels]
        self.counts = PartitionStates(spark, f"{self.root}/counts", named)
        self.bitmaps = PartitionStates(spark, f"{self.root}/bitmaps", named)
        self.words = PartitionStates(spark, f"{self.root}/dictionary", ["load"])

    def _compiled(self, df: DataFrame) -> list[quality.CompiledRule]:
        return [quality.CompiledRule(i, r, df, distinct="apart") for i, r in enumerate(self.rules)]

    def _partition(self) -> list:
        return [F.col(f"`{c}`").cast("string").alias(f"_{c}") for c in self.levels]

    def _dictionary(self) -> DataFrame:
        return self.words.read(self.spark.createDataFrame([], _WORDS)).select("column_name", "value", "number")

    def _numbered(self, values: DataFrame) -> DataFrame:
        """(column_name, value, number) of all different values, new ones put into the dictionary."""
        known = self._dictionary()
        new = values.select("column_name", "value").distinct().join(known, ["column_name", "value"], "left_anti")
        # a task's rows are counted as it writes them, a column after the other: what is read again is what was counted
        new = stage(new.sortWithinPartitions("column_name").withColumns({"task": F.spark_partition_id(), "row": F.monotonically_increasing_id().bitwiseAND(
            F.lit((1 << 33) - 1))}), "words")
        runs = sorted(new.groupBy("column_name", "task").agg(F.min("row"), F.count(F.lit(1))).collect())  # one a task and column
        if runs:
            top, load = known.agg(F.coalesce(F.max("number"), F.lit(-1)), F.count(F.lit(1))).first()
            # numbers of a column follow each other, so that one bitmap bucket holds neighbours
            starts, at = [], top + 1
            for column, task, first, n in runs:
                starts.append((column, task, at - first))
                at += n
            starts = self.spark.createDataFrame(starts, "column_name string, task int, start long")
            self.words.replace(new.join(starts, ["column_name", "task"]).select(
                "column_name", "value", (F.col("row") + F.col("start")).alias("number"), F.lit(load).alias("load")), together=False)
        return self._dictionary()

    def load(self, rows: DataFrame) -> None:
        """Measure the partitions in ``rows``, which must be whole; what these partitions had is replaced."""
        compiled = self._compiled(rows)
        aggs = [a for c in compiled for a in c.aggs]
        measured = rows.groupBy(*self._partition()).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
        self.counts.replace(measured)
        columns = sorted({c.distinct_column for c in compiled if c.distinct_column})
        if not columns:
            return
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]))
        values = stage(rows.select(*self._partition(), cells.alias("cell")).select(
            *[f"_{c}" for c in self.levels], "cell.*").where("value is not null").distinct(), "values")
        numbers = values.join(self._numbered(values), ["column_name", "value"])
        self.bitmaps.replace(numbers.groupBy(
            *[f"_{c}" for c in self.levels], "column_name", F.bitmap_bucket_number("number").alias("bucket")).agg(
            F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bitmap")))

    def retract(self, partitions: DataFrame) -> None:
        gone = partitions.select(*self._partition())
        self.counts.retract(gone)
        self.bitmaps.retract(gone)

    def distinct_counts(self) -> DataFrame:
        """(column_name, n): exact numbers of different values over all partitions."""
        if not self.bitmaps.exists():
            return self.spark.createDataFrame([], "column_name string, n long")
        merged = self.bitmaps.read().groupBy("column_name", "bucket").agg(F.bitmap_count(F.bitmap_or_agg("bitmap")).alias("n"))
        return merged.groupBy("column_name").agg(F.sum("n").alias("n"))

    def results(self, like: DataFrame) -> DataFrame:
        """As ``quality.evaluate_rules`` of the whole table; ``like`` is a frame with its columns, whose rows aren't read."""
        compiled = self._compiled(like)
        names = ["_rows", *[n for c in compiled for n in c.agg_names]]
        states = self.counts.read(like.limit(0).groupBy(*self._partition()).agg(
            F.count(F.lit(1)).alias("_rows"), *[a for c in compiled for a in c.aggs]))
        sums = states.agg(*[F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names])
        different = self.distinct_counts()
        for c in compiled:
            if c.distinct_column:
                n = different.where(F.col("column_name") == c.distinct_column).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
                sums = sums.withColumn(c.agg_names[0], n.scalar())
        return sums.select(F.inline(F.array(*[c.as_struct() for c in compiled])))
