"""A table laid out in an order, so that a page of it is read without sorting it.

    {root}/rows/range=R/     the rows of the R-th part of the order
    {root}/ranges/           one row a range: its number, rows, the rows before it, and the ends of its first key

A page opens the ranges that hold its rows; the page after a given key opens those behind that key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of a range, about.
RANGE_ROWS = 1_000_000


class OrderIndex:
    """``order`` names the columns to sort by, each rising with nulls first, or falling with nulls last after a ``-``.

    Rows that tie on them are ordered by the rest of their columns, so pages neither repeat nor miss a row.
    """

    def __init__(self, spark: SparkSession, root: str, order: Sequence[str]):
        self.spark, self.root = spark, root.rstrip("/")
        self.names = [o.removeprefix("-") for o in order]
        self.falling = [o.startswith("-") for o in order]

    def _sort(self, columns: Sequence[str]) -> list[Column]:
        rest = [c for c in columns if c not in self.names]
        return [F.desc_nulls_last(f"`{n}`") if down else F.asc_nulls_first(f"`{n}`")
                for n, down in zip(self.names, self.falling)] + [F.asc_nulls_first(f"`{c}`") for c in rest]

    def build(self, df: DataFrame, range_rows: int = RANGE_ROWS) -> None:
        """Lay the rows out, in ranges of about ``range_rows``; columns must be sortable and none named ``range``."""
        if "range" in df.columns:
            raise ValueError("the table has a column named range")
        n = max(1, -(-df.count() // range_rows))
        placed = df.repartitionByRange(n, *self._sort(df.columns)).withColumn("range", F.spark_partition_id())
        # a folder for each range that has rows; where the table is empty there is still its schema
        placed.sortWithinPartitions("range", *self._sort(df.columns)).write.mode("overwrite").option(
            "partitionOverwriteMode", "static").partitionBy("range").parquet(f"{self.root}/rows")
        df.where("false").write.mode("overwrite").parquet(f"{self.root}/schema")
        sizes = self._rows(df.columns).withColumn("range", F.col("range").cast("int")).groupBy("range").agg(
            F.count(F.lit(1)).alias("n"), *self._ends())
        # one small row a range
        before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        sizes.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.mode("overwrite").parquet(
            f"{self.root}/ranges")

    def _ends(self) -> list[Column]:
        """Per range the least and the greatest of the first sort column, and how many rows have none."""
        first = F.col(f"`{self.names[0]}`")
        return [F.min(first).alias("least"), F.max(first).alias("most"), F.count_if(first.isNull()).alias("none")]

    def _rows(self, columns: Sequence[str], ranges: Sequence[int] | None = None) -> DataFrame:
        empty = self.spark.read.parquet(f"{self.root}/schema")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/rows")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not any(s.isDirectory() for s in fs.listStatus(at)) or ranges is not None and not ranges:
            return empty.withColumn("range", F.lit(0))
        reader = self.spark.read.schema(empty.schema).option("basePath", f"{self.root}/rows")
        paths = [f"{self.root}/rows"] if ranges is None else [f"{self.root}/rows/range={r}" for r in ranges]
        return reader.parquet(*paths).select(*[F.col(f"`{c}`") for c in columns], "range")

    def ranges(self) -> DataFrame:
        """(range, n, before, least, most, none): what a page is found by."""
        return self.spark.read.parquet(f"{self.root}/ranges")

    def total(self) -> int:
        """The number of rows."""
        return self.ranges().agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def opened(self, page: int, size: int) -> list[int]:
        """The ranges that hold a page, counted from 1."""
        if page < 1 or size < 1:
            raise ValueError("pages and their size count from one")
        start = (page - 1) * size
        found = self.ranges().where((F.col("before") < start + size) & (F.col("before") + F.col("n") > start))
        return sorted(r[0] for r in found.select("range").collect())  # those of one page

    def page(self, page: int, size: int) -> DataFrame:
        """The rows of a page in order; none beyond the last."""
        columns = self.spark.read.parquet(f"{self.root}/schema").columns
        opened = self.opened(page, size)
        rows = self._rows(columns, opened).drop("range").orderBy(*self._sort(columns))
        if not opened:
            return rows
        skip = (page - 1) * size - self.ranges().where(F.col("range") == opened[0]).first()["before"]
        return rows.offset(skip).limit(size)

    def after(self, row: Mapping[str, object], size: int) -> DataFrame:
        """The ``size`` rows that follow a row (all its columns) in the order: the next page by key, whatever came before.

        Ranges are opened one after the other from the first that can hold such a row, until there are enough.
        """
        columns = self.spark.read.parquet(f"{self.root}/schema").columns
        types = self.spark.read.parquet(f"{self.root}/schema").schema
        names = self.names + [c for c in columns if c not in self.names]
        down = self.falling + [False] * (len(names) - len(self.falling))
        beyond, same = F.lit(False), F.lit(True)
        for name, falls in zip(names, down):
            mine, given = F.col(f"`{name}`"), F.lit(row[name]).cast(types[name].dataType)
            if row[name] is None:  # nulls are first where values rise and last where they fall
                later = F.lit(False) if falls else mine.isNotNull()
            else:
                later = (mine.isNull() | (mine < given)) if falls else mine > given
            beyond = beyond | same & F.coalesce(later, F.lit(False))
            same = same & mine.eqNullSafe(given)
        given = F.lit(row[self.names[0]]).cast(types[self.names[0]].dataType)
        if row[self.names[0]] is None:
            can = F.col("none") > 0 if self.falling[0] else F.lit(True)
        elif self.falling[0]:
            can = (F.col("least") <= given) | (F.col("none") > 0)
        else:
            can = F.col("most") >= given
        behind = self.ranges().where(can).orderBy("range")
        opened, rows, found, seen = [], None, 0, -1
        while found < size:
            more = behind.where(F.col("range") > seen).first()
            if more is None:
                break
            seen = more["range"]
            opened.append(seen)
            rows = self._rows(columns, opened).drop("range").where(beyond)
            found = rows.count()
        rows = self._rows(columns, []).drop("range") if rows is None else rows
        return rows.orderBy(*self._sort(columns)).limit(size)
