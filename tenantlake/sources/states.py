"""Partial results kept per source partition, so that a load recomputes only the partitions it brings.

A state is a table of mergeable values (sums, counts, bitmaps) with one group of rows per source partition. Replacing a
partition's rows takes the old ones back and puts the new ones in; the combined result is an aggregate over the states.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tenantlake.session import stage


class PartitionStates:
    def __init__(self, spark: SparkSession, root: str, levels: Sequence[str]):
        self.spark, self.root, self.levels = spark, root.rstrip("/"), list(levels)

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        at, fs = self._path(self.root)
        return fs.exists(at)

    def replace(self, states: DataFrame, together: bool = True) -> None:
        """Put in the states of the partitions that ``states`` holds, in place of what these partitions had.

        A partition's states are written by one task, or, if not ``together``, by the tasks that hold them.
        """
        (states.repartition(*self.levels) if together else states).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *self.levels).parquet(self.root)

    def retract(self, partitions: DataFrame) -> None:
        """Take back partitions (their level columns) that are gone from the source."""
        if not self.exists():
            return
        names = [r.asDict() for r in partitions.select(*self.levels).distinct().collect()]  # a load's partitions
        for name in names:
            folder = "/".join(f"{k}={self._escaped(name[k])}" for k in self.levels)
            at, fs = self._path(f"{self.root}/{folder}")
            fs.delete(at, True)

    def _escaped(self, value) -> str:
        if value is None:
            return "__HIVE_DEFAULT_PARTITION__"
        return self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(str(value))

    def read(self, like: DataFrame | None = None) -> DataFrame:
        """All states; with none yet, those of no partition, as ``like`` has them."""
        return self.spark.read.parquet(self.root) if self.exists() or like is None else stage(like.where("false"), "states")
