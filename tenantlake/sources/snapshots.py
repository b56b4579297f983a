"""Snapshots of a listing: what was there, kept as versions, and what changed between two of them."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.sources.tables import VersionedTable

ADDED, CHANGED, REMOVED = "added", "changed", "removed"
FILES = "path string, size long, modified timestamp"


def _listed(folders: Iterator[pa.RecordBatch], recursive: bool) -> Iterator[pa.RecordBatch]:
    """(path, size, modified, is_folder) of what is in the folders; one that has gone has nothing."""
    from pyarrow import fs as pafs

    kind = pa.schema([("path", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("is_folder", pa.bool_())])
    for batch in folders:
        for folder in batch.column(0).to_pylist():
            system, inner = pafs.FileSystem.from_uri(folder)
            head = folder[:len(folder) - len(inner)]
            found = system.get_file_info(pafs.FileSelector(inner, recursive=recursive, allow_not_found=True))
            for lo in range(0, len(found), 10_000):
                part = [f for f in found[lo:lo + 10_000] if not (recursive and f.type == pafs.FileType.Directory)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([head + f.path for f in part], pa.string()), pa.array([f.size for f in part], pa.int64()),
                     pa.array([None if f.mtime_ns is None else f.mtime_ns // 1000 for f in part], pa.int64()).cast(kind.field(2).type),
                     pa.array([f.type == pafs.FileType.Directory for f in part], pa.bool_())], schema=kind)


def list_tree(spark: SparkSession, root: str, depth: int = 2) -> DataFrame:
    """(path, size, modified) of every file below a folder, listed by tasks instead of the driver.

    The folders ``depth`` levels down are dealt out and listed with all below them; a level is a pass. A folder's own
    list is in one task's memory, so deliver to many folders, or list deeper. Needs a root that pyarrow can list.
    """
    from tenantlake.session import stage

    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    if urlparse(whole).scheme == "file":
        whole = "file://" + whole.removeprefix("file:").removeprefix("//")
    ddl = FILES + ", is_folder boolean"
    folders, files = spark.createDataFrame([(whole,)], "path string"), None
    for level in range(depth + 1):
        last = level == depth
        dealt = folders.repartition(max(1, spark.sparkContext.defaultParallelism), "path")
        found = stage(dealt.mapInArrow(lambda batches, deep=last: _listed(batches, deep), ddl), "listing")
        here = found.where(~F.col("is_folder")).drop("is_folder")
        files = here if files is None else files.unionByName(here)
        folders = found.where("is_folder").select("path")
    return files


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change, size, modified, size_before, modified_before) of files that were added, changed or removed.

    A file has changed if its size or time has. Unchanged files are not returned, nor are rows without a path. A path
    that a listing holds twice counts with its newest time, the larger size of equals.
    """
    def one(df: DataFrame, tail: str) -> DataFrame:
        newest = F.max(F.struct("modified", "size"))
        return df.where(F.col("path").isNotNull()).groupBy("path").agg(newest.alias("f")).select(
            "path", F.col("f.size").alias(f"size{tail}"), F.col("f.modified").alias(f"modified{tail}"), F.lit(True).alias(f"there{tail}"))

    both = one(after, "").join(one(before, "_before"), "path", "full")
    change = (F.when(F.col("there_before").isNull(), ADDED).when(F.col("there").isNull(), REMOVED)
              .when(~(F.col("size").eqNullSafe(F.col("size_before")) & F.col("modified").eqNullSafe(F.col("modified_before"))), CHANGED))
    return both.select("path", change.alias("change"), "size", "modified", "size_before", "modified_before").where(
        F.col("change").isNotNull())


class ListingSnapshots:
    """Listings kept as versions of a table."""

    def __init__(self, spark: SparkSession, root: str):
        self.versions = VersionedTable(spark, root)

    def take(self, files: DataFrame) -> int:
        """Keep a listing (path, size, modified; other columns are left out) and return its number."""
        return self.versions.write(files.select("path", F.col("size").cast("long").alias("size"), "modified"))

    def read(self, number: int | None = None) -> DataFrame:
        """A listing, the last if no number is given; none was before the first (number 0)."""
        if number == 0:
            return self.versions.spark.createDataFrame([], FILES)
        return self.versions.read(FILES, number)

    def since(self, number: int) -> DataFrame:
        """What has changed from a listing to the last one."""
        return differences(self.read(number), self.read())
