"""Session defaults and lineage cuts.

The library never forces a physical strategy: joins are left to adaptive execution, whose
broadcast decision is made from measured sizes, and shuffle widths are left to the cluster.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # y/m/d path levels stay zero-padded strings
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    # re-running a day replaces that day only
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(app_name: str = "tenantlake", master: str | None = None, **extra: str) -> SparkSession:
    """Build (or reuse) a session carrying the library's defaults; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in SESSION_CONF.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` when the cluster names one.

    A local temporary folder is used only when the master itself is local (tests, smoke runs).
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="tenantlake-")
    spark.sparkContext.setCheckpointDir(local)
    return local


# Folders of the innermost ``scratch`` block of this thread, and those of no block, which go when the process ends.
_blocks = threading.local()
_unowned: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, or directly once the context is gone and the folder is local."""
    if spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    elif "://" not in path:
        shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Owner of what is staged inside: those folders are removed at its end, so results must be written by then."""
    outer, mine = getattr(_blocks, "paths", None), []
    _blocks.paths = mine
    try:
        yield
    finally:
        _blocks.paths = outer
        for path in mine:
            _remove(spark, path)


@atexit.register
def _remove_unowned() -> None:
    while _unowned:
        _remove(*_unowned.pop())


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path under the shared folder, removed with the ``scratch`` block around it or the process."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    owned = getattr(_blocks, "paths", None)
    if owned is None:
        _unowned.append((spark, path))
    else:
        owned.append(path)
    return path


@contextmanager
def few_listing_tasks(spark: SparkSession) -> Iterator[None]:
    """List paths in some tasks a core: Spark makes up to 10,000 tasks of a stream's files, each time anew."""
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), 4 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: fixes row placement and survives the loss of executors."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a result that several branches read to the shared folder and read it back.

    Parquet rather than a checkpoint, so each branch reads only its own columns and row groups.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal rows evenly over as many partitions as the cluster has cores, before CPU-heavy work on them.

    A delivered file with one row group, or a compressed text file, is one task however large it is. The rule is
    the same for every input; a stream stays as it is.
    """
    return df if df.isStreaming else df.repartition(df.sparkSession.sparkContext.defaultParallelism)
