"""Versioned tables over plain Parquet.

Each write lands in a fresh ``version=N`` folder; readers take the highest folder whose write
committed (has ``_SUCCESS``). A table can therefore be read, changed and written back without
overwriting the files being read, and a failed write leaves the previous version current.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _folders(self):
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(conf)
        if not fs.exists(root):
            return fs, []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return fs, sorted(int(n.split("=")[1]) for n in names if n.startswith("version="))

    def current_version(self) -> int:
        """Highest committed version, 0 when the table is empty."""
        fs, versions = self._folders()
        for v in reversed(versions):
            if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/version={v}/_SUCCESS")):
                return v
        return 0

    def read(self, schema: str | None = None, version: int | None = None) -> DataFrame:
        """Current (or given) version; an empty table needs a schema."""
        v = version or self.current_version()
        if v == 0:
            if schema is None:
                raise ValueError(f"table {self.root} is empty and no schema was given")
            return self.spark.createDataFrame([], schema)
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        return reader.parquet(f"{self.root}/version={v}")

    def write(self, df: DataFrame) -> int:
        """Commit a new version and return its number."""
        _, versions = self._folders()
        v = (versions[-1] if versions else 0) + 1
        df.write.mode("errorifexists").parquet(f"{self.root}/version={v}")
        return v


class KeyedLog:
    """Rows appended under keys, never rewritten: the state of a key is what its rows say together.

    Rows lie in folders by a hash of their key, so one key's rows are read from one folder. ``claim`` lets exactly
    one of several writers have a numbered place of a key: it is the creation of a file that mustn't exist yet.
    """

    BUCKETS = 256

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str):
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key

    def _bucket(self, value: str) -> int:
        return int(hashlib.sha256(value.encode()).hexdigest()[:8], 16) % self.BUCKETS

    def _path(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, fs = self._path(path)
        return fs.exists(at)

    def rows(self, value: str | None = None) -> DataFrame:
        """All rows, or one key's."""
        path = f"{self.root}/rows" if value is None else f"{self.root}/rows/bucket={self._bucket(value)}"
        if not self._exists(path):
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).parquet(path)
        columns = self.spark.createDataFrame([], self.schema).columns
        return found.select(*columns) if value is None else found.where(F.col(self.key) == value).select(*columns)

    def append(self, value: str, rows: list[tuple]) -> None:
        """Rows of one key."""
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(
            f"{self.root}/rows/bucket={self._bucket(value)}")

    def claim(self, value: str, place: int) -> bool:
        """Whether this call is the one that gets the key's place."""
        name = hashlib.sha256(value.encode()).hexdigest()
        at, fs = self._path(f"{self.root}/claims/{name}/{place}")
        fs.mkdirs(at.getParent())
        local = fs.getUri().getScheme() == "file"
        try:
            if local:  # Hadoop's local file system looks first and creates then
                files = self.spark._jvm.java.nio.file.Files
                nothing = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.nio.file.attribute.FileAttribute, 0)
                files.createFile(self.spark._jvm.java.io.File(at.toUri().getPath()).toPath(), nothing)
            else:
                fs.create(at, False).close()
        except Exception as exc:
            if "AlreadyExists" in str(exc) or "already exists" in str(exc):
                return False
            raise
        return True

    def forget(self, values: list[str]) -> None:
        """Drop the claims of keys that have expired and won't be asked for again."""
        for value in values:
            at, fs = self._path(f"{self.root}/claims/{hashlib.sha256(value.encode()).hexdigest()}")
            fs.delete(at, True)
