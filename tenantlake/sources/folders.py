"""Numbered folders of a table beside a stream: each is written by one batch, and there once its write has committed."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


class NumberedFolders:
    """Folders ``{root}/{kind}-{N}``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _folders(self, kind: str) -> list[int]:
        """Numbers of the committed folders of a kind, rising; folding keeps them few."""
        at, fs = self._fs(self.root)
        if not fs.exists(at):
            return []
        found = [re.fullmatch(rf"{kind}-(\d+)", s.getPath().getName()) for s in fs.listStatus(at)]
        numbers = sorted(int(m[1]) for m in found if m)
        return [n for n in numbers if fs.exists(self._fs(f"{self.root}/{kind}-{n}/_SUCCESS")[0])]

    def _drop(self, kind: str, numbers: Sequence[int]) -> None:
        for n in numbers:
            at, fs = self._fs(f"{self.root}/{kind}-{n}")
            fs.delete(at, True)

    def _read(self, kind: str, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{kind}-{n}")
