"""The newest row of every key of a stream that emits updates: a base, deltas since, and folding.

    {root}/base-{N}      one row a key, as of batch N
    {root}/delta-{N}     the rows that batch N changed

A reader opens the last base and the deltas after it, at most ``fold_every`` of them, so what it reads is bounded by
the keys and not by how long the stream has run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.sources.folders import NumberedFolders

FOLD_EVERY = 8


class LatestRows(NumberedFolders):
    """``keys`` name a row; null keys equal each other. A batch holds one row a key, as update mode emits them."""

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], fold_every: int = FOLD_EVERY):
        super().__init__(spark, root)
        self.keys, self.fold_every = list(keys), fold_every

    def _parts(self) -> list[tuple[str, int]]:
        """The last base and the deltas after it."""
        base = self._folders("base")[-1:]
        return [("base", n) for n in base] + [("delta", n) for n in self._folders("delta") if not base or n > base[0]]

    def put(self, batch: DataFrame, batch_id: int) -> None:
        """Take a batch in; one that is replayed replaces what it wrote."""
        batch.write.mode("overwrite").parquet(f"{self.root}/delta-{batch_id}")
        if (batch_id + 1) % self.fold_every == 0:
            self.fold(batch_id)

    def fold(self, upto: int) -> None:
        """A base as of batch ``upto``; the base before it and its deltas stay for readers that have begun, older ones go."""
        bases = self._folders("base")
        if bases and bases[-1] >= upto:  # replayed: the base is there, and the deltas it came from may be gone
            return
        self.read().write.mode("overwrite").parquet(f"{self.root}/base-{upto}")
        if bases:
            self._drop("base", bases[:-1])
            self._drop("delta", [n for n in self._folders("delta") if n <= bases[-1]])

    def read(self) -> DataFrame:
        """One row a key, the one of the newest batch that changed it."""
        rows = None
        for kind, n in self._parts():
            part = self._read(kind, n).withColumn("_batch", F.lit(n))
            rows = part if rows is None else rows.unionByName(part)
        if rows is None:
            raise ValueError(f"no batch has been written under {self.root}")
        payload = [F.col(f"`{c}`") for c in rows.columns if c not in (*self.keys, "_batch")]
        newest = rows.groupBy(*[F.col(f"`{k}`") for k in self.keys]).agg(F.max_by(F.struct(*payload), F.col("_batch")).alias("_row"))
        return newest.select(*[F.col(f"`{k}`") for k in self.keys], "_row.*")
