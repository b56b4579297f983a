"""Keys that a stream has delivered before: an index beside the stream, in buckets, with expiry.

Spark's own stream de-duplication forgets a key when the watermark passes it, and drops every later row unseen. Here the
keys that were delivered lie in a table beside the stream, so a late row that is new is told from a repeated one:

    {root}/base-{N}      keys of all batches before N, without those that had expired by then
    {root}/delta-{N}     keys that batch N brought
    {root}/clock-{N}     the newest event time up to and with batch N, one row

Each folder is written by one batch and replaces itself when that batch is replayed; a batch reads only what earlier
batches wrote, so a replay gives the same answer. Folders are partitioned by a hash of the key, and a batch opens only
the buckets its own keys fall into. Every ``fold_every`` batches the base and its deltas are folded into a new base.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tenantlake.session import stage
from tenantlake.sources.folders import NumberedFolders

BUCKETS = 64
FOLD_EVERY = 8
EXPIRY = "90 days"

#: What a row of a batch is: the first of its key, the first of its key but late, or one more of a key.
FIRST, LATE, REPEATED = "first", "late", "repeated"


class SeenKeys(NumberedFolders):
    """``keys`` name the columns that identify a delivery, ``ts`` its event time; null keys equal each other.

    A key is remembered for ``expiry`` after the event time of its first delivery, on the clock of the newest event.
    A row is late if its event time is more than ``within`` behind the newest one of all batches before it.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], ts: str, within: str, expiry: str = EXPIRY,
                 buckets: int = BUCKETS, fold_every: int = FOLD_EVERY):
        super().__init__(spark, root)
        self.keys, self.ts = list(keys), ts
        self.within, self.expiry, self.buckets, self.fold_every = within, expiry, buckets, fold_every

    def _write(self, rows: DataFrame, folder: str) -> None:
        # the whole folder is replaced, also buckets that a replay doesn't fill
        rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{self.root}/{folder}")

    # --- the index ---

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in self.keys]), F.lit(self.buckets)).cast("int")

    def known(self, before: int) -> DataFrame | None:
        """(keys, first_at, bucket) that batches before ``before`` delivered; None if there are none."""
        bases = [n for n in self._folders("base") if n <= before]
        parts = [self._read("base", n) for n in bases[-1:]]
        parts += [self._read("delta", n) for n in self._folders("delta") if (bases[-1] if bases else 0) <= n < before]
        out = None
        for p in parts:
            out = p if out is None else out.unionByName(p)
        return out

    def clock(self, before: int):
        """The newest event time of the batches before ``before``, or None."""
        numbers = [n for n in self._folders("clock") if n < before]
        return self._read("clock", numbers[-1]).first()["newest"] if numbers else None

    def fold(self, before: int) -> None:
        """One base out of the base and the deltas before ``before``; keys that have expired are left out."""
        known, clock = self.known(before), self.clock(before)
        if known is None or before in self._folders("base"):
            return
        alive = F.col("first_at") >= F.lit(clock) - F.expr(f"interval {self.expiry}")
        kept = known.where(F.col("first_at").isNull() | alive)
        # a task writes whole buckets, so the base has one file a bucket
        self._write(kept.repartition(self.buckets, "bucket"), f"base-{before}")
        self._drop("base", [n for n in self._folders("base") if n < before])
        self._drop("delta", [n for n in self._folders("delta") if n < before])
        self._drop("clock", [n for n in self._folders("clock") if n < before][:-1])

    def judge(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """``batch`` with ``_delivery``: first, late or repeated; the batch's new keys are in the index afterwards.

        Of several rows of a new key in one batch the earliest is its first, ties broken by all sortable columns.
        ``batch`` should be staged: it is read three times.
        """
        if batch_id and batch_id % self.fold_every == 0:
            self.fold(batch_id)
        clock, known = self.clock(batch_id), self.known(batch_id)
        ties = [F.col(f"`{n}`") for n, t in batch.dtypes if not re.search(r"\b(map<|variant\b)", t)]
        place = F.row_number().over(Window.partitionBy(*[F.col(f"`{k}`") for k in self.keys]).orderBy(
            F.asc_nulls_last(F.col(f"`{self.ts}`")), *ties))
        keyed = batch.select("*", self._bucket().alias("_bucket"))
        ranked = keyed.withColumn("_place", place)
        if known is None:
            seen = ranked.withColumn("_seen", F.lit(False))
        else:
            # one row a key in the batch asks the index; the buckets it can be in prune the folders
            asked = stage(keyed.select("_bucket", *self.keys).distinct(), "asked")
            buckets = [r[0] for r in asked.select("_bucket").distinct().collect()]  # at most ``buckets``
            old = known.where(F.col("bucket").isin(buckets))
            same = asked["_bucket"] == old["bucket"]
            for k in self.keys:
                same = same & asked[k].eqNullSafe(old[k])
            hit = asked.join(old, same, "left_semi").select(
                *[F.col(f"`{k}`").alias(f"_key{i}") for i, k in enumerate(self.keys)], F.lit(True).alias("_hit"))
            same = F.lit(True)
            for i, k in enumerate(self.keys):
                same = same & ranked[k].eqNullSafe(hit[f"_key{i}"])
            seen = ranked.join(hit, same, "left").withColumn("_seen", F.col("_hit").isNotNull())
        late = F.lit(False) if clock is None else F.coalesce(
            F.col(f"`{self.ts}`") < F.lit(clock) - F.expr(f"interval {self.within}"), F.lit(False))
        verdict = F.when(F.col("_seen") | (F.col("_place") > 1), REPEATED).when(late, LATE).otherwise(FIRST)
        judged = stage(seen.select(*[F.col(f"`{c}`") for c in batch.columns], "_bucket", verdict.alias("_delivery")), "judged")
        self._record(judged, batch_id, clock)
        return judged.drop("_bucket")

    def _record(self, judged: DataFrame, batch_id: int, clock) -> None:
        new = judged.where(F.col("_delivery") != REPEATED).select(
            *[F.col(f"`{k}`") for k in self.keys], F.col(f"`{self.ts}`").alias("first_at"), F.col("_bucket").alias("bucket"))
        self._write(new.repartition("bucket"), f"delta-{batch_id}")
        judged.agg(F.greatest(F.max(f"`{self.ts}`"), F.lit(clock).cast("timestamp")).alias("newest")).coalesce(1).write.mode(
            "overwrite").parquet(f"{self.root}/clock-{batch_id}")
