"""Gold kept up to date load by load.

All three summaries are sums over (day, tenant, domain). Their partial sums are stored per silver partition: a load adds
up the rows of its own partitions and puts the sums in place of what these partitions had, which takes rows of a
replaced partition back. The summaries then read the partial sums, not silver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.operators import gold
from tenantlake.sources.states import PartitionStates


class GoldStore:
    """``levels`` are the columns by which silver is partitioned; ``date_col`` and ``quality_col`` as in ``gold``."""

    def __init__(self, spark: SparkSession, root: str, levels: Sequence[str], date_col: str = "_validation_timestamp",
                 quality_col: str = "quality_status"):
        self.states = PartitionStates(spark, f"{root.rstrip('/')}/partials", [f"_{c}" for c in levels])
        self.levels, self.date_col, self.quality_col = list(levels), date_col, quality_col

    def partials(self, silver: DataFrame) -> DataFrame:
        """Sums of each partition by day, tenant and domain; null tenants, domains and days are kept apart."""
        if "quantity" not in silver.columns:
            silver = silver.withColumn("quantity", F.lit(0.0))
        for name in ("cmo_id", "data_domain"):
            if name not in silver.columns:
                raise gold.GoldError(f"column '{name}' not found in DataFrame")
        day = gold._period(silver, self.date_col, "daily").alias("on_day")
        passed = F.count_if(gold._passed(silver, self.quality_col)).alias("passed")
        return silver.groupBy(*[F.col(c).cast("string").alias(f"_{c}") for c in self.levels], day, "cmo_id", "data_domain").agg(
            F.count(F.lit(1)).alias("records"), passed, F.sum(gold._quantity(silver)).alias("quantity"))

    def load(self, silver: DataFrame) -> None:
        """Take in partitions of silver, whole: new ones, and ones that were replaced."""
        self.states.replace(self.partials(silver))

    def retract(self, partitions: DataFrame) -> None:
        """Take back partitions (rows of ``levels``) that silver has no longer."""
        self.states.retract(partitions.select(*[F.col(c).cast("string").alias(f"_{c}") for c in self.levels]))

    def _sums(self, keys: Sequence[str], rows: DataFrame) -> DataFrame:
        kept = rows
        for k in keys:
            kept = kept.where(F.col(k).isNotNull())
        return kept.groupBy(*keys).agg(F.sum("records").alias("records"), F.sum("passed").alias("passed"),
                                       F.sum("quantity").alias("quantity"), F.count_distinct("data_domain").alias("domains"))

    def _dated(self, period: str) -> DataFrame:
        return self.states.read().withColumn("period_start", S.period_start(F.col("on_day").cast("timestamp"), period))

    def batch_summary(self, period: str = "daily") -> DataFrame:
        """As ``gold.batch_summary`` of all silver."""
        found = self._sums(["period_start", "cmo_id", "data_domain"], self._dated(period))
        return found.select("period_start", "cmo_id", "data_domain", F.col("records").alias("record_count"),
                            F.col("quantity").alias("quantity_sum"), (F.col("quantity") / F.col("records")).alias("quantity_avg"),
                            F.lit(period).alias("aggregation_period"))

    def quality_trend(self, period: str = "monthly") -> DataFrame:
        """As ``gold.quality_trend`` of all silver."""
        found = self._sums(["period_start", "cmo_id"], self._dated(period))
        return found.select("period_start", "cmo_id", F.col("records").alias("total_records"), F.col("passed").alias("pass_count"),
                            (F.col("records") - F.col("passed")).alias("fail_count"),
                            S.pct(F.col("passed"), F.col("records")).alias("pass_rate"), F.lit(period).alias("aggregation_period"))

    def supplier_scorecard(self) -> DataFrame:
        """As ``gold.supplier_scorecard`` of all silver."""
        found = self._sums(["cmo_id"], self.states.read())
        return found.select("cmo_id", F.col("records").alias("total_records"), F.col("domains").alias("domain_count"),
                            F.col("passed").alias("pass_count"), (F.col("records") - F.col("passed")).alias("fail_count"),
                            S.pct(F.col("passed"), F.col("records")).alias("pass_rate"),
                            (F.col("quantity") / F.col("records")).alias("avg_quantity"))
