"""Silver to gold: period summaries, quality trend, scorecards and dashboard aggregates.

Groups with a null tenant, domain or period are left out, as the summaries define them. All of these
are partial-then-final hash aggregates, so a tenant with a large share of the rows is reduced map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S

# Dashboard datasets, their columns and types.
DATASETS = {
    "batch-records": (("batch_id", "string"), ("cmo_id", "string"), ("product_name", "string"),
                      ("manufacture_date", "timestamp"), ("quantity", "double"), ("quality_status", "string"),
                      ("data_domain", "string")),
    "quality-metrics": (("period_start", "timestamp"), ("cmo_id", "string"), ("total_records", "bigint"),
                        ("pass_count", "bigint"), ("fail_count", "bigint"), ("pass_rate", "double")),
    "sla-compliance": (("cmo_id", "string"), ("total_records", "bigint"), ("pass_rate", "double"),
                       ("fail_count", "bigint"), ("avg_quantity", "double"), ("domain_count", "bigint")),
}


class GoldError(ValueError):
    """A summary cannot be planned."""


def _period(df: DataFrame, date_col: str, period: str) -> Column:
    if period not in S.PERIOD_UNITS:
        raise GoldError(f"Period must be one of {list(S.PERIOD_UNITS)}, got: {period}")
    if date_col not in df.columns:
        raise GoldError(f"Date column '{date_col}' not found in DataFrame")
    dtype = dict(df.dtypes)[date_col]
    ts = F.try_to_timestamp(F.col(date_col)) if dtype == "string" else F.col(date_col)
    return S.period_start(ts, period)


def _quantity(df: DataFrame) -> Column:
    """Unreadable and missing quantities are 0 and count in the average."""
    return F.coalesce(S.to_number(F.col("quantity"), dict(df.dtypes)["quantity"]), F.lit(0.0))


def _passed(df: DataFrame, column: str) -> Column:
    return S.is_pass(F.col(column)) if column in df.columns else F.lit(True)


def _grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    kept = df
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    return kept


def batch_summary(df: DataFrame, period: str = "daily", date_col: str = "_validation_timestamp") -> DataFrame:
    """Per period, tenant and domain: record count, quantity sum and average."""
    keys = ["period_start", *[k for k in ("cmo_id", "data_domain") if k in df.columns]]
    rows = df.withColumn("period_start", _period(df, date_col, period))
    aggs = [F.count(F.lit(1)).alias("record_count")]
    if "quantity" in df.columns:
        aggs += [F.sum(_quantity(df)).alias("quantity_sum"), F.avg(_quantity(df)).alias("quantity_avg")]
    out = _grouped(rows, keys).groupBy(*keys).agg(*aggs)
    for name, fill in (("cmo_id", F.lit(None).cast("string")), ("data_domain", F.lit(None).cast("string")),
                       ("quantity_sum", F.lit(0.0)), ("quantity_avg", F.lit(0.0))):
        if name not in out.columns:
            out = out.withColumn(name, fill)
    return out.select("period_start", "cmo_id", "data_domain", "record_count", "quantity_sum", "quantity_avg",
                      F.lit(period).alias("aggregation_period"))


def quality_trend(df: DataFrame, period: str = "monthly", date_col: str = "_validation_timestamp",
                  quality_col: str = "quality_status") -> DataFrame:
    """Per period and tenant: totals, passes, failures and pass rate; no status column means all pass."""
    keys = ["period_start", *(["cmo_id"] if "cmo_id" in df.columns else [])]
    rows = df.select(*[c for c in keys[1:]], _period(df, date_col, period).alias("period_start"),
                     _passed(df, quality_col).alias("_pass"))
    out = _grouped(rows, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("total_records"),
                                                  F.count_if("_pass").alias("pass_count"))
    if "cmo_id" not in out.columns:
        out = out.withColumn("cmo_id", F.lit(None).cast("string"))
    return out.select("period_start", "cmo_id", "total_records", "pass_count",
                      (F.col("total_records") - F.col("pass_count")).alias("fail_count"),
                      S.pct(F.col("pass_count"), F.col("total_records")).alias("pass_rate"),
                      F.lit(period).alias("aggregation_period"))


def supplier_scorecard(df: DataFrame, quality_col: str = "quality_status") -> DataFrame:
    """Per tenant: totals, passes, failures, pass rate, distinct domains and average quantity."""
    rows = df if "cmo_id" in df.columns else df.withColumn("cmo_id", F.lit("unknown"))
    aggs = [F.count(F.lit(1)).alias("total_records"), F.count_if(_passed(df, quality_col)).alias("pass_count"),
            (F.count_distinct("data_domain") if "data_domain" in df.columns else F.lit(0).cast("bigint"))
            .alias("domain_count"),
            (F.avg(_quantity(df)) if "quantity" in df.columns else F.lit(0.0)).alias("avg_quantity")]
    out = _grouped(rows, ["cmo_id"]).groupBy("cmo_id").agg(*aggs)
    return out.select("cmo_id", "total_records", "domain_count", "pass_count",
                      (F.col("total_records") - F.col("pass_count")).alias("fail_count"),
                      S.pct(F.col("pass_count"), F.col("total_records")).alias("pass_rate"), "avg_quantity")


def batch_volume(df: DataFrame) -> DataFrame:
    """Batch rows per supplier."""
    return df.groupBy("cmo_id").agg(F.count("batch_id").alias("batch_count"))


def quantity_over_time(df: DataFrame, date_col: str = "manufacture_date") -> DataFrame:
    return df.groupBy(date_col).agg(F.sum("quantity").alias("quantity_sum"))


def status_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("quality_status").agg(F.count(F.lit(1)).alias("record_count"))


def average_pass_rate(metrics: DataFrame) -> DataFrame:
    """Average of the pass rates, one row (quality and timeliness gauges)."""
    return metrics.agg(F.avg("pass_rate").alias("avg_pass_rate"))


def failures_by_supplier(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("cmo_id").agg(F.sum("fail_count").alias("fail_count"))


def pass_rate_trend(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("period_start").agg(F.avg("pass_rate").alias("avg_pass_rate"))


def compliance_by_supplier(scorecard: DataFrame) -> DataFrame:
    """Total records and average pass rate per supplier."""
    return scorecard.groupBy("cmo_id").agg(F.sum("total_records").alias("total_records"),
                                           F.avg("pass_rate").alias("avg_pass_rate"))


def drill_down(df: DataFrame, hierarchy: Sequence[str], measures: Sequence[Column]) -> DataFrame:
    """Totals at every level of a hierarchy, with the level's grouping id."""
    if not hierarchy:
        raise GoldError("hierarchy must not be empty")
    return df.rollup(*hierarchy).agg(F.grouping_id().alias("grouping_level"), *measures)


def dashboard_counters(batches: DataFrame, contracts: DataFrame) -> DataFrame:
    """One row: batches, with overdue, with missing elements, active contracts."""
    overdue = F.coalesce(F.exists("data_elements", lambda e: e["overdue"]), F.lit(False))
    zero = F.lit(0).cast("bigint")
    counted = batches.agg(F.count(F.lit(1)).alias("total_batches"), F.count_if(overdue).alias("overdue_batches"),
                          F.count_if(F.size("missing_elements") > 0).alias("incomplete_batches"),
                          zero.alias("active_contracts"))
    live = contracts.agg(zero.alias("total_batches"), zero.alias("overdue_batches"),
                         zero.alias("incomplete_batches"),
                         F.count_if(F.col("status") == "active").alias("active_contracts"))
    return counted.unionByName(live).agg(*[F.sum(c).alias(c) for c in counted.columns])


def dataset(df: DataFrame, name: str) -> DataFrame:
    """A dashboard dataset: the fixed columns, cast to the fixed types."""
    if name not in DATASETS:
        raise GoldError(f"Unknown dataset: {name}. Must be one of {list(DATASETS)}")
    return df.select(*[F.col(c).cast(t).alias(c) for c, t in DATASETS[name]])


def contract_counts(contracts: DataFrame) -> DataFrame:
    """Contracts per supplier and domain."""
    return contracts.groupBy("cmo_id", "data_domain").agg(F.count(F.lit(1)).alias("contract_count"))
