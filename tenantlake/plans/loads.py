"""Registered queries: work that goes on over several loads, checked against SQL over all that came."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenantlake.operators.gold_store import GoldStore
from tenantlake.operators.measures import MeasureStore
from tenantlake.operators.quality import QualityRule
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query
from tenantlake.session import scratch_path
from tenantlake.sources.keyed import KeyedTable

_REC = ("v_batch_records",)

# The second load delivers every seventh order again: its lines a month later with more quantity, or, every other time, a
# month earlier, when the row that is there stays.
_AGAIN = """again AS (SELECT batch_id, cmo_id, data_domain, quantity + 1000 AS quantity,
  CASE WHEN CAST(regexp_extract(batch_id, 'B(\\d+)', 1) AS BIGINT) % 2 = 0 THEN ts + INTERVAL 30 DAY ELSE ts - INTERVAL 30 DAY END AS ts
  FROM v_batch_records WHERE CAST(regexp_extract(batch_id, 'B(\\d+)', 1) AS BIGINT) % 7 = 0)"""


@query("silver_merged_loads", "ETL-3 SNK-3", f"""WITH {_AGAIN},
every AS (SELECT batch_id, cmo_id, data_domain, quantity, ts FROM v_batch_records UNION ALL SELECT * FROM again)
SELECT batch_id, cmo_id, data_domain, quantity, strftime(ts, '%Y-%m-%d') AS day FROM (
  SELECT *, row_number() OVER (PARTITION BY cmo_id, batch_id, data_domain ORDER BY ts DESC, quantity DESC) AS place FROM every) WHERE place = 1""", _REC)
def silver_merged_loads(spark, sf):
    """Two loads into silver: a key delivered on two days is one row, its last."""
    first = B.batch_records(spark, sf).select("batch_id", "cmo_id", "data_domain", "quantity", F.col("ts").cast("timestamp").alias("ts"))
    first = first.withColumn("year", F.year("ts").cast("string"))
    order = F.regexp_extract("batch_id", r"B(\d+)", 1).cast("bigint")
    moved = F.when(order % 2 == 0, F.col("ts") + F.expr("interval 30 days")).otherwise(F.col("ts") - F.expr("interval 30 days"))
    second = first.where(order % 7 == 0).withColumns({"quantity": F.col("quantity") + 1000, "ts": moved, "year": F.year(moved).cast("string")})
    table = KeyedTable(spark, scratch_path(spark, "keyed"), ["cmo_id", "batch_id"], ["ts"], ["data_domain", "year"], ["data_domain"])
    for load in (first, second):
        table.merge(load)
    return table.read().select("batch_id", "cmo_id", "data_domain", "quantity", F.date_format("ts", "yyyy-MM-dd").alias("day"))


# The second load replaces the partitions of one domain from 1997 on (rows of even orders only, all passing) and takes one year away.
_NOW = """now AS (SELECT batch_id, cmo_id, data_domain, ts,
  CASE WHEN replaced THEN quantity + 1 ELSE quantity END AS quantity, CASE WHEN replaced THEN 'PASS' ELSE quality_status END AS quality_status
  FROM (SELECT *, data_domain = 'quality-data' AND year(ts) >= 1997 AS replaced,
    CAST(regexp_extract(batch_id, 'B(\\d+)', 1) AS BIGINT) AS order_key FROM v_batch_records)
  WHERE (NOT replaced OR order_key % 2 = 0) AND NOT (data_domain = 'yield-data' AND year(ts) = 1995))"""
_LEVELS = ["data_domain", "year"]


def _loads(spark, sf):
    """(the first load, the second, the partitions that are taken away)."""
    first = B.batch_records(spark, sf).select("batch_id", "cmo_id", "data_domain", "quantity", "quality_status", "ts",
                                              F.year("ts").alias("year"))
    order = F.regexp_extract("batch_id", r"B(\d+)", 1).cast("bigint")
    second = first.where((F.col("data_domain") == "quality-data") & (F.col("year") >= 1997) & (order % 2 == 0)).withColumns(
        {"quantity": F.col("quantity") + 1, "quality_status": F.lit("PASS")})
    gone = first.select(*_LEVELS).where("data_domain = 'yield-data' and year = 1995")
    return first, second, gone


@query("gold_after_two_loads", "AGG-1 AGG-2 AGG-3 AGG-4", f"""WITH {_NOW}
SELECT 'summary' AS kind, strftime(date_trunc('month', ts), '%Y-%m-%d') AS period, cmo_id, data_domain, count(*) AS n, round(sum(quantity), 4) AS a, round(avg(quantity), 6) AS b
  FROM now GROUP BY ALL
UNION ALL SELECT 'trend', strftime(date_trunc('month', ts), '%Y-%m-%d'), cmo_id, NULL, count(*), count(*) FILTER (WHERE quality_status = 'PASS'),
  round_even(count(*) FILTER (WHERE quality_status = 'PASS') / count(*) * 100::DOUBLE * 100, 0) / 100 FROM now GROUP BY ALL
UNION ALL SELECT 'scorecard', NULL, cmo_id, NULL, count(*), count(DISTINCT data_domain), round(avg(quantity), 6) FROM now GROUP BY ALL""", _REC)
def gold_after_two_loads(spark, sf):
    """The summaries after a second load that replaced some partitions and took one away, from partial sums."""
    store = GoldStore(spark, scratch_path(spark, "gold"), _LEVELS, "ts")
    first, second, gone = _loads(spark, sf)
    store.load(first)
    store.load(second)
    store.retract(gone)
    text, none = lambda c: F.date_format(c, "yyyy-MM-dd"), F.lit(None).cast("string")
    summary = store.batch_summary("monthly").select(
        F.lit("summary").alias("kind"), text("period_start").alias("period"), "cmo_id", "data_domain", F.col("record_count").alias("n"),
        F.round("quantity_sum", 4).alias("a"), F.round("quantity_avg", 6).alias("b"))
    trend = store.quality_trend("monthly").select(
        F.lit("trend"), text("period_start"), "cmo_id", none, "total_records", F.col("pass_count").cast("double"), "pass_rate")
    card = store.supplier_scorecard().select(
        F.lit("scorecard"), none, "cmo_id", none, "total_records", F.col("domain_count").cast("double"), F.round("avg_quantity", 6))
    return summary.union(trend).union(card)


_RULES = [
    QualityRule("c", "complete", "completeness", 'Completeness "quality_status"', 99.0),
    QualityRule("u", "keys", "uniqueness", 'Uniqueness "batch_id"', 100.0),
    QualityRule("t", "tenants", "uniqueness", 'Uniqueness "cmo_id"', 1.0),
    QualityRule("q", "quantity", "accuracy", 'Accuracy "quantity" between 1 and 40', 90.0),
    QualityRule("s", "status", "accuracy", 'Accuracy "quality_status" in ["PASS"]', 60.0),
]


@query("quality_after_two_loads", "DQ-13 DQ-14 DQ-30", f"""WITH {_NOW}
SELECT rule_id, round_even(100::DOUBLE * n / d * 100, 0) / 100 AS actual_value, 100::DOUBLE * n / d >= least AS passed FROM (
  SELECT 'c' AS rule_id, count(quality_status) AS n, count(*) AS d, 99 AS least FROM now
  UNION ALL SELECT 'u', count(DISTINCT batch_id), count(batch_id), 100 FROM now
  UNION ALL SELECT 't', count(DISTINCT cmo_id), count(cmo_id), 1 FROM now
  UNION ALL SELECT 'q', count(*) FILTER (WHERE quantity BETWEEN 1 AND 40), count(quantity), 90 FROM now
  UNION ALL SELECT 's', count(*) FILTER (WHERE quality_status = 'PASS'), count(quality_status), 60 FROM now)""", _REC)
def quality_after_two_loads(spark, sf):
    """The same loads measured: states of the partitions, distinct values by bitmaps."""
    store = MeasureStore(spark, scratch_path(spark, "measures"), _RULES, _LEVELS)
    first, second, gone = _loads(spark, sf)
    store.load(first)
    store.load(second)
    store.retract(gone)
    return store.results(first).select("rule_id", "actual_value", "passed")
