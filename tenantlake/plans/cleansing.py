"""Registered queries: cleansing, bronze to silver."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import cleanse, gold
from tenantlake.operators.schema import TableSchema
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query

SCHEMA = TableSchema(
    {"batch_id": "string", "product_id": "string", "quantity": "integer", "approved": "boolean", "note": "string"},
    ("batch_id", "product_id"))
NUMBER_SCHEMA = TableSchema({**SCHEMA.properties, "quantity": "number"}, SCHEMA.required)
RUN_AT = dt.datetime(2001, 12, 31, tzinfo=dt.timezone.utc)

_NUMBER = "TRY_CAST(quantity AS DOUBLE)"
_BOOL = "lower(approved) IN ('true', '1', 'yes')"


@query("split_valid", "FLT-1", """
SELECT batch_id, ts, product_id IS NOT NULL AS is_valid FROM v_delivered""", ("v_delivered",))
def split_valid(spark, sf):
    good, bad = cleanse.split_valid(B.delivered(spark, sf).select("batch_id", "product_id", "ts"), SCHEMA)
    return (good.withColumn("is_valid", F.lit(True)).unionByName(bad.withColumn("is_valid", F.lit(False)))
            .drop("product_id"))


@query("schema_findings", "FLT-2 SET-2", """
SELECT concat('Unexpected columns (will be kept): [''cmo_id'', ''ts'', ''price'']') AS finding
UNION ALL SELECT concat(count(*), ' records have null values in required fields') FROM v_delivered
WHERE product_id IS NULL""", ("v_delivered",))
def schema_findings(spark, sf):
    return cleanse.schema_findings(B.delivered(spark, sf), SCHEMA)


@query("convert_types", "ETL-1 FN-1 FN-2", f"""
SELECT batch_id, ts, CASE WHEN {_NUMBER} = floor({_NUMBER}) THEN CAST({_NUMBER} AS BIGINT) END AS quantity,
  {_BOOL} AS approved, {_NUMBER} AS quantity_number FROM v_delivered""", ("v_delivered",))
def convert_types(spark, sf):
    raw = B.delivered(spark, sf).select("batch_id", "ts", "quantity", "approved", F.col("quantity").alias("quantity_number"))
    return cleanse.convert_types(raw, TableSchema({**SCHEMA.properties, "quantity_number": "number"}))


@query("fill_nulls", "ETL-2", f"""
SELECT batch_id, product_id, coalesce({_NUMBER}, 0.0::DOUBLE) AS quantity, coalesce({_BOOL}, false) AS approved,
  coalesce(note, 'none') AS note FROM v_delivered""", ("v_delivered",))
def fill_nulls(spark, sf):
    raw = B.delivered(spark, sf).select("batch_id", "product_id", "quantity", "approved", "note")
    return cleanse.fill_nulls(cleanse.convert_types(raw, NUMBER_SCHEMA), NUMBER_SCHEMA, {"note": "none"})


def _deduplicated(direction: str) -> str:
    return f"""
SELECT batch_id, cmo_id, ts, price, discount, tax FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts {direction}, price {direction}, cmo_id {direction},
    discount {direction}, tax {direction}) AS rn FROM v_batch_records) WHERE rn = 1"""


def _records(spark, sf):
    return B.batch_records(spark, sf).select("batch_id", "cmo_id", "ts", "price", "discount", "tax")


@query("deduplicate_last", "ETL-3", _deduplicated("DESC"), ("v_batch_records",))
def deduplicate_last(spark, sf):
    return cleanse.deduplicate(_records(spark, sf), ["batch_id"], ["ts", "price"], keep="last")


@query("deduplicate_first", "ETL-3", _deduplicated("ASC"), ("v_batch_records",))
def deduplicate_first(spark, sf):
    return cleanse.deduplicate(_records(spark, sf), ["batch_id"], ["ts", "price"], keep="first")


_SILVER = f"""SELECT batch_id, product_id, coalesce(CASE WHEN {_NUMBER} = floor({_NUMBER}) THEN CAST({_NUMBER} AS BIGINT) END, 0)
    AS quantity, coalesce({_BOOL}, false) AS approved, coalesce(note, '') AS note, cmo_id, ts, price
  FROM v_delivered WHERE product_id IS NOT NULL"""


@query("bronze_to_silver", "ETL-4 ETL-5 ETL-1 ETL-2 ETL-3", f"""
SELECT batch_id, product_id, quantity, approved, note, cmo_id, ts, price,
  '2001-12-31T00:00:00+00:00' AS _validation_timestamp FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id, note ORDER BY ts DESC, price DESC, product_id DESC, cmo_id DESC,
    quantity DESC, approved DESC) AS rn FROM ({_SILVER})) WHERE rn = 1""", ("v_delivered",))
def bronze_to_silver(spark, sf):
    return cleanse.bronze_to_silver(B.delivered(spark, sf), SCHEMA, ["batch_id", "note"], ["ts", "price"],
                                    at=RUN_AT).silver


@query("etl_metrics", "ETL-6", f"""
SELECT (SELECT count(*) FROM v_delivered) AS total_records, (SELECT count(*) FROM (SELECT DISTINCT batch_id, note FROM ({_SILVER}))) AS valid_records,
  (SELECT count(*) FROM v_delivered WHERE product_id IS NULL) AS invalid_records,
  (SELECT count(*) FROM v_delivered WHERE product_id IS NOT NULL)
    - (SELECT count(*) FROM (SELECT DISTINCT batch_id, note FROM ({_SILVER}))) AS duplicates_removed,
  1::BIGINT + (SELECT CASE WHEN count(*) > 0 THEN 1 ELSE 0 END FROM v_delivered WHERE product_id IS NULL)::BIGINT AS errors""", ("v_delivered",))
def etl_metrics(spark, sf):
    """The delivery has columns beyond its schema (one finding), and some products are null (another)."""
    return cleanse.etl_metrics(B.delivered(spark, sf), SCHEMA, ["batch_id", "note"])


@query("delivered_to_monthly_summary", "ETL-5 AGG-1 SRC-1", f"""
SELECT CAST(date_trunc('month', ts) AS DATE) AS period_start, cmo_id, count(*) AS record_count,
  sum(CAST(quantity AS DOUBLE)) AS quantity_sum, round(avg(CAST(quantity AS DOUBLE)), 4) AS quantity_avg FROM (
  SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY ts DESC, price DESC, product_id DESC, quantity DESC,
    approved DESC, note DESC, cmo_id DESC) AS rn FROM ({_SILVER})) WHERE rn = 1 GROUP BY 1, 2""", ("v_delivered",))
def delivered_to_monthly_summary(spark, sf):
    """Flagship: delivered text cells to a monthly summary per supplier, one lazy plan."""
    silver = cleanse.bronze_to_silver(B.delivered(spark, sf), SCHEMA, ["batch_id"], ["ts", "price"], at=RUN_AT).silver
    summary = gold.batch_summary(silver, "monthly", "ts")
    return summary.select("period_start", "cmo_id", "record_count", "quantity_sum",
                          F.round("quantity_avg", 4).alias("quantity_avg"))
