"""Registered queries: layers written and read back, retention, archive plans, metric and alert tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import access, failures, gold, quality, sla
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query
from tenantlake.session import scratch_path, stage
from tenantlake.sources import readers, sinks

DAY = dt.date(2001, 1, 5)
AT = dt.datetime(2001, 1, 5, 12, 30)
_REC = ("v_batch_records",)


@query("bronze_round_trip", "SNK-1 SRC-1", "SELECT batch_id, price, '05' AS day FROM v_batch_records", _REC)
def bronze_round_trip(spark, sf):
    root = scratch_path(spark, "lake")
    rows = B.batch_records(spark, sf).select("batch_id", "price", "discount")
    sinks.write_bronze(rows, root, "cmo-1", "batch-records", DAY)
    back = readers.read_bronze(spark, root, cmo_id="cmo-1", domain="batch-records", date=DAY)
    return back.select("batch_id", "price", F.lpad(F.col("day").cast("string"), 2, "0").alias("day"))


@query("silver_day_rewrite", "SNK-2 SNK-3 SRC-2", """SELECT data_domain, count(*) AS n, sum(quantity) AS quantity FROM v_batch_records
WHERE quality_status = 'PASS' GROUP BY 1""", _REC)
def silver_day_rewrite(spark, sf):
    """All rows written by domain, then the day written again with the passing rows only: the day is replaced."""
    root = scratch_path(spark, "lake")
    rows = B.batch_records(spark, sf).select("batch_id", "data_domain", "quantity", "quality_status")
    sinks.write_silver(rows, root, "cmo-1", None, DAY)
    sinks.write_silver(rows.where(F.col("quality_status") == "PASS"), root, "cmo-1", None, DAY)
    back = readers.read_silver(spark, root, cmo_id="cmo-1", date=DAY)
    return back.groupBy("data_domain").agg(F.count(F.lit(1)).alias("n"), F.sum("quantity").alias("quantity"))


@query("quarantined_rows", "SNK-4", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN product_id IS NULL THEN 'schema_validation_failure'
  ELSE 'quality_check_failure' END AS reason FROM v_delivered WHERE product_id IS NULL OR price < 5000) GROUP BY 1""", ("v_delivered",))
def quarantined_rows(spark, sf):
    root = scratch_path(spark, "lake")
    rows = B.delivered(spark, sf)
    path, _ = sinks.quarantine(rows.where(F.col("product_id").isNull()), root, "C-1", "schema_validation_failure", AT)
    sinks.quarantine(rows.where(F.col("product_id").isNotNull() & (F.col("price") < 5000)), root, "C-1", "quality_check_failure", AT)
    return spark.read.parquet(path).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _without(spark, database, df):
    """The rows, written, and the database they were read through dropped; its tables' files stay."""
    kept = stage(df, "listed")
    spark.sql(f"DROP DATABASE IF EXISTS `{database}` CASCADE")
    return kept


@query("gold_tables", "SNK-5 SNK-6 AGG-4", """SELECT 'batch_summary_daily_gold' AS table_name, count(*) AS n FROM (SELECT DISTINCT ts, cmo_id, data_domain FROM v_batch_records)
UNION ALL SELECT 'quality_metrics_monthly_gold', count(*) FROM (SELECT DISTINCT date_trunc('month', ts), cmo_id FROM v_batch_records)
UNION ALL SELECT 'cmo_performance_dashboard_gold', count(DISTINCT cmo_id) FROM v_batch_records""", _REC)
def gold_tables(spark, sf):
    from tenantlake.plans.flows import silver_to_gold

    root = scratch_path(spark, "lake")
    database = "lake_" + root.rsplit("-", 1)[1]
    done = silver_to_gold(B.batch_records(spark, sf), root, DAY, date_col="ts", database=database)
    out = None
    for name in done["tables_registered"]:
        rows = spark.table(f"`{database}`.`{name}`").agg(F.count(F.lit(1)).alias("n")).withColumn("table_name", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return _without(spark, database, out)


_KEYS = """(SELECT CASE l_linenumber WHEN 1 THEN 'bronze/x' WHEN 2 THEN 'silver/x' WHEN 3 THEN 'bronze/quarantine/x' WHEN 4 THEN 'audit-logs/x'
  WHEN 5 THEN 'query-results/x' WHEN 6 THEN 'quality-results/x' ELSE 'gold/x' END AS key, l_shipdate AS modified, l_orderkey AS order_key FROM lineitem)"""


@query("retention_classes", "SNK-10 JOIN-12", f"""
SELECT order_key, key, CAST(age AS INTEGER) AS age_days, CASE WHEN key = 'bronze/x' AND age >= 90 THEN 'archive' WHEN key = 'silver/x' AND age >= 180 THEN 'archive'
  WHEN key = 'bronze/quarantine/x' AND age >= 30 THEN 'expire' WHEN key = 'audit-logs/x' AND age >= 2555 THEN 'expire'
  WHEN key = 'query-results/x' AND age >= 30 THEN 'expire' WHEN key = 'quality-results/x' AND age >= 365 THEN 'expire' ELSE 'keep' END AS retention
FROM (SELECT *, date_diff('day', CAST(modified AS DATE), DATE '2001-12-31') AS age FROM {_KEYS})""")
def retention_classes(spark, sf):
    prefixes = ["bronze/x", "silver/x", "bronze/quarantine/x", "audit-logs/x", "query-results/x", "quality-results/x", "gold/x"]
    key = F.element_at(F.array(*[F.lit(p) for p in prefixes]), F.col("l_linenumber"))
    rows = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_key"), key.alias("key"), F.col("l_shipdate").alias("modified"))
    return sinks.classify_retention(rows, F.lit(dt.date(2001, 12, 31))).select("order_key", "key", "age_days", "retention")


@query("archive_plan", "SNK-7", """SELECT path, concat('bronze/', tenant, '/', data_domain, '/year=2001/month=01/day=05/', list_last(string_split(path, '/'))) AS bronze_key,
  concat('bronze/', tenant, '/', data_domain, '/archive/20010105T123000/', list_last(string_split(path, '/'))) AS archive_key FROM v_manifest WHERE line = 1""", ("v_manifest",))
def archive_plan(spark, sf):
    files = readers.parse_keys(B.manifest(spark, sf)).where("is_incoming")
    return sinks.archive_plan(files, F.lit(AT)).select("path", "bronze_key", "archive_key")


@query("metric_and_alert_tables", "SNK-8 SNK-9", """SELECT 'metrics' AS side, metric AS name, count(*) AS n FROM (SELECT unnest(['ExecutionTime', 'RecordsProcessed', 'QualityScore']) AS metric FROM v_executions) GROUP BY 2
UNION ALL SELECT 'alerts', 'deployment_failed', count(*) FROM v_executions WHERE NOT success""", ("v_executions",))
def metric_and_alert_tables(spark, sf):
    root = scratch_path(spark, "lake")
    runs = B.executions(spark, sf)
    sinks.append_metrics(sla.pipeline_metrics(runs), root)
    failed = runs.where(~F.col("success")).select("contract_id", "cmo_id", F.lit("Load").alias("step"), F.lit("boom").alias("error_message"))
    failed = failed.withColumn("contract_id", F.col("contract_id").cast("string"))
    sinks.append_alerts(failures.deployment_alerts(failed, F.lit(AT)), root)
    metrics = spark.read.parquet(f"{root}/metrics").groupBy(F.col("metric").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("metrics"))
    alerts = spark.read.parquet(f"{root}/alerts").groupBy(F.col("alert_type").alias("name")).agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("alerts"))
    return metrics.unionByName(alerts)


@query("gate_outcome", "QG-1 SNK-3 SNK-4", """SELECT 'promoted' AS outcome, count(*) AS n FROM v_delivered WHERE product_id IS NOT NULL
UNION ALL SELECT 'quarantined', count(*) FROM v_delivered WHERE product_id IS NULL""", ("v_delivered",))
def gate_outcome(spark, sf):
    from tenantlake.operators.cleanse import split_valid
    from tenantlake.operators.gate import gate
    from tenantlake.plans.cleansing import SCHEMA

    root = scratch_path(spark, "lake")
    good, bad = split_valid(B.delivered(spark, sf).drop("cmo_id"), SCHEMA)
    rules = [quality.QualityRule("r", "ids", "completeness", 'Completeness "batch_id"', 99.0)]
    report = quality.quality_report(quality.evaluate_rules(good, rules))
    done = gate(good, bad, report, root, "cmo-1", "batch-records", "C-1", AT)
    kept = spark.read.parquet(done.silver_path).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("promoted"))
    aside = spark.read.parquet(done.quarantine_path).agg(F.count(F.lit(1)).alias("n")).withColumn("outcome", F.lit("quarantined"))
    return kept.unionByName(aside)


@query("catalog_columns", "ACL-8 SNK-6", """SELECT 'quantity' AS column_name, 'double' AS data_type, false AS is_partition FROM (SELECT count(*) FROM lineitem)
UNION ALL SELECT 'batch_id', 'string', false UNION ALL SELECT 'day', 'string', true UNION ALL SELECT 'month', 'string', true UNION ALL SELECT 'year', 'string', true
UNION ALL SELECT NULL, 'unavailable', false""")
def catalog_columns(spark, sf):
    root = scratch_path(spark, "lake")
    database = "lake_" + root.rsplit("-", 1)[1]
    sinks.write_silver(B.batch_records(spark, sf).select("batch_id", "quantity"), root, "cmo-1", "batch-records", DAY)
    name = sinks.register_silver_table(spark, root, "cmo-1", "batch-records", database)
    listed = access.schema_context(spark, [(database, name), (database, "gone")])
    plain = F.when(F.col("is_partition"), "string").otherwise(F.col("data_type"))
    return _without(spark, database, listed.select("column_name", plain.alias("data_type"), "is_partition"))


@query("gold_datasets_from_silver", "AGG-4 AGG-14 SRC-2", """SELECT cmo_id, count(*) AS total_records, count(*) FILTER (WHERE quality_status <> 'PASS') AS fail_count
FROM v_batch_records GROUP BY 1""", _REC)
def gold_datasets_from_silver(spark, sf):
    root = scratch_path(spark, "lake")
    sinks.write_gold(gold.supplier_scorecard(B.batch_records(spark, sf)), root, "cmo-performance-dashboard", DAY)
    return gold.dataset(readers.read_gold(spark, root, "cmo-performance-dashboard"), "sla-compliance").select("cmo_id", "total_records", "fail_count")


@query("delivered_files_read_back", "SRC-6 SCH-10", """SELECT 'csv' AS fmt, batch_id, CASE WHEN quantity = floor(quantity) THEN CAST(quantity AS BIGINT) END AS quantity FROM v_batch_records
UNION ALL SELECT 'json', batch_id, CAST(quantity AS BIGINT) FROM v_batch_records UNION ALL SELECT 'parquet', batch_id, CAST(quantity AS BIGINT) FROM v_batch_records""", _REC)
def delivered_files_read_back(spark, sf):
    """The records delivered in each format and read with the registered schema."""
    from tenantlake.operators.schema import TableSchema

    root = scratch_path(spark, "delivered")
    rows = B.batch_records(spark, sf).select("batch_id", F.col("quantity").cast("bigint").alias("quantity"))
    rows.write.option("header", True).csv(f"{root}/csv")
    rows.write.json(f"{root}/json")
    rows.write.parquet(f"{root}/parquet")
    schema = TableSchema({"batch_id": "string", "quantity": "integer"}).struct_type()
    out = None
    for fmt in ("csv", "json", "parquet"):
        options = {"multi_line": False} if fmt == "json" else {}
        part = readers.read_delivered(spark, f"{root}/{fmt}", fmt, schema, **options).select(F.lit(fmt).alias("fmt"), "batch_id", "quantity")
        out = part if out is None else out.unionByName(part)
    return out


@query("load_runs_once", "OPS-9 SNK-1", "SELECT count(*) AS rows_loaded, sum(quantity) AS quantity FROM v_batch_records", _REC)
def load_runs_once(spark, sf):
    """The same append submitted twice under one key: the second run is skipped."""
    root = scratch_path(spark, "lake")
    ledger = failures.ledger_at(spark, f"{root}/ledger")
    rows = B.batch_records(spark, sf).select("batch_id", "quantity")
    for now in (1000.0, 1001.0):
        failures.run_once(spark, ledger, "cmo-1|batch-records", lambda: sinks.write_bronze(rows, root, "cmo-1", "batch-records", DAY), now)
    return readers.read_bronze(spark, root).agg(F.count(F.lit(1)).alias("rows_loaded"), F.sum("quantity").alias("quantity"))
