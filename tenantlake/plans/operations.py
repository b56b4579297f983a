"""Registered queries: batches and deadlines, service levels, failure tables, audit trail."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import audit, batches, failures, filters, gold, sla
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query

NOW = dt.datetime(1999, 6, 30)
EVENTS_NOW = dt.datetime(2024, 1, 31)
_NOW_SQL = "TIMESTAMP '1999-06-30'"
_BAT = ("v_batches",)
_ELEMENTS = ("bmr", "coa", "in_process", "yield")


def _now():
    return F.lit(NOW).cast("timestamp")


def _q(name: str) -> str:
    return f'"{name}"' if name == "yield" else name


_LONG = " UNION ALL ".join(
    f"SELECT batch_id, contract_id, cmo_id, status, manufacturing_date, {i} AS pos, '{e}' AS element_type, {_q(e)} AS received_at FROM v_batches"
    for i, e in enumerate(_ELEMENTS))
_MISSING = "concat_ws(',', " + ", ".join(f"CASE WHEN {_q(e)} IS NULL THEN '{e}' END" for e in _ELEMENTS) + ")"


@query("new_batches", "BAT-1", """
SELECT CASE WHEN c_mktsegment <> 'BUILDING' AND c_custkey % 9 <> 0
    THEN 'batch-' || left(sha256(concat_ws('|', concat('cmo-', c_custkey), c_name, c_mktsegment, '2001-01-01')), 12) END AS batch_id,
  c_name AS lot_number, 'in_progress' AS status, 4 AS n_elements, 'bmr,coa,in_process,yield' AS missing,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 'Missing required fields: product_id'
    WHEN c_custkey % 9 = 0 THEN 'user must be linked to an organization' END AS error FROM customer""")
def new_batches(spark, sf):
    c = B.table(spark, sf, "customer")
    requests = c.select(
        F.col("c_name").alias("lot_number"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("product_id"),
        F.lit("2001-01-01").alias("manufacturing_date"),
        F.when(F.col("c_custkey") % 9 != 0, F.concat(F.lit("cmo-"), F.col("c_custkey").cast("string"))).alias("cmo_id"))
    return batches.new_batches(requests, _now()).select(
        "batch_id", "lot_number", "status", F.size("data_elements").alias("n_elements"),
        F.array_join("missing_elements", ",").alias("missing"), "error")


@query("apply_receipts", "BAT-2 BAT-3", f"""
SELECT batch_id, {_MISSING} AS missing, bmr IS NOT NULL AND coa IS NOT NULL AND in_process IS NOT NULL AND "yield" IS NOT NULL AS is_complete,
  CAST(epoch(bmr) AS BIGINT) AS bmr_at, p.path AS coa_path
FROM v_batches LEFT JOIN (SELECT l_orderkey, arg_max(concat('bronze/', l_partkey, '/', l_suppkey),
    (l_shipdate, concat('bronze/', l_partkey, '/', l_suppkey))) AS path FROM lineitem WHERE l_linenumber = 2 GROUP BY 1) p
  ON p.l_orderkey = batch_id""", _BAT)
def apply_receipts(spark, sf):
    done = batches.apply_receipts(B.empty_batches(spark, sf), B.receipts(spark, sf))
    items = F.col("data_elements")
    return done.select("batch_id", F.array_join("missing_elements", ",").alias("missing"), "is_complete",
                       F.unix_timestamp(items[0]["received_at"]).alias("bmr_at"), items[1]["s3_path"].alias("coa_path"))


@query("optional_elements", "BAT-2 BAT-3", """SELECT batch_id, concat_ws(',', CASE WHEN deviation IS NOT NULL THEN 'deviation' END,
  CASE WHEN env_monitoring IS NOT NULL THEN 'env_monitoring' END, CASE WHEN equipment_logs IS NOT NULL THEN 'equipment_logs' END) AS optional,
  CAST(epoch(deviation) AS BIGINT) AS deviation_at FROM v_batches WHERE coalesce(deviation, env_monitoring, equipment_logs) IS NOT NULL""", _BAT)
def optional_elements(spark, sf):
    """Batches that receive elements beyond the four required ones."""
    done = batches.apply_receipts(B.empty_batches(spark, sf), B.receipts(spark, sf))
    extra = F.filter("data_elements", lambda e: ~e["element_type"].isin(*batches.REQUIRED_ELEMENTS))
    first = F.get(F.filter(extra, lambda e: e["element_type"] == "deviation"), F.lit(0))["received_at"]
    return done.where(F.size(extra) > 0).select(
        "batch_id", F.array_join(F.transform(extra, lambda e: e["element_type"]), ",").alias("optional"),
        F.unix_timestamp(first).alias("deviation_at"))


@query("missing_elements", "BAT-3 FLT-10", f"""SELECT batch_id, {_MISSING} AS missing FROM v_batches
WHERE bmr IS NULL OR coa IS NULL OR in_process IS NULL OR "yield" IS NULL""", _BAT)
def missing_elements(spark, sf):
    return filters.has_missing(B.batches(spark, sf)).select("batch_id", F.array_join("missing_elements", ",").alias("missing"))


_LATE = f"""(SELECT e.batch_id, e.pos, e.element_type, e.status, received_at IS NULL AND e.status = 'in_progress' AND
  coalesce({_NOW_SQL} > manufacturing_date + CAST(CASE e.pos WHEN 0 THEN bmr_days WHEN 1 THEN coa_days WHEN 2 THEN in_process_days ELSE yield_days END AS INTEGER), false) AS late
  FROM ({_LONG}) e LEFT JOIN v_contracts c ON c.contract_id = e.contract_id)"""
_OVERDUE = ("v_batches", "v_contracts")


def _flagged(spark, sf):
    return batches.flag_overdue(B.batches(spark, sf), B.contract_slas(spark, sf), _now())


@query("overdue_elements", "BAT-4 JOIN-1 JOIN-2 FN-17 FN-24",
       f"SELECT batch_id, element_type FROM {_LATE} WHERE late", _OVERDUE)
def overdue_elements(spark, sf):
    late = F.filter("data_elements", lambda e: e["overdue"])
    return _flagged(spark, sf).select("batch_id", F.explode(late).alias("e")).select("batch_id", "e.element_type")


@query("overdue_counts", "BAT-4", f"""SELECT (SELECT count(*) FROM v_batches WHERE status = 'in_progress') AS checked,
  count(*) FILTER (WHERE late) AS flagged FROM {_LATE}""", _OVERDUE)
def overdue_counts(spark, sf):
    return batches.overdue_counts(_flagged(spark, sf))


@query("overdue_batches", "FLT-10", f"SELECT DISTINCT batch_id FROM {_LATE} WHERE late", _OVERDUE)
def overdue_batches(spark, sf):
    return filters.has_overdue(_flagged(spark, sf)).select("batch_id")


@query("dashboard_counters", "AGG-13", f"""SELECT (SELECT count(*) FROM v_batches) AS total_batches,
  (SELECT count(DISTINCT batch_id) FROM {_LATE} WHERE late) AS overdue_batches,
  (SELECT count(*) FROM v_batches WHERE {_MISSING} <> '') AS incomplete_batches,
  (SELECT count(*) FROM v_contracts WHERE status = 'active') AS active_contracts""", _OVERDUE)
def dashboard_counters(spark, sf):
    return gold.dashboard_counters(_flagged(spark, sf), B.contracts(spark, sf))


_RECEIVED = "(" + " + ".join(f"({_q(e)} IS NOT NULL)::INT" for e in _ELEMENTS) + ")"


@query("batch_completeness", "BAT-5", f"""SELECT batch_id, CAST({_RECEIVED} AS INTEGER) AS received_count,
  CASE {_RECEIVED} WHEN 4 THEN 'green' WHEN 0 THEN 'red' ELSE 'blue' END AS completeness_band FROM v_batches""", _BAT)
def batch_completeness(spark, sf):
    return batches.completeness(B.batches(spark, sf)).select("batch_id", "received_count", "completeness_band")


@query("submit_outcomes", "BAT-6", """SELECT batch_id, status = 'in_progress' AS accepted,
  CASE WHEN status IS NULL THEN concat('Batch ', batch_id, ' not found')
    WHEN status <> 'in_progress' THEN concat('Batch already submitted (status: ', status, ')') END AS error
FROM (SELECT DISTINCT l_orderkey + 3 AS batch_id FROM lineitem) LEFT JOIN v_batches USING (batch_id)""".replace(
    "status = 'in_progress' AS accepted", "coalesce(status = 'in_progress', false) AS accepted"), _BAT)
def submit_outcomes(spark, sf):
    ids = B.table(spark, sf, "lineitem").select((F.col("l_orderkey") + 3).alias("batch_id"))
    return batches.submit(B.batch_heads(spark, sf), ids, _now())[1]


@query("submitted_batches", "BAT-6", """SELECT batch_id, CASE WHEN status = 'in_progress' AND batch_id IN
  (SELECT l_orderkey + 3 FROM lineitem) THEN 'submitted' ELSE status END AS status FROM v_batches""", _BAT)
def submitted_batches(spark, sf):
    ids = B.table(spark, sf, "lineitem").select((F.col("l_orderkey") + 3).alias("batch_id"))
    return batches.submit(B.batch_heads(spark, sf), ids, _now())[0].select("batch_id", "status")


_LABEL = " ".join(f"WHEN '{e}' THEN '{t}'" for e, t in batches.ELEMENT_LABELS.items())


@query("batch_board", "BAT-7 JOIN-3 FN-23", f"""
WITH late AS (SELECT batch_id, string_agg(CASE element_type {_LABEL} END, ', ' ORDER BY pos) AS names FROM {_LATE} WHERE late GROUP BY 1),
gone AS (SELECT batch_id, string_agg(CASE element_type {_LABEL} END, ', ' ORDER BY pos) AS names FROM ({_LONG}) WHERE received_at IS NULL GROUP BY 1)
SELECT b.batch_id, lot_number, coalesce(organization_name, b.cmo_id) AS supplier, coalesce(product_name, b.product_id) AS product,
  manufacturing_date, concat({_RECEIVED}, '/4') AS completeness, CASE {_RECEIVED} WHEN 4 THEN 'green' WHEN 0 THEN 'red' ELSE 'blue' END AS completeness_band,
  coalesce(late.names, 'None') AS overdue, coalesce(gone.names, 'All received') AS missing
FROM v_batches b LEFT JOIN v_supplier s ON s.cmo_id = b.cmo_id LEFT JOIN v_product p ON p.product_id = b.product_id
LEFT JOIN late ON late.batch_id = b.batch_id LEFT JOIN gone ON gone.batch_id = b.batch_id""",
       ("v_batches", "v_contracts", "v_supplier", "v_product"))
def batch_board(spark, sf):
    return batches.batch_board(_flagged(spark, sf), B.suppliers(spark, sf), B.products(spark, sf))


def _files(spark, sf):
    from tenantlake.sources.readers import parse_keys

    return parse_keys(B.manifest(spark, sf))


_FILE_VIEWS = ("v_manifest", "v_contracts")


@query("delivered_file_status", "BAT-8 JOIN-12 SRT-6", """
SELECT contract_id, c.cmo_id, c.data_domain, coalesce(n, 0) AS total_files, list_last(string_split(newest.path, '/')) AS last_file,
  newest.size AS last_size, newest.modified::DATE AS last_received_on, CASE WHEN n IS NULL THEN 'No files received yet' END AS message
FROM v_contracts c LEFT JOIN (SELECT tenant, data_domain, count(*) AS n,
    max({'modified': modified, 'path': path, 'size': size}) AS newest FROM v_manifest WHERE line <> 1 GROUP BY 1, 2) f
  ON f.tenant = c.cmo_id AND f.data_domain = c.data_domain WHERE connection_type = 'secure-transfer'""", _FILE_VIEWS)
def delivered_file_status(spark, sf):
    status = batches.file_status(_files(spark, sf), B.contracts(spark, sf))
    return status.withColumn("last_received_on", F.col("last_received_at").cast("date")).drop("last_received_at")


@query("document_status", "BAT-9", """
SELECT contract_id, coalesce(processed, 0) AS total_processed, coalesce(review, 0) AS manual_review_pending,
  newest.modified::DATE AS last_processed_on, list_last(string_split(newest.path, '/')) AS last_document
FROM v_contracts c LEFT JOIN (SELECT tenant, data_domain, count(*) FILTER (WHERE line <> 6) AS processed,
    count(*) FILTER (WHERE line = 6) AS review, max({'modified': modified, 'path': path}) FILTER (WHERE line <> 6) AS newest
  FROM v_manifest WHERE ends_with(path, '.json') GROUP BY 1, 2) f
  ON f.tenant = c.cmo_id AND f.data_domain = c.data_domain WHERE connection_type = 'ai-unstructured'""", _FILE_VIEWS)
def document_status(spark, sf):
    status = batches.document_status(_files(spark, sf), B.contracts(spark, sf))
    return status.withColumn("last_processed_on", F.col("last_processed_at").cast("date")).drop("last_processed_at")


@query("latest_run", "BAT-10", """
SELECT contract_id, execution_id, status AS last_status, execution_time_seconds AS last_duration, records_processed AS rows_extracted,
  CASE WHEN execution_id IS NULL THEN 'Connection active. No runs yet.' END AS message
FROM (SELECT contract_id FROM v_contracts) c LEFT JOIN (SELECT * FROM v_executions
  QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY ts DESC, execution_id DESC) = 1) e USING (contract_id)""",
       ("v_contracts", "v_executions"))
def latest_run(spark, sf):
    return batches.latest_run(B.executions(spark, sf), B.contracts(spark, sf)).drop("last_started_at")


@query("pipeline_board", "BAT-11", """SELECT contract_id, status, coalesce(run, status) AS resolved_status FROM v_contracts
LEFT JOIN (SELECT contract_id, arg_max(status, (ts, execution_id)) AS run FROM v_executions GROUP BY 1) USING (contract_id)""",
       ("v_contracts", "v_executions"))
def pipeline_board(spark, sf):
    runs = batches.latest_run(B.executions(spark, sf)).select("contract_id", F.col("last_status").alias("status"))
    return batches.pipeline_board(B.contracts(spark, sf).select("contract_id", "status"), runs)


@query("contract_connections", "JOIN-4", """SELECT contract_id, s_suppkey AS connection_id, CASE WHEN s_suppkey % 2 = 0 THEN 'native-connector'
  WHEN s_suppkey IS NOT NULL THEN 'secure-transfer' END AS connection_type, s_name AS connection_name
FROM v_contracts LEFT JOIN supplier ON s_suppkey = contract_id""".replace("s_suppkey AS connection_id", "contract_id AS connection_id"), ("v_contracts",))
def contract_connections(spark, sf):
    conns = B.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("connection_id"), F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 2 == 0, "native-connector").otherwise("secure-transfer").alias("connection_type"))
    links = B.contracts(spark, sf).select("contract_id", F.col("contract_id").alias("connection_id"))
    return batches.contract_connections(links, conns)


@query("file_lots", "JOIN-6", """SELECT path, coalesce(lot_number, CAST(order_key AS VARCHAR)) AS lot FROM v_manifest
LEFT JOIN (SELECT * FROM v_batches WHERE batch_id % 2 = 0) ON batch_id = order_key WHERE line = 1""", ("v_manifest", "v_batches"))
def file_lots(spark, sf):
    known = B.batch_heads(spark, sf).where(F.col("batch_id") % 2 == 0).select(
        F.col("batch_id").cast("string").alias("batch_id"), "lot_number")
    return batches.with_lot(_files(spark, sf).where("is_incoming"), known).select("path", "lot")


# --- service levels ---

_EXE = ("v_executions",)
_POINTS = """(SELECT ts, contract_id, cmo_id, 'ExecutionTime' AS metric, execution_time_seconds AS value, 'Seconds' AS unit FROM v_executions
  UNION ALL SELECT ts, contract_id, cmo_id, 'RecordsProcessed', CAST(records_processed AS DOUBLE), 'Count' FROM v_executions
  UNION ALL SELECT ts, contract_id, cmo_id, 'QualityScore', quality_score, 'Percent' FROM v_executions)"""


@query("pipeline_metrics", "SLA-1 SNK-8", f"SELECT CAST(epoch_us(ts) AS BIGINT) AS ts_us, contract_id, cmo_id, metric, value, unit FROM {_POINTS}", _EXE)
def pipeline_metrics(spark, sf):
    return sla.pipeline_metrics(B.executions(spark, sf)).withColumn(
        "ts_us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


_AVAIL = """(SELECT contract_id, count(*) AS total, count(*) FILTER (WHERE success) AS good,
  round_even(count(*) FILTER (WHERE success) / count(*) * 100::DOUBLE * 100, 0) / 100 AS rate FROM v_executions GROUP BY 1)"""


@query("availability", "SLA-2", f"""SELECT contract_id, coalesce(total, 0) AS total_executions, coalesce(good, 0) AS successful_executions,
  coalesce(rate, 100.0) AS success_rate, coalesce(rate, 100.0) AS uptime_percentage FROM v_contracts LEFT JOIN {_AVAIL} USING (contract_id)""",
       ("v_contracts", "v_executions"))
def availability(spark, sf):
    return sla.availability(B.executions(spark, sf), B.contracts(spark, sf))


@query("running_availability", "SLA-3", """SELECT execution_id, contract_id, n AS executions_so_far, good AS successes_so_far,
  round_even(good / n * 100::DOUBLE * 100, 0) / 100 AS success_rate FROM (SELECT execution_id, contract_id, count(*) OVER w AS n,
    CAST(sum(success::INT) OVER w AS BIGINT) AS good FROM v_executions
    WINDOW w AS (PARTITION BY contract_id ORDER BY ts, execution_id ROWS UNBOUNDED PRECEDING))""", _EXE)
def running_availability(spark, sf):
    rows = B.executions(spark, sf).select("execution_id", "contract_id", "ts", "success")
    return sla.running_availability(rows).drop("ts", "success")


@query("sla_compliance", "SLA-4", f"""
SELECT execution_id, contract_id, NOT late AS timeliness_ok, NOT poor AS quality_ok, NOT down AS availability_ok,
  NOT (late OR poor OR down) AS overall_compliant, late::INT + poor::INT + down::INT AS n_breaches,
  CASE WHEN late THEN round_even(execution_time_seconds / 3600 * 10000, 0) / 10000 END AS late_hours FROM (
  SELECT e.*, coalesce(execution_time_seconds / 3600 > max_delay_hours, false) AS late,
    coalesce(quality_score < min_quality_score, false) AS poor, coalesce(rate < c.uptime_percentage, false) AS down
  FROM v_executions e LEFT JOIN v_contracts c ON c.contract_id = e.contract_id LEFT JOIN {_AVAIL} a ON a.contract_id = c.contract_id)""",
       ("v_contracts", "v_executions"))
def sla_compliance(spark, sf):
    checked = sla.sla_compliance(B.executions(spark, sf), B.contracts(spark, sf))
    late = F.filter("breaches", lambda b: b["type"] == "timeliness")
    return checked.select("execution_id", "contract_id", "timeliness_ok", "quality_ok", "availability_ok", "overall_compliant",
                          F.size("breaches").alias("n_breaches"), F.try_element_at(late, F.lit(1))["actual"].alias("late_hours"))


def _series(spark, sf):
    return sla.metric_series(sla.pipeline_metrics(B.executions(spark, sf)))


_SERIES = f"""(SELECT metric, cmo_id, contract_id, CAST(floor(epoch(ts) / 300) AS BIGINT) * 300 AS slot, avg(value) AS value FROM {_POINTS} GROUP BY 1, 2, 3, 4)"""


@query("metric_series", "SLA-5", f"SELECT metric, cmo_id, contract_id, slot, round(value, 7) AS value FROM {_SERIES}", _EXE)
def metric_series(spark, sf):
    return _series(spark, sf).select("metric", "cmo_id", "contract_id",
                                     F.unix_timestamp(F.col("period_start").cast("timestamp")).alias("slot"),
                                     F.round("value", 7).alias("value"))


@query("latest_metric_value", "SLA-6", f"""SELECT metric, cmo_id, contract_id, max(slot) AS slot, round(arg_max(value, slot), 7) AS value
FROM {_SERIES} GROUP BY 1, 2, 3""", _EXE)
def latest_metric_value(spark, sf):
    return sla.latest_value(_series(spark, sf)).select(
        "metric", "cmo_id", "contract_id", F.unix_timestamp(F.col("period_start").cast("timestamp")).alias("slot"),
        F.round("value", 7).alias("value"))


def _alarm_sql(series: str, alarms, periods: int, seconds: int) -> str:
    rows = ", ".join(f"('{a.name}', '{a.severity}', '{a.metric}', {a.threshold}::DOUBLE, {str(a.above).lower()})" for a in alarms)
    return f"""SELECT alarm_name, severity, metric, cmo_id, contract_id, slot, round(value, 7) AS value, threshold FROM (
  SELECT *, slot - lag(slot, {periods - 1}) OVER (PARTITION BY alarm_name, metric, cmo_id, contract_id ORDER BY slot) AS span
  FROM {series} s JOIN (VALUES {rows}) AS a(alarm_name, severity, m, threshold, above) ON a.m = s.metric
  WHERE CASE WHEN above THEN value > threshold ELSE value < threshold END) WHERE span = {(periods - 1) * seconds}"""


HOUR = 3600
_BY_TENANT = f"""(SELECT metric, cmo_id, CAST(NULL AS BIGINT) AS contract_id, CAST(floor(epoch(ts) / {HOUR}) AS BIGINT) * {HOUR} AS slot,
  avg(value) AS value FROM (SELECT ts, metric, 'all' AS cmo_id, value FROM {_POINTS}
    UNION ALL SELECT ts, 'SuccessRate', 'all', success::INT * 100.0::DOUBLE FROM v_executions) GROUP BY 1, 2, 4)"""


def _hourly(spark, sf):
    """All suppliers together by the hour, so that consecutive periods exist in sparse data."""
    runs = B.executions(spark, sf)
    rate = runs.select("ts", F.lit("SuccessRate").alias("metric"), F.when(F.col("success"), 100.0).otherwise(0.0).alias("value"))
    points = sla.pipeline_metrics(runs).select("ts", "metric", "value").unionByName(rate)
    points = points.withColumns({"cmo_id": F.lit("all"), "contract_id": F.lit(None).cast("bigint")})
    return sla.metric_series(points, HOUR)


def _alarms(spark, sf, alarms, periods=3):
    fired = sla.evaluate_alarms(_hourly(spark, sf), alarms, periods, HOUR)
    return fired.select("alarm_name", "severity", "metric", "cmo_id", "contract_id",
                        F.unix_timestamp(F.col("period_start").cast("timestamp")).alias("slot"),
                        F.round("value", 7).alias("value"), "threshold")


_TIME_ALARMS = sla.execution_time_alarms(60.0)


@query("execution_time_alarms", "SLA-7 JOIN-11", _alarm_sql(_BY_TENANT, _TIME_ALARMS, 3, HOUR), _EXE)
def execution_time_alarms(spark, sf):
    return _alarms(spark, sf, _TIME_ALARMS)


@query("quality_score_alarms", "SLA-8", _alarm_sql(_BY_TENANT, sla.quality_score_alarms(), 3, HOUR), _EXE)
def quality_score_alarms(spark, sf):
    return _alarms(spark, sf, sla.quality_score_alarms())


@query("success_rate_alarms", "SLA-9", _alarm_sql(_BY_TENANT, sla.success_rate_alarms(), 3, HOUR), _EXE)
def success_rate_alarms(spark, sf):
    return _alarms(spark, sf, sla.success_rate_alarms())


@query("all_alarms", "SLA-10", _alarm_sql(_BY_TENANT, sla.all_alarms(60.0), 3, HOUR), _EXE)
def all_alarms(spark, sf):
    return _alarms(spark, sf, sla.all_alarms(60.0))


@query("sla_alerts", "SLA-11", f"""SELECT alert_type, severity, contract_id, cmo_id, count(*) AS n FROM (
  SELECT 'sla_' || kind AS alert_type, 'critical' AS severity, contract_id, cmo_id FROM (
  SELECT e.contract_id, e.cmo_id, unnest([CASE WHEN execution_time_seconds / 3600 > max_delay_hours THEN 'timeliness' END,
    CASE WHEN quality_score < min_quality_score THEN 'quality' END, CASE WHEN rate < c.uptime_percentage THEN 'availability' END]) AS kind
  FROM v_executions e JOIN v_contracts c ON c.contract_id = e.contract_id JOIN {_AVAIL} a ON a.contract_id = c.contract_id) WHERE kind IS NOT NULL)
GROUP BY 1, 2, 3, 4""", ("v_contracts", "v_executions"))
def sla_alerts(spark, sf):
    checked = sla.sla_compliance(B.executions(spark, sf), B.contracts(spark, sf))
    return sla.sla_alerts(checked, "critical", F.lit(EVENTS_NOW)).groupBy(
        "alert_type", "severity", "contract_id", "cmo_id").agg(F.count(F.lit(1)).alias("n"))


# --- failure tables ---

_ERR_NAME = """CASE event_id % 8 WHEN 0 THEN 'ConnectionError' WHEN 1 THEN 'ReadTimeoutError' WHEN 2 THEN 'ValueError'
  WHEN 3 THEN 'KeyError' WHEN 4 THEN 'SomeTimeout' ELSE 'Error' END"""
_ERR_TEXT = """CASE event_id % 8 WHEN 5 THEN concat('got invalidschema at ', event_id) WHEN 6 THEN concat('dnserror then timeout ', event_id)
  WHEN 7 THEN concat('auth credential refused ', event_id) ELSE concat('failure ', event_id) END"""
_ERRORS = f"""(SELECT *, CASE event_id % 8 WHEN 0 THEN 'network' WHEN 6 THEN 'network' WHEN 1 THEN 'timeout' WHEN 4 THEN 'timeout'
  WHEN 2 THEN 'validation' WHEN 5 THEN 'validation' ELSE 'unknown' END AS error_type FROM (
  SELECT event_id AS record_id, event_id, user_id AS contract_id, ts, {_ERR_NAME} AS error_name, {_ERR_TEXT} AS error_message FROM events))"""
_ACTION = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in failures.ACTIONS.items())


def _errors(spark, sf):
    e = B.table(spark, sf, "events")
    k, text = F.col("event_id") % 8, F.col("event_id").cast("string")
    name = (F.when(k == 0, "ConnectionError").when(k == 1, "ReadTimeoutError").when(k == 2, "ValueError").when(k == 3, "KeyError")
            .when(k == 4, "SomeTimeout").otherwise("Error"))
    message = (F.when(k == 5, F.concat(F.lit("got invalidschema at "), text)).when(k == 6, F.concat(F.lit("dnserror then timeout "), text))
               .when(k == 7, F.concat(F.lit("auth credential refused "), text)).otherwise(F.concat(F.lit("failure "), text)))
    return e.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("contract_id"), "ts",
                    name.alias("error_name"), message.alias("error_message"))


@query("classify_errors", "OPS-1 OPS-2", f"""SELECT record_id, error_type, error_type IN ('network', 'timeout') AS retryable,
  CASE error_type {_ACTION} END AS action FROM {_ERRORS}""")
def classify_errors(spark, sf):
    return failures.classify_errors(_errors(spark, sf)).select("record_id", "error_type", "retryable", "action")


def _queue(spark, sf):
    """Errors as a retry queue, some already tried or dead."""
    typed = failures.classify_errors(_errors(spark, sf))
    key = F.col("record_id")
    queued = failures.enqueue(typed, F.lit(EVENTS_NOW).cast("timestamp"))
    return (queued.withColumn("retry_count", (key % 5).cast("int"))
            .withColumn("ts", F.timestamp_seconds(key * 7 % 1000))
            .withColumn("status", F.when(key % 9 == 0, "dead_letter").when(key % 4 == 0, "processing").otherwise("queued")))


_QUEUE = f"""(SELECT record_id, error_type, error_message, CAST(record_id % 5 AS INTEGER) AS retry_count, record_id * 7 % 1000 AS queued_at,
  CASE WHEN record_id % 9 = 0 THEN 'dead_letter' WHEN record_id % 4 = 0 THEN 'processing' ELSE 'queued' END AS status FROM {_ERRORS})"""


@query("enqueue_failures", "OPS-3", f"SELECT record_id, error_type, error_message, 0 AS retry_count, 3 AS max_retries, 'queued' AS status FROM {_ERRORS}")
def enqueue_failures(spark, sf):
    typed = failures.classify_errors(_errors(spark, sf))
    return failures.enqueue(typed, F.lit(EVENTS_NOW).cast("timestamp")).select(
        "record_id", "error_type", "error_message", "retry_count", "max_retries", "status")


@query("advance_queue", "OPS-4", f"""SELECT record_id, retry_count + tried::INT AS retry_count,
  CASE WHEN NOT tried THEN 'untouched' WHEN retry_count + 1 > 3 THEN 'dead_letter' WHEN record_id % 2 = 0 THEN 'done' ELSE 'requeued' END AS disposition,
  CASE WHEN NOT tried THEN status WHEN retry_count + 1 > 3 THEN 'dead_letter' WHEN record_id % 2 = 0 THEN status ELSE 'queued' END AS status,
  CASE WHEN tried AND retry_count + 1 <= 3 AND record_id % 2 = 1 THEN 'again' ELSE error_message END AS error_message
FROM (SELECT *, record_id % 3 = 0 AS tried FROM {_QUEUE})""")
def advance_queue(spark, sf):
    queue = _queue(spark, sf)
    key = F.col("record_id")
    tried = queue.where(key % 3 == 0).select("queue_id", (key % 2 == 0).alias("success"),
                                             F.when(key % 2 == 1, "again").alias("error_message"))
    return failures.advance_queue(queue, tried).select("record_id", "retry_count", "disposition", "status", "error_message")


@query("take_queued", "SRT-5", f"""SELECT record_id, CASE WHEN status = 'queued' AND rn <= 25 THEN 'processing' ELSE status END AS status
FROM (SELECT *, row_number() OVER (PARTITION BY status ORDER BY queued_at, record_id) AS rn FROM {_QUEUE})""")
def take_queued(spark, sf):
    queue = _queue(spark, sf).withColumn("queue_id", F.lpad(F.col("record_id").cast("string"), 12, "0"))
    return failures.take_queued(queue, 25).select("record_id", "status")


@query("dead_letters", "OPS-11", f"SELECT record_id, error_type FROM {_QUEUE} WHERE status = 'dead_letter'")
def dead_letters(spark, sf):
    return failures.dead_letters(_queue(spark, sf)).select("record_id", "error_type")


@query("queue_stats", "AGG-15", f"""SELECT s.status, count(q.status) AS n FROM (VALUES ('queued'), ('processing'), ('dead_letter')) s(status)
LEFT JOIN {_QUEUE} q ON q.status = s.status GROUP BY 1""")
def queue_stats(spark, sf):
    return failures.queue_stats(_queue(spark, sf))


@query("backoff_delays", "OPS-5", f"""SELECT record_id, pow(2.0::DOUBLE, retry_count) * 0.5 AS wait, pow(2.0::DOUBLE, retry_count) AS wait_from_zero
FROM {_QUEUE}""")
def backoff_delays(spark, sf):
    retry = F.col("retry_count")
    return _queue(spark, sf).select("record_id", failures.backoff_seconds(retry + 1, 0.5).alias("wait"),
                                    failures.backoff_seconds(retry, zero_based=True).alias("wait_from_zero"))


@query("error_log", "OPS-6", f"""SELECT record_id, 'ERROR' AS severity, error_type, 'unknown' AS step, CASE error_type {_ACTION} END AS action
FROM {_ERRORS}""")
def error_log(spark, sf):
    log = failures.error_log(failures.classify_errors(_errors(spark, sf)).drop("action"), F.lit(EVENTS_NOW))
    return failures.error_logs(log).select("record_id", "severity", "error_type", "step", "action")


@query("idempotency_keys", "OPS-7", """SELECT event_id, sha256(concat('C', user_id, '|load|{"k": ', json_extract_string(props, '$.k'), ', "v": ', user_id, '}')) AS idempotency_key
FROM events""")
def idempotency_keys(spark, sf):
    e = B.table(spark, sf, "events")
    value = F.get_json_object("props", "$.k").cast("bigint")
    payload = failures.sorted_json(F.create_map(F.lit("v"), F.col("user_id"), F.lit("k"), value))
    return e.select("event_id", failures.idempotency_key(
        F.concat(F.lit("C"), F.col("user_id").cast("string")), F.lit("load"), payload).alias("idempotency_key"))


@query("pending_work", "OPS-8 JOIN-10", """
WITH ledger AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'P' THEN 'in_progress' ELSE 'failed' END AS status
  FROM orders WHERE o_orderkey % 5 <> 0 AND 1000 < o_orderkey % 2000)
SELECT l_orderkey AS order_key, l_linenumber AS line, CASE status WHEN 'in_progress' THEN 'conflict' WHEN 'failed' THEN 'retry' ELSE 'new' END AS verdict
FROM lineitem LEFT JOIN ledger ON k = l_orderkey WHERE status IS NULL OR status <> 'completed'""")
def pending_work(spark, sf):
    o = B.table(spark, sf, "orders").where(F.col("o_orderkey") % 5 != 0)
    status = F.when(F.col("o_orderstatus") == "O", "completed").when(F.col("o_orderstatus") == "P", "in_progress").otherwise("failed")
    ledger = o.select(F.col("o_orderkey").cast("string").alias("idempotency_key"), status.alias("status"),
                      F.lit(0.0).alias("created_at"), (F.col("o_orderkey") % 2000).alias("ttl"))
    work = B.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("idempotency_key"),
                                                 F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"))
    return failures.pending(work, ledger, F.lit(1000)).select("order_key", "line", "verdict")


@query("error_guidance", "OPS-10", f"""SELECT record_id, error_message || ' - ' || CASE WHEN contains(lower(error_message), 'timeout')
    THEN 'Try activating again. If the issue persists, check your network connectivity and contact support.'
  WHEN contains(lower(error_message), 'auth') THEN 'Verify your connection credentials are correct and have the required permissions.'
  WHEN contains(lower(error_message), 'schema') THEN 'Review your data contract schema definition and ensure it is valid.'
  ELSE 'Review the error details and try again. If the issue persists, contact support.' END AS guidance,
  error_message || ' - ' || CASE WHEN contains(error_message, 'timeout') THEN 'The request took too long. Check your network connection and try again.'
  WHEN contains(error_message, '401') THEN 'Your session may have expired. Please sign in again.'
  WHEN contains(error_message, '403') THEN 'You do not have permission to perform this action. Contact your administrator.'
  WHEN contains(error_message, '404') THEN 'The requested resource was not found. It may have been deleted or the ID is incorrect.'
  WHEN contains(error_message, '409') THEN 'A conflict occurred. The resource may have been modified by another user. Refresh and try again.'
  WHEN contains(error_message, '500') THEN 'An internal server error occurred. Please try again later or contact support.'
  WHEN contains(error_message, 'schema') THEN 'Review your input data for correctness and try again.'
  WHEN contains(error_message, 'auth') THEN 'Verify your credentials are correct and have the required permissions.'
  ELSE 'If this issue persists, please contact support.' END AS screen_text FROM {_ERRORS}""")
def error_guidance(spark, sf):
    text = F.col("error_message")
    return _errors(spark, sf).select("record_id", failures.error_guidance(text, " - ").alias("guidance"),
                                     failures.screen_guidance(text, " - ").alias("screen_text"))


# --- audit trail ---

_AUD = ("v_audit",)
START, END = dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20)
_IN = "event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'"
_T = "cmo-7"
_TOKEN = f"(^|[^A-Za-z0-9_-]){_T}([^A-Za-z0-9_-]|$)"
_TOUCH = f"(regexp_matches(cloud_trail_event, '{_TOKEN}') OR regexp_matches(resource_name, '{_TOKEN}'))"


@query("audit_rows", "AUD-1", """SELECT CASE WHEN event_id % 10 <> 0 THEN concat(event_type, '-', epoch_us(ts) // 1000) END AS event_id,
  CASE WHEN event_id % 10 <> 0 THEN concat('u', user_id) ELSE '' END AS user_id, props AS details,
  CASE WHEN event_id % 10 = 0 THEN 'event_type, user_id, action, and resource are required' END AS error FROM events""")
def audit_rows(spark, sf):
    e = B.table(spark, sf, "events")
    rows = e.select("event_type", F.when(F.col("event_id") % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string")))
                    .otherwise("").alias("user_id"), F.lit("Read").alias("action"), F.lit("r").alias("resource"), "ts",
                    F.col("props").alias("details"))
    return audit.audit_rows(rows).select("event_id", "user_id", "details", "error")


def _audit_out(df):
    return df.select("event_id", "event_name", "username", F.unix_micros(F.col("event_time").cast("timestamp")).alias("at"))


_AOUT = "event_id, event_name, username, CAST(epoch_us(event_time) AS BIGINT) AS at"


@query("audit_events_in_window", "AUD-2", f"SELECT {_AOUT} FROM v_audit WHERE {_IN} AND event_name = 'PutObject' AND resource_type = 'AWS::S3::Object'", _AUD)
def audit_events_in_window(spark, sf):
    return _audit_out(audit.query_events(B.audit_events(spark, sf), START, END,
                                         {"EventName": "PutObject", "ResourceType": "AWS::S3::Object"}))


@query("tenant_data_access", "AUD-3", f"SELECT {_AOUT} FROM v_audit WHERE {_IN} AND resource_type = 'AWS::S3::Object' AND {_TOUCH}", _AUD)
def tenant_data_access(spark, sf):
    return _audit_out(audit.data_access(B.audit_events(spark, sf), _T, START, END))


@query("user_action_report", "AUD-4 FN-22", f"SELECT {_AOUT} FROM v_audit WHERE {_IN} AND {_TOUCH}", _AUD)
def user_action_report(spark, sf):
    return _audit_out(audit.compliance_events(B.audit_events(spark, sf), "user_actions", _T, START, END))


@query("data_modification_report", "AUD-4", f"SELECT {_AOUT} FROM v_audit WHERE {_IN} AND event_name = 'PutObject' AND {_TOUCH}", _AUD)
def data_modification_report(spark, sf):
    return _audit_out(audit.compliance_events(B.audit_events(spark, sf), "data_modifications", _T, START, END))


_FIRST = f"""(SELECT * FROM v_audit WHERE {_IN} QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY event_time, event_name, username) = 1)"""


@query("comprehensive_report", "AUD-4 SET-1", f"SELECT {_AOUT} FROM {_FIRST} WHERE {_TOUCH}", _AUD)
def comprehensive_report(spark, sf):
    return _audit_out(audit.compliance_events(B.audit_events(spark, sf), "comprehensive", _T, START, END))


@query("merged_event_lists", "SET-1", f"""SELECT {_AOUT} FROM v_audit WHERE event_name = 'GetObject'
UNION ALL SELECT {_AOUT} FROM v_audit WHERE event_name <> 'GetObject' AND event_id NOT IN (SELECT event_id FROM v_audit WHERE event_name = 'GetObject')""", _AUD)
def merged_event_lists(spark, sf):
    events = B.audit_events(spark, sf)
    return _audit_out(audit.merge_events(events.where(F.col("event_name") == "GetObject"),
                                         events.where(F.col("event_name") != "GetObject")))


@query("user_audit_report", "AUD-5", f"SELECT {_AOUT} FROM v_audit WHERE {_IN} AND username = 'user-8'", _AUD)
def user_audit_report(spark, sf):
    return _audit_out(audit.user_report(B.audit_events(spark, sf), "user-8", START, END))


@query("audit_summary", "AUD-6", """SELECT count(*) AS total_events, count(DISTINCT username) AS unique_users,
  count(DISTINCT event_name) AS event_names FROM v_audit""", _AUD)
def audit_summary(spark, sf):
    return audit.report_summary(B.audit_events(spark, sf))


@query("audit_breakdown", "AUD-6", "SELECT event_name, count(*) AS n FROM v_audit GROUP BY 1", _AUD)
def audit_breakdown(spark, sf):
    return audit.event_breakdown(B.audit_events(spark, sf))


@query("audit_preview", "SRT-3", """SELECT event_id, event_name, username, (SELECT count(*) FROM v_audit) - 50 AS more_events
FROM v_audit ORDER BY event_time, event_id LIMIT 50""", _AUD)
def audit_preview(spark, sf):
    return audit.preview(B.audit_events(spark, sf)).drop("event_time")


_ACT = "CASE event_type WHEN 'view' THEN 'export_data' WHEN 'click' THEN 'delete_data' WHEN 'purchase' THEN 'approve_schema' ELSE 'browse' END"
_SIG = f"""(SELECT event_id, concat('u', user_id) AS user_id, {_ACT} AS action, concat('r', event_id % 20) AS resource, 'checked' AS intent,
  concat('2024-01-', lpad(CAST(event_id % 28 + 1 AS VARCHAR), 2, '0'), 'T00:00:00Z') AS timestamp_iso FROM events)"""
_HASH = "sha256(concat(user_id, action, resource, intent, timestamp_iso))"


def _unsigned(spark, sf):
    e = B.table(spark, sf, "events")
    kind = F.col("event_type")
    action = (F.when(kind == "view", "export_data").when(kind == "click", "delete_data")
              .when(kind == "purchase", "approve_schema").otherwise("browse"))
    day = F.lpad((F.col("event_id") % 28 + 1).cast("string"), 2, "0")
    return e.select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"), action.alias("action"),
                    F.concat(F.lit("r"), (F.col("event_id") % 20).cast("string")).alias("resource"), F.lit("checked").alias("intent"),
                    F.lit("password").alias("auth_method"), F.concat(F.lit("2024-01-"), day, F.lit("T00:00:00Z")).alias("timestamp_iso"))


@query("signatures", "AUD-8", f"""SELECT event_id, action, CASE WHEN action <> 'browse' THEN {_HASH} END AS content_hash,
  action = 'browse' AS refused FROM {_SIG}""")
def signatures(spark, sf):
    return audit.sign(_unsigned(spark, sf)).select("event_id", "action", "content_hash", F.col("error").isNotNull().alias("refused"))


@query("verified_signatures", "AUD-9", f"SELECT event_id, action <> 'browse' AND event_id % 6 <> 0 AS valid FROM {_SIG}")
def verified_signatures(spark, sf):
    signed = audit.sign(_unsigned(spark, sf))
    tampered = signed.withColumn("intent", F.when(F.col("event_id") % 6 == 0, "changed").otherwise(F.col("intent")))
    return audit.verify_signatures(tampered).select("event_id", "valid")


@query("signatures_on_resource", "AUD-10", f"""SELECT event_id, user_id, action FROM {_SIG} WHERE resource = 'r4' AND action <> 'browse'
  AND timestamp_iso BETWEEN '2024-01-03T00:00:00Z' AND '2024-01-20T00:00:00Z'""")
def signatures_on_resource(spark, sf):
    signed = audit.sign(_unsigned(spark, sf)).where(F.col("error").isNull())
    return audit.signatures_for(signed, "2024-01-03T00:00:00Z", "2024-01-20T00:00:00Z", resource="r4").select(
        "event_id", "user_id", "action")
