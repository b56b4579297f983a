"""Registered queries: gold summaries, filters, masking, isolation, sorting and set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.functions import paths as P
from tenantlake.functions import scalars as S
from tenantlake.operators import access, filters, gold, pii
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query

_REC = ("v_batch_records",)


def _summary(unit: str, period: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', ts) AS DATE) AS period_start, cmo_id, data_domain, count(*) AS record_count,
  sum(quantity) AS quantity_sum, round(avg(quantity), 4) AS quantity_avg, '{period}' AS aggregation_period
  FROM v_batch_records GROUP BY 1, 2, 3"""


def _rounded_summary(spark, sf, period):
    return gold.batch_summary(B.batch_records(spark, sf), period, "ts").withColumn(
        "quantity_avg", F.round("quantity_avg", 4))


@query("batch_summary_daily", "AGG-1 FN-3", _summary("day", "daily"), _REC)
def batch_summary_daily(spark, sf):
    return _rounded_summary(spark, sf, "daily")


@query("batch_summary_weekly", "AGG-1 FN-3", _summary("week", "weekly"), _REC)
def batch_summary_weekly(spark, sf):
    return _rounded_summary(spark, sf, "weekly")


@query("batch_summary_monthly", "AGG-1 FN-3 SRC-2", _summary("month", "monthly"), _REC)
def batch_summary_monthly(spark, sf):
    return _rounded_summary(spark, sf, "monthly")


@query("batch_summary_dirty_quantities", "AGG-1", """
SELECT CAST(date_trunc('month', ts) AS DATE) AS period_start, cmo_id, count(*) AS record_count,
  sum(coalesce(TRY_CAST(quantity AS DOUBLE), 0)) AS quantity_sum,
  round(avg(coalesce(TRY_CAST(quantity AS DOUBLE), 0)), 4) AS quantity_avg FROM v_delivered GROUP BY 1, 2""",
       ("v_delivered",))
def batch_summary_dirty_quantities(spark, sf):
    return gold.batch_summary(B.delivered(spark, sf), "monthly", "ts").select(
        "period_start", "cmo_id", "record_count", "quantity_sum", F.round("quantity_avg", 4).alias("quantity_avg"))


_TREND = """(SELECT CAST(date_trunc('month', ts) AS DATE) AS period_start, cmo_id, count(*) AS total_records,
  count(*) FILTER (WHERE quality_status = 'PASS') AS pass_count,
  count(*) FILTER (WHERE quality_status <> 'PASS') AS fail_count,
  round_even(count(*) FILTER (WHERE quality_status = 'PASS') / count(*) * 100::DOUBLE * 100, 0) / 100 AS pass_rate
  FROM v_batch_records GROUP BY 1, 2)"""
_SCORE = """(SELECT cmo_id, count(*) AS total_records, count(DISTINCT data_domain) AS domain_count,
  count(*) FILTER (WHERE quality_status = 'PASS') AS pass_count,
  count(*) FILTER (WHERE quality_status <> 'PASS') AS fail_count,
  round_even(count(*) FILTER (WHERE quality_status = 'PASS') / count(*) * 100::DOUBLE * 100, 0) / 100 AS pass_rate,
  round(avg(quantity), 4) AS avg_quantity FROM v_batch_records GROUP BY 1)"""


def _trend(spark, sf):
    return gold.quality_trend(B.batch_records(spark, sf), "monthly", "ts")


def _scorecard(spark, sf):
    return gold.supplier_scorecard(B.batch_records(spark, sf)).withColumn("avg_quantity", F.round("avg_quantity", 4))


@query("quality_trend_monthly", "AGG-2 FN-4 FN-5", f"SELECT *, 'monthly' AS aggregation_period FROM {_TREND}", _REC)
def quality_trend_monthly(spark, sf):
    return _trend(spark, sf)


@query("supplier_scorecard", "AGG-3", f"SELECT * FROM {_SCORE}", _REC)
def supplier_scorecard(spark, sf):
    return _scorecard(spark, sf)


@query("batch_volume_by_supplier", "AGG-5", "SELECT cmo_id, count(batch_id) AS batch_count FROM v_batch_records GROUP BY 1", _REC)
def batch_volume_by_supplier(spark, sf):
    return gold.batch_volume(B.batch_records(spark, sf))


@query("quantity_over_time", "AGG-6",
       "SELECT CAST(ts AS DATE) AS manufacture_date, sum(quantity) AS quantity_sum FROM v_batch_records GROUP BY 1", _REC)
def quantity_over_time(spark, sf):
    return gold.quantity_over_time(B.batch_records(spark, sf).withColumn("manufacture_date", F.col("ts").cast("date")))


@query("status_distribution", "AGG-7",
       "SELECT quality_status, count(*) AS record_count FROM v_batch_records GROUP BY 1", _REC)
def status_distribution(spark, sf):
    return gold.status_distribution(B.batch_records(spark, sf))


@query("average_pass_rate", "AGG-8", f"SELECT round(avg(pass_rate), 6) AS avg_pass_rate FROM {_TREND}", _REC)
def average_pass_rate(spark, sf):
    return gold.average_pass_rate(_trend(spark, sf)).select(F.round("avg_pass_rate", 6).alias("avg_pass_rate"))


@query("failures_by_supplier", "AGG-9",
       f"SELECT cmo_id, CAST(sum(fail_count) AS BIGINT) AS fail_count FROM {_TREND} GROUP BY 1", _REC)
def failures_by_supplier(spark, sf):
    return gold.failures_by_supplier(_trend(spark, sf))


@query("pass_rate_trend", "AGG-10",
       f"SELECT period_start, round(avg(pass_rate), 6) AS avg_pass_rate FROM {_TREND} GROUP BY 1", _REC)
def pass_rate_trend(spark, sf):
    return gold.pass_rate_trend(_trend(spark, sf)).withColumn("avg_pass_rate", F.round("avg_pass_rate", 6))


@query("compliance_by_supplier", "AGG-11", f"""SELECT cmo_id, CAST(sum(total_records) AS BIGINT) AS total_records,
  avg(pass_rate) AS avg_pass_rate FROM {_SCORE} GROUP BY 1""", _REC)
def compliance_by_supplier(spark, sf):
    return gold.compliance_by_supplier(_scorecard(spark, sf))


@query("drill_down_supplier_domain", "AGG-12", """SELECT cmo_id, data_domain,
  CAST(grouping_id(cmo_id, data_domain) AS BIGINT) AS grouping_level, count(*) AS record_count,
  sum(quantity) AS quantity_sum FROM v_batch_records GROUP BY ROLLUP (cmo_id, data_domain)""", _REC)
def drill_down_supplier_domain(spark, sf):
    return gold.drill_down(B.batch_records(spark, sf), ["cmo_id", "data_domain"],
                           [F.count(F.lit(1)).alias("record_count"), F.sum("quantity").alias("quantity_sum")])


@query("dataset_batch_records", "AGG-14", """SELECT batch_id, cmo_id, p_name AS product_name,
  CAST(ts AS DATE) AS manufacture_date, quantity, quality_status, data_domain
  FROM v_batch_records LEFT JOIN part ON p_partkey = part_key""", _REC)
def dataset_batch_records(spark, sf):
    names = B.table(spark, sf, "part").select(F.col("p_partkey").alias("part_key"), F.col("p_name").alias("product_name"))
    rows = B.batch_records(spark, sf).join(names, "part_key", "left").withColumnRenamed("ts", "manufacture_date")
    return gold.dataset(rows, "batch-records").withColumn("manufacture_date", F.col("manufacture_date").cast("date"))


@query("dataset_quality_metrics", "AGG-14", f"SELECT * FROM {_TREND}", _REC)
def dataset_quality_metrics(spark, sf):
    return gold.dataset(_trend(spark, sf), "quality-metrics").withColumn("period_start", F.col("period_start").cast("date"))


@query("dataset_sla_compliance", "AGG-14",
       f"SELECT cmo_id, total_records, pass_rate, fail_count, avg_quantity, domain_count FROM {_SCORE}", _REC)
def dataset_sla_compliance(spark, sf):
    return gold.dataset(_scorecard(spark, sf), "sla-compliance")


@query("contract_counts", "AGG-16",
       "SELECT cmo_id, data_domain, count(*) AS contract_count FROM v_contracts GROUP BY 1, 2", ("v_contracts",))
def contract_counts(spark, sf):
    return gold.contract_counts(B.contracts(spark, sf))


@query("row_filter", "FLT-3",
       "SELECT batch_id, cmo_id, price FROM v_batch_records WHERE cmo_id = 'cmo-7'", _REC)
def row_filter(spark, sf):
    return filters.row_filter(B.batch_records(spark, sf), "cmo-7").select("batch_id", "cmo_id", "price")


@query("column_filter", "FLT-4 SET-3", "SELECT batch_id, cmo_id, data_domain, quantity FROM v_batch_records", _REC)
def column_filter(spark, sf):
    df = B.batch_records(spark, sf)
    hidden = ["quality_status", "ts", "price", "discount", "tax", "part_key"]
    return filters.column_filter(df, filters.without(df, hidden))


@query("combined_filter", "FLT-5", "SELECT batch_id, quantity FROM v_batch_records WHERE cmo_id = 'cmo-3'", _REC)
def combined_filter(spark, sf):
    return filters.combined_filter(B.batch_records(spark, sf), "cmo-3", ["batch_id", "quantity"])


@query("tenant_scope", "FLT-6", """SELECT 'tenant' AS role, contract_id, cmo_id FROM v_contracts WHERE cmo_id = 'cmo-5'
UNION ALL SELECT 'admin', contract_id, cmo_id FROM v_contracts
UNION ALL SELECT 'admin-one', contract_id, cmo_id FROM v_contracts WHERE cmo_id = 'cmo-9'""", ("v_contracts",))
def tenant_scope(spark, sf):
    rows = B.contracts(spark, sf).select("contract_id", "cmo_id")
    cases = [("tenant", {"cmo_id": "cmo-5"}, "cmo-9"), ("admin", {"is_admin": True}, None),
             ("admin-one", {"is_admin": True}, "cmo-9")]
    parts = [filters.tenant_scope(rows, who, asked).select(F.lit(role).alias("role"), "contract_id", "cmo_id")
             for role, who, asked in cases]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("keyed_lookups", "FLT-7 SRC-9", """SELECT 'product' AS kind, CAST(batch_id AS VARCHAR) AS id FROM v_batches WHERE product_id = 'P42'
UNION ALL SELECT 'status', CAST(batch_id AS VARCHAR) FROM v_batches WHERE status = 'submitted'
UNION ALL SELECT 'supplier', CAST(contract_id AS VARCHAR) FROM v_contracts WHERE cmo_id = 'cmo-6' AND status = 'active'""",
       ("v_batches", "v_contracts"))
def keyed_lookups(spark, sf):
    heads, con = B.batch_heads(spark, sf), B.contracts(spark, sf)
    out = None
    for kind, df, key in (("product", filters.by_product(heads, "P42"), "batch_id"),
                          ("status", filters.by_status(heads, "submitted"), "batch_id"),
                          ("supplier", filters.by_supplier_status(con, "cmo-6", "active"), "contract_id")):
        part = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"))
        out = part if out is None else out.unionByName(part)
    return out


@query("active_connections", "FLT-8 JOIN-5", """SELECT o_orderkey AS batch_id, c_custkey AS connection_id, concat('cmo-', o_custkey // 8) AS cmo_id
FROM orders JOIN customer ON c_custkey // 8 = o_custkey // 8 AND c_custkey % 4 NOT IN (0, 1)""")
def active_connections(spark, sf):
    """All batches with all active connections of their suppliers, who have eight at most."""
    return filters.active_connections(B.supplied_batches(spark, sf), B.connections(spark, sf)).select("batch_id", "connection_id", "cmo_id")


@query("active_connection_counts", "FLT-8 JOIN-5", """SELECT b.batch_id, b.cmo_id, coalesce(c.n, 0) AS connections, c.least AS first_connection
FROM v_batches b LEFT JOIN (SELECT cmo_id, count(*) AS n, min(contract_id) AS least FROM v_contracts WHERE status = 'active' GROUP BY 1) c
  ON c.cmo_id = b.cmo_id""", ("v_batches", "v_contracts"))
def active_connection_counts(spark, sf):
    """One row per batch over all contracts."""
    conns = B.contracts(spark, sf).select(F.col("contract_id").alias("connection_id"), "cmo_id", "status")
    return filters.active_connection_counts(B.batch_heads(spark, sf), conns)


@query("text_search", "FLT-9", """SELECT c_custkey, c_name FROM customer
WHERE contains(lower(c_name), '#00000001') OR contains(lower(c_mktsegment), 'build')""")
def text_search(spark, sf):
    return filters.text_search(B.table(spark, sf, "customer"), "BUILD", ["c_name", "c_mktsegment"]).unionByName(
        filters.text_search(B.table(spark, sf, "customer"), "#00000001", ["c_name", "c_mktsegment"])
    ).select("c_custkey", "c_name").distinct()


@query("standard_filters", "FLT-11", """SELECT batch_id, ts::DATE AS manufacture_date FROM v_batch_records
WHERE cmo_id = 'cmo-4' AND data_domain = 'quality-data' AND ts::DATE BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'""", _REC)
def standard_filters(spark, sf):
    rows = B.batch_records(spark, sf).withColumn("manufacture_date", F.col("ts").cast("date"))
    return filters.standard_filters(rows, "cmo-4", (dt.date(1996, 1, 1), dt.date(1999, 12, 31)), "quality-data").select(
        "batch_id", "manufacture_date")


# --- personal data ---

_TEXTS = """(SELECT 'doc' AS src, CAST(doc_id AS VARCHAR) AS id, text FROM documents
  UNION ALL SELECT 'page', CAST(page_id AS VARCHAR), html FROM pages)"""
_EMAIL = r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
_PHONE = r"(?:\+?1[\s\-]?)?(?:\(\d{3}\)|\d{3})[\s\-]?\d{3}[\s\-]?\d{4}"
_SSN = r"\b\d{3}-\d{2}-\d{4}\b"


def _texts(spark, sf):
    docs = B.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    pages = B.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("id"), F.col("html").alias("text"))
    return docs.unionByName(pages)


@query("detect_pii", "PII-1 FN-6", f"""
SELECT 'text' AS field, concat_ws(',', CASE WHEN bool_or(regexp_matches(text, '{_EMAIL}')) THEN 'EMAIL' END,
  CASE WHEN bool_or(regexp_matches(text, '{_PHONE}')) THEN 'PHONE' END,
  CASE WHEN bool_or(regexp_matches(text, '{_SSN}')) THEN 'SSN' END) AS pii_types FROM {_TEXTS}
UNION ALL SELECT 'contact_name', 'NAME'""")
def detect_pii(spark, sf):
    rows = _texts(spark, sf).select("text", F.lit("nobody").alias("contact_name"))
    return pii.detect_pii(rows).select("field", F.array_join("pii_types", ",").alias("pii_types"))


@query("pii_counts", "PII-2 FN-6", f"""
SELECT 'text' AS field, pii_type, CAST(sum(len(found)) AS BIGINT) AS hits, count(*) FILTER (WHERE len(found) > 0) AS rows_hit
FROM (SELECT 'EMAIL' AS pii_type, regexp_extract_all(text, '{_EMAIL}') AS found FROM {_TEXTS}
  UNION ALL SELECT 'PHONE', regexp_extract_all(text, '{_PHONE}') FROM {_TEXTS}
  UNION ALL SELECT 'SSN', regexp_extract_all(text, '{_SSN}') FROM {_TEXTS}) GROUP BY pii_type""")
def pii_counts(spark, sf):
    return pii.pii_counts(_texts(spark, sf).select("text"))


@query("mask_hash", "PII-3 FN-7", "SELECT c_custkey, sha256(c_name) AS c_name, c_mktsegment FROM customer")
def mask_hash(spark, sf):
    return pii.mask(B.table(spark, sf, "customer"), ["c_name", "absent"], "hash").select("c_custkey", "c_name", "c_mktsegment")


@query("mask_redact", "PII-4", """SELECT batch_id, ts, CASE WHEN note IS NOT NULL THEN '[REDACTED]' END AS note
FROM v_delivered""", ("v_delivered",))
def mask_redact(spark, sf):
    return pii.mask(B.delivered(spark, sf).select("batch_id", "ts", "note"), ["note"], "redact")


_PARTIAL = """CASE WHEN length({0}) <= 4 THEN repeat('*', length({0})) ELSE repeat('*', length({0}) - 4) || right({0}, 4) END"""


@query("mask_partial", "PII-5 FN-8", f"SELECT batch_id, ts, {_PARTIAL.format('product_id')} AS product_id FROM v_delivered",
       ("v_delivered",))
def mask_partial(spark, sf):
    return pii.mask(B.delivered(spark, sf).select("batch_id", "ts", "product_id"), ["product_id"], "partial")


@query("mask_by_classification", "PII-6", f"""SELECT contract_id, classification, CASE classification WHEN 'public' THEN contact_name
  WHEN 'internal' THEN {_PARTIAL.format('contact_name')} WHEN 'confidential' THEN sha256(contact_name) ELSE '[REDACTED]' END
  AS contact_name FROM v_contracts""", ("v_contracts",))
def mask_by_classification(spark, sf):
    rows = B.contracts(spark, sf).select("contract_id", "classification", "contact_name")
    return pii.mask_by_classification(rows, "classification", ["contact_name"])


@query("mask_for_contract", "PII-7", "SELECT s_suppkey, sha256(s_name) AS s_name, sha256(CAST(s_nationkey AS VARCHAR)) AS s_nationkey FROM supplier")
def mask_for_contract(spark, sf):
    contract = {"governance": {"dataClassification": "confidential", "piiFields": ["s_name", "s_nationkey"]}}
    return pii.mask_for_contract(B.table(spark, sf, "supplier").drop("s_acctbal"), contract)


@query("pii_findings", "PII-8", """
SELECT CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE concat('f', doc_id) END AS field_name,
  CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' ELSE 'PERSONAL' END AS pii_type,
  CASE WHEN doc_id % 2 = 0 THEN 'Medium' ELSE 'High' END AS severity,
  CASE WHEN doc_id % 7 = 0 THEN 0 ELSE n_chars END AS count FROM documents""")
def pii_findings(spark, sf):
    key = F.col("doc_id")
    hit = F.struct(F.when(key % 5 != 0, F.concat(F.lit("f"), key.cast("string"))).alias("name"),
                   F.when(key % 7 != 0, F.col("n_chars")).alias("count"))
    group = F.struct(F.when(key % 3 != 0, "PERSONAL").alias("category"), F.array(hit).alias("detections"))
    finding = F.struct(
        F.struct(F.when(key % 2 != 0, "High").alias("description")).alias("severity"),
        F.struct(F.struct(F.array(group).alias("sensitiveData")).alias("result")).alias("classificationDetails"))
    return pii.flatten_findings(B.table(spark, sf, "documents").select(F.array(finding).alias("findings")))


# --- isolation ---

@query("isolation_views", "ACL-2", """SELECT 'batch' AS source, batch_id AS id FROM v_batch_records WHERE cmo_id = 'cmo-11'
UNION ALL SELECT 'contract', CAST(contract_id AS VARCHAR) FROM v_contracts WHERE cmo_id = 'cmo-11'""",
       ("v_batch_records", "v_contracts"))
def isolation_views(spark, sf):
    views = access.isolation_views("cmo-11", {"batch_records": (B.batch_records(spark, sf), ["price"]),
                                              "contract_list": (B.contracts(spark, sf), ["contact_name"])})
    batch, contract = spark.table(views["batch_records"]["combined"]), spark.table(views["contract_list"]["combined"])
    return batch.select(F.lit("batch").alias("source"), F.col("batch_id").alias("id")).unionByName(
        contract.select(F.lit("contract").alias("source"), F.col("contract_id").cast("string").alias("id")))


@query("row_level_security", "ACL-6 JOIN-9", """SELECT batch_id, cmo_id, price FROM v_batch_records
WHERE cmo_id IN (SELECT cmo_id FROM v_supplier WHERE nation_key % 5 = 2)""", ("v_batch_records", "v_supplier"))
def row_level_security(spark, sf):
    rules = B.suppliers(spark, sf).select(
        F.concat(F.lit("user-"), (F.col("nation_key") % 5).cast("string")).alias("user_name"), "cmo_id")
    return access.rls_join(B.batch_records(spark, sf).select("batch_id", "cmo_id", "price"), rules, "user-2")


_GRANTS = """(SELECT cmo_id, concat('role-', cmo_id) AS principal, 'SELECT' AS permission,
  CASE WHEN contract_id % 17 = 0 THEN 'cmo_other_silver' ELSE concat(replace(cmo_id, '-', '_'), '_', data_domain, '_silver') END
  AS table_name FROM v_contracts)"""


def _grants(spark, sf):
    name = F.when(F.col("contract_id") % 17 == 0, "cmo_other_silver").otherwise(
        P.table_name(F.col("cmo_id"), F.col("data_domain")))
    return B.contracts(spark, sf).select("cmo_id", F.concat(F.lit("role-"), F.col("cmo_id")).alias("principal"),
                                         F.lit("SELECT").alias("permission"), name.alias("table_name"))


@query("isolation_violations", "ACL-3 FN-16", f"""SELECT cmo_id, principal, table_name, permission,
  concat('Table does not belong to ', cmo_id) AS reason FROM {_GRANTS} WHERE NOT starts_with(table_name, replace(cmo_id, '-', '_') || '_')""",
       ("v_contracts",))
def isolation_violations(spark, sf):
    return access.isolation_violations(_grants(spark, sf))


@query("isolation_verdicts", "ACL-3", f"""SELECT cmo_id, principal, count(*) AS permissions_checked,
  count(*) FILTER (WHERE NOT starts_with(table_name, replace(cmo_id, '-', '_') || '_')) AS violations,
  count(*) FILTER (WHERE NOT starts_with(table_name, replace(cmo_id, '-', '_') || '_')) = 0 AS passed FROM {_GRANTS} GROUP BY 1, 2""",
       ("v_contracts",))
def isolation_verdicts(spark, sf):
    return access.verify_isolation(_grants(spark, sf))


@query("grants_after_revoke", "ACL-1", f"""SELECT DISTINCT principal, 'data_lake' AS database, table_name, permission FROM {_GRANTS}
WHERE table_name <> 'cmo_other_silver'""", ("v_contracts",))
def grants_after_revoke(spark, sf):
    entries = _grants(spark, sf).select("principal", F.lit("data_lake").alias("database"), "table_name", "permission")
    granted = access.grant(entries, entries)
    return access.revoke(granted, entries.where(F.col("table_name") == "cmo_other_silver"))


def _user_grants(spark, sf, customers):
    """Users are granted a tenant's table; the view they share shows the tenant's rows."""
    tables = {"batch_records": (B.batch_records(spark, sf), ["price"])}
    users = customers.select(F.concat(F.lit("role-"), F.col("c_custkey").cast("string")).alias("principal"))
    grants, views = access.grant_users("cmo-3", users, tables, spark.createDataFrame([], access.GRANTS_DDL))
    seen = spark.table(views["batch_records"]["combined"]).agg(F.count(F.lit(1)).alias("n"))
    items = grants.select(F.lit("grant").alias("kind"), F.concat_ws(
        "|", "principal", F.coalesce("table_name", F.lit("")), "permission").alias("item"), F.lit(1).cast("bigint").alias("n"))
    return items.unionByName(seen.select(F.lit("rows").alias("kind"), F.lit("cmo-3").alias("item"), "n"))


@query("user_grant_and_views", "ACL-5 ACL-1", """SELECT 'grant' AS kind, concat('role-', c_custkey, '|', t, '|', p) AS item, CAST(1 AS BIGINT) AS n
FROM (SELECT DISTINCT c_custkey FROM customer), (VALUES ('', 'DESCRIBE'), ('batch_records', 'SELECT'), ('batch_records', 'DESCRIBE')) v(t, p)
UNION ALL SELECT 'rows', 'cmo-3', count(*) FROM v_batch_records WHERE cmo_id = 'cmo-3'""", ("v_batch_records",))
def user_grant_and_views(spark, sf):
    return _user_grants(spark, sf, B.table(spark, sf, "customer"))


@query("views_after_revoke", "ACL-4", """SELECT CASE WHEN cmo_id = 'cmo-1' THEN 'revoked' ELSE 'kept' END AS state, count(*) AS n
FROM v_batch_records WHERE cmo_id IN ('cmo-1', 'cmo-2') GROUP BY 1""", ("v_batch_records",))
def views_after_revoke(spark, sf):
    """Two tenants get views and one loses them; its rows are counted before, the other's after."""
    tables = {"batch_lines": (B.batch_records(spark, sf), ["price"])}
    gone, kept = access.isolation_views("cmo-1", tables), access.isolation_views("cmo-2", tables)
    before = spark.table(gone["batch_lines"]["row"]).groupBy(F.lit("revoked").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    dropped = access.revoke_isolation(spark, "cmo-1", ["batch_lines"])
    if dropped != 3 or any(spark.catalog.tableExists(v) for v in gone["batch_lines"].values()):
        raise RuntimeError("views of a revoked tenant are still there")
    after = spark.table(kept["batch_lines"]["row"]).groupBy(F.lit("kept").alias("state")).agg(F.count(F.lit(1)).alias("n"))
    return before.unionByName(after)


@query("accessible_tables", "ACL-7", f"""SELECT DISTINCT 'data_lake' AS database, table_name FROM {_GRANTS} WHERE cmo_id = 'cmo-1'""",
       ("v_contracts",))
def accessible_tables(spark, sf):
    grants = _grants(spark, sf).select(F.concat(F.lit("arn:"), F.col("principal")).alias("principal"),
                                       F.lit("data_lake").alias("database"), "table_name", "permission")
    return access.accessible_tables(spark, grants, "arn:role-cmo-1")


# --- sorting and set operations ---

@query("sorted_board", "SRT-1", "SELECT contract_id, contact_name, balance FROM v_contracts ORDER BY balance DESC, contract_id", ("v_contracts",))
def sorted_board(spark, sf):
    return B.contracts(spark, sf).select("contract_id", "contact_name", "balance").orderBy(F.desc("balance"), "contract_id")


@query("page_of_contracts", "SRT-2", """SELECT contract_id, contact_name, (SELECT count(*) FROM v_contracts WHERE status = 'active') AS matches
FROM v_contracts WHERE status = 'active' ORDER BY contact_name, contract_id LIMIT 10 OFFSET 20""", ("v_contracts",))
def page_of_contracts(spark, sf):
    rows = B.contracts(spark, sf).where(F.col("status") == "active").select("contract_id", "contact_name")
    total = rows.agg(F.count(F.lit(1))).scalar()
    return filters.page(rows, ["contact_name", "contract_id"], number=3).withColumn("matches", total)


@query("newest_record_per_supplier", "SRT-6", """SELECT cmo_id, max(ts)::DATE AS newest_on,
  arg_max(batch_id, (ts, batch_id)) AS newest_batch FROM v_batch_records GROUP BY 1""", _REC)
def newest_record_per_supplier(spark, sf):
    return B.batch_records(spark, sf).groupBy("cmo_id").agg(
        F.max("ts").cast("date").alias("newest_on"), F.max_by("batch_id", F.struct("ts", "batch_id")).alias("newest_batch"))


@query("domain_union", "SET-5", """SELECT 'batch' AS source, batch_id, price, NULL AS status FROM v_batch_records
UNION ALL SELECT 'order', concat('O', batch_id), yield_value, status FROM v_batches""", ("v_batch_records", "v_batches"))
def domain_union(spark, sf):
    from tenantlake.sources.readers import union_domain

    first = B.batch_records(spark, sf).select(F.lit("batch").alias("source"), "batch_id", "price")
    second = B.batch_heads(spark, sf).select(
        F.lit("order").alias("source"), F.concat(F.lit("O"), F.col("batch_id").cast("string")).alias("batch_id"),
        F.col("yield_value").alias("price"), "status")
    return union_domain([first, second])


# --- scalar functions over whole tables ---

@query("scalar_functions", "FN-17 FN-18 FN-20 FN-21 FN-22 FN-23 FN-24", """
SELECT page_id, CASE WHEN contains(url, '.') THEN lower('.' || list_last(string_split(url, '.'))) ELSE '' END AS extension,
  list_last(string_split(url, '/')) AS file_name, regexp_replace(list_last(string_split(url, '/')), '\\.[^.]*$', '') AS stem,
  CAST(DATE '2001-01-31' + CAST(page_id % 90 AS INTEGER) AS DATE) AS due_on, CAST(page_id * 1000 + 7776000 AS BIGINT) AS ttl,
  CAST(page_id * 1000000 AS BIGINT) AS ms, starts_with(url, 'cmo-') AS is_tenant,
  contains(url, 'en') AS json_hit, CASE page_id % 3 WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' ELSE '2' END AS label,
  CASE WHEN page_id % 3 = 2 THEN 'none' ELSE concat('n', page_id % 3) END AS looked_up FROM pages""")
def scalar_functions(spark, sf):
    key, url = F.col("page_id"), F.col("url")
    code = (key % 3).cast("string")
    known = F.create_map(F.lit("0"), F.lit("n0"), F.lit("1"), F.lit("n1"))
    return B.table(spark, sf, "pages").select(
        "page_id", S.file_extension(url).alias("extension"), S.file_name(url).alias("file_name"),
        S.file_stem(url).alias("stem"), S.deadline(F.lit("2001-01-31"), key % 90).alias("due_on"),
        S.ttl_seconds(key * 1000000).alias("ttl"), S.epoch_ms(S.from_epoch_ms(key * 1000000)).alias("ms"),
        S.is_tenant_id(url).alias("is_tenant"), S.record_contains(["url"], "en").alias("json_hit"),
        S.label_of(code, {"0": "Zero", "1": "One"}).alias("label"), S.get_or(known, code, "none").alias("looked_up"))


@query("layer_paths", "FN-9 FN-10 FN-11 FN-12 FN-13", """
SELECT batch_id, concat('s3://lake/bronze/', cmo_id, '/', lower(status), '/year=', strftime(manufacturing_date, '%Y'), '/month=',
  strftime(manufacturing_date, '%m'), '/day=', strftime(manufacturing_date, '%d'), '/') AS bronze_path,
  concat('s3://lake/silver/', cmo_id, '/x/') AS silver_path,
  concat('s3://lake/silver/', cmo_id, '/', product_id, '/', batch_id, '/coa/') AS batch_path,
  concat('s3://lake/gold/', status, '/year=', strftime(manufacturing_date, '%Y'), '/month=',
  strftime(manufacturing_date, '%m'), '/day=', strftime(manufacturing_date, '%d'), '/') AS gold_path,
  concat('s3://lake/bronze/quarantine/', contract_id, '/', strftime(manufacturing_date, '%Y%m%d'), 'T000000/') AS quarantine_path,
  concat('s3://lake/bronze/', cmo_id, '/d/manual-review/year=', strftime(manufacturing_date, '%Y'), '/month=',
  strftime(manufacturing_date, '%m'), '/day=', strftime(manufacturing_date, '%d'), '/') AS review_path FROM v_batches""", ("v_batches",))
def layer_paths(spark, sf):
    day = F.col("manufacturing_date").cast("timestamp_ntz")
    cmo = F.col("cmo_id")
    return B.batch_heads(spark, sf).select(
        "batch_id", P.layer_path("lake", "bronze", cmo, F.col("status"), day).alias("bronze_path"),
        P.layer_path("lake", "silver", cmo, "x").alias("silver_path"),
        P.batch_path("lake", "silver", cmo, F.col("product_id"), F.col("batch_id").cast("string"), "coa").alias("batch_path"),
        P.gold_path("lake", F.col("status"), day).alias("gold_path"),
        P.quarantine_path("lake", F.col("contract_id").cast("string"), day).alias("quarantine_path"),
        P.review_path("lake", cmo, "d", day).alias("review_path"))


@query("parsed_paths", "FN-14 FN-15", """
SELECT concat('s3://lake/', path) AS full_path, 'lake' AS bucket, 'bronze' AS layer, tenant AS cmo_id, data_domain,
  CASE WHEN line NOT IN (1, 6) THEN '2001' END AS year, CASE WHEN line NOT IN (1, 6) THEN '05' END AS day,
  true AS is_bronze, false AS is_gold FROM v_manifest""", ("v_manifest",))
def parsed_paths(spark, sf):
    full = F.concat(F.lit("s3://lake/"), F.col("path"))
    files = B.manifest(spark, sf).select(full.alias("full_path"))
    checked = files.select("full_path", P.path_valid(F.col("full_path"), "bronze").alias("is_bronze"),
                           P.path_valid(F.col("full_path"), "gold").alias("is_gold"))
    return P.with_parsed_path(checked, "full_path", "p").select("full_path", "p.bucket", "p.layer", "p.cmo_id", "p.data_domain",
                         F.try_element_at("p.partitions", F.lit("year")).alias("year"),
                         F.try_element_at("p.partitions", F.lit("day")).alias("day"), "is_bronze", "is_gold")
