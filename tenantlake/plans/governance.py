"""Registered queries: schema inference and merging, contract validation, ids and status changes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import contracts, schema
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query
from tenantlake.session import scratch_path

NOW = dt.datetime(2001, 12, 31)

# --- schemas ---


def _infer_sql(table: str, columns: list[str]) -> str:
    """Type and requiredness of text columns, from all rows, in SQL."""
    parts = []
    for c in columns:
        v = f"trim(CAST({c} AS VARCHAR))"
        filled = f"({c} IS NOT NULL AND {v} <> '')"
        parts.append(f"""SELECT '{c}' AS field, CASE WHEN count(*) FILTER (WHERE {filled}) = 0 THEN 'string'
  WHEN bool_and(lower({v}) IN ('true', 'false', '0', '1')) FILTER (WHERE {filled}) THEN 'boolean'
  WHEN bool_and(regexp_full_match({v}, '[+-]?\\d+')) FILTER (WHERE {filled}) THEN 'integer'
  WHEN bool_and(regexp_full_match({v}, '[+-]?(\\d+(\\.\\d*)?|\\.\\d+)([eE][+-]?\\d+)?')) FILTER (WHERE {filled}) THEN 'number'
  ELSE 'string' END AS type, count(*) = count(*) FILTER (WHERE {filled}) AS required FROM {table}""")
    return " UNION ALL ".join(parts)


_DELIVERED_COLUMNS = ["batch_id", "product_id", "cmo_id", "quantity", "approved", "note", "price", "flag", "blank"]
_DELIVERED_TEXT = """(SELECT batch_id, product_id, cmo_id, quantity, approved, note, CAST(price AS VARCHAR) AS price,
  CASE WHEN price > 20000 THEN '1' ELSE ' 0 ' END AS flag, CASE WHEN price > 0 THEN ' ' END AS blank FROM v_delivered)"""


def _delivered_text(spark, sf):
    return B.delivered(spark, sf).select(
        "batch_id", "product_id", "cmo_id", "quantity", "approved", "note", F.col("price").cast("string").alias("price"),
        F.when(F.col("price") > 20000, "1").otherwise(" 0 ").alias("flag"), F.when(F.col("price") > 0, " ").alias("blank"))


@query("infer_csv_schema", "SCH-1 SCH-11", _infer_sql(_DELIVERED_TEXT, _DELIVERED_COLUMNS), ("v_delivered",))
def infer_csv_schema(spark, sf):
    return schema.infer_schema(_delivered_text(spark, sf), "CSV")


_JSON = """(SELECT event_id, CASE event_id % 4
  WHEN 0 THEN concat('{"k": ', event_id, ', "mixed": 1, "flag": true, "only": null, "both": 1}')
  WHEN 1 THEN concat('{"k": ', event_id, ', "mixed": "x", "flag": false, "both": 1.5}')
  WHEN 2 THEN concat('{"k": ', event_id, ', "mixed": [1], "flag": true, "list": [1, 2], "both": 2}')
  ELSE concat('{"k": ', event_id, ', "mixed": null, "flag": true, "nested": {"a": 1}, "both": 2.25}') END AS doc FROM events)"""


def _json_docs(spark, sf):
    key = F.col("event_id").cast("string")
    tails = [', "mixed": 1, "flag": true, "only": null, "both": 1}', ', "mixed": "x", "flag": false, "both": 1.5}',
             ', "mixed": [1], "flag": true, "list": [1, 2], "both": 2}', ', "mixed": null, "flag": true, "nested": {"a": 1}, "both": 2.25}']
    tail = F.element_at(F.array(*[F.lit(t) for t in tails]), (F.col("event_id") % 4 + 1).cast("int"))
    return B.table(spark, sf, "events").select(F.concat(F.lit('{"k": '), key, tail).alias("doc"), "event_id")


@query("infer_json_schema", "SCH-2 SCH-11", f"""
WITH kv AS (SELECT doc, unnest(json_keys(doc)) AS field FROM {_JSON}),
typed AS (SELECT field, CASE json_type(doc, '$.' || field) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number'
  WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' ELSE 'string' END AS kind FROM kv)
SELECT field, CASE WHEN count(DISTINCT kind) = 1 THEN any_value(kind)
  WHEN bool_and(kind IN ('integer', 'number')) THEN 'number' ELSE 'string' END AS type,
  count(*) = (SELECT count(*) FROM events) AS required FROM typed GROUP BY field""")
def infer_json_schema(spark, sf):
    return schema.infer_schema(_json_docs(spark, sf), "json", "doc")


@query("infer_json_event_props", "SCH-2", """SELECT 'k' AS field, 'integer' AS type, count(*) = count(json_extract(props, '$.k')) AS required FROM events""")
def infer_json_event_props(spark, sf):
    return schema.infer_json_schema(B.table(spark, sf, "events"), "props")


_ORDER_TEXT = ["o_orderkey", "o_orderstatus", "o_totalprice"]
_MERGE_SIDES = """(SELECT 'a' AS schema_id, field, type FROM (SELECT CASE field WHEN 'o_totalprice' THEN 'amount' WHEN 'o_orderkey' THEN 'key' ELSE 'status' END AS field, type FROM ({a}))
  UNION ALL SELECT 'b', CASE field WHEN 'c_custkey' THEN 'amount' WHEN 'c_name' THEN 'key' ELSE 'balance' END, type FROM ({b}))"""
_MERGED = _MERGE_SIDES.format(a=_infer_sql("orders", _ORDER_TEXT), b=_infer_sql("customer", ["c_custkey", "c_name", "c_acctbal"]))


@query("merge_schemas", "SCH-5 SET-4", f"""
SELECT field, CASE WHEN count(DISTINCT type) = 1 THEN any_value(type) WHEN bool_and(type IN ('integer', 'number')) THEN 'number'
  ELSE 'string' END AS type, count(DISTINCT schema_id) = 2 AS required FROM {_MERGED} GROUP BY field""")
def merge_schemas(spark, sf):
    o, c = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    first = o.select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"),
                     F.col("o_totalprice").cast("string").alias("amount"))
    second = c.select(F.col("c_custkey").cast("string").alias("amount"), F.col("c_name").alias("key"),
                      F.col("c_acctbal").cast("string").alias("balance"))
    fields = schema.infer_csv_schema(first).withColumn("schema_id", F.lit("a")).unionByName(
        schema.infer_csv_schema(second).withColumn("schema_id", F.lit("b")))
    return schema.merge_schemas(fields)


@query("schema_violations", "SCH-8", """
SELECT 'BACKWARD' AS mode, 'note' AS field, 'narrowed type' AS reason WHERE (SELECT count(*) FROM v_delivered) > 0
UNION ALL SELECT 'BACKWARD', 'product_id', 'removed required field' WHERE (SELECT count(*) FROM v_delivered WHERE product_id IS NULL) = 0
UNION ALL SELECT 'BACKWARD', 'extra', 'new required field' WHERE (SELECT count(*) FROM v_delivered) > 0""", ("v_delivered",))
def schema_violations(spark, sf):
    """Inferred text schema of delivered rows against a later delivery without product, with an extra field."""
    old = schema.infer_csv_schema(B.delivered(spark, sf).select("batch_id", "product_id", "note"))
    later = B.delivered(spark, sf).select("batch_id", F.lit("7.5").alias("note"), F.lit("x").alias("extra"))
    new = schema.infer_csv_schema(later).withColumn("required", F.col("required") & (F.col("field") != "note"))
    return schema.compatibility_violations(old, new, "BACKWARD").withColumn("mode", F.lit("BACKWARD"))


@query("first_row_schema", "SCH-4", """SELECT 'key' AS field, 'integer' AS type, true AS nullable FROM (SELECT min(o_orderkey) AS k FROM orders) WHERE k IS NOT NULL
UNION ALL SELECT 'status', 'string', true UNION ALL SELECT 'price', 'double', true""")
def first_row_schema(spark, sf):
    o = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderstatus").alias("status"),
                                            F.col("o_totalprice").cast("string").alias("price"))
    return schema.infer_first_row_schema(o, ["key"])


@query("latest_schema_versions", "SCH-7", """
SELECT concat('schema-', o_custkey % 100) AS name, CAST(o_orderkey AS INTEGER) AS version, concat('f', o_orderkey % 7) AS field FROM orders
WHERE (o_custkey % 100, o_orderkey) IN (SELECT o_custkey % 100, max(o_orderkey) FROM orders GROUP BY 1)""")
def latest_schema_versions(spark, sf):
    o = B.table(spark, sf, "orders")
    rows = o.select(F.concat(F.lit("schema-"), (F.col("o_custkey") % 100).cast("string")).alias("name"),
                    F.col("o_orderkey").cast("int").alias("version"),
                    F.concat(F.lit("f"), (F.col("o_orderkey") % 7).cast("string")).alias("field"))
    return schema.latest_schemas(rows)


@query("registered_schema_versions", "SCH-6 SCH-7", """SELECT name, version, field, type FROM (
  SELECT 'orders' AS name, CAST(1 AS INTEGER) AS version, unnest(['o_orderkey', 'o_orderstatus']) AS field, unnest(['integer', 'string']) AS type
  UNION ALL SELECT 'orders', 2, unnest(['o_orderkey', 'o_orderstatus', 'o_totalprice']), unnest(['integer', 'string', 'number']))
WHERE (SELECT count(*) FROM orders) > 0""")
def registered_schema_versions(spark, sf):
    """Two versions inferred from text forms of the orders, registered and read back by number and as the latest."""
    text = B.table(spark, sf, "orders").select(*[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_orderstatus", "o_totalprice")])
    registry = schema.registry_at(spark, scratch_path(spark, "registry"))
    for df in (text.drop("o_totalprice"), text):
        found = schema.infer_csv_schema(df).collect()
        schema.register_schema(registry, "orders", schema.TableSchema({r["field"]: r["type"] for r in found}, ()))
    rows = []
    for version, asked in ((1, 1), (2, "latest")):
        rows += [("orders", version, f, t) for f, t in schema.get_schema(registry, "orders", asked).properties.items()]
    return spark.createDataFrame(rows, "name string, version int, field string, type string")


@query("parquet_schemas", "SCH-3", """SELECT 'customer' AS name, column_name AS field, CASE WHEN data_type IN ('BIGINT', 'INTEGER') THEN 'integer'
  WHEN data_type = 'DOUBLE' THEN 'number' ELSE 'string' END AS type, false AS required FROM (
  SELECT unnest(['c_custkey', 'c_name', 'c_acctbal']) AS column_name, unnest([typeof(c_custkey), typeof(c_name), typeof(c_acctbal)]) AS data_type FROM (SELECT * FROM customer LIMIT 1))""")
def parquet_schemas(spark, sf):
    df = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return schema.infer_parquet_schema(df).select(F.lit("customer").alias("name"), "field", "type", "required")


@query("compatibility_verdicts", "SCH-8", """SELECT unnest(['BACKWARD', 'FORWARD', 'FULL']) AS compatibility_mode, unnest([false, false, false]) AS compatible
WHERE (SELECT count(*) FROM orders) > 0 UNION ALL SELECT 'BACKWARD same', true""")
def compatibility_verdicts(spark, sf):
    """Schemas inferred from the orders' keys and statuses, and from a delivery whose key became text."""
    text = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("k"), F.col("o_orderstatus").alias("s"))
    old = schema.infer_csv_schema(text)
    new = schema.infer_csv_schema(text.select("k", F.length("s").cast("string").alias("s"), F.col("s").alias("extra")))
    out = schema.check_compatibility(old, old, "BACKWARD").select(F.lit("BACKWARD same").alias("compatibility_mode"), "compatible")
    for mode in ("BACKWARD", "FORWARD", "FULL"):
        out = out.unionByName(schema.check_compatibility(old, new, mode).select("compatibility_mode", "compatible"))
    return out


# --- contracts ---

_NAME = "coalesce(nullif(trim(regexp_replace(replace(upper(c_name), ' ', '-'), '-+', '-', 'g'), '-'), ''), 'UNKNOWN')"


@query("assign_contract_ids", "CTR-6", f"""
SELECT contract_key, concat('CMO-', upper(cmo_id), '-', upper(data_domain), '-',
  CASE WHEN n >= 100 THEN CAST(n AS VARCHAR) ELSE lpad(CAST(n AS VARCHAR), 3, '0') END) AS contract_id FROM (
  SELECT o_orderkey AS contract_key, cmo_id, data_domain, row_number() OVER (PARTITION BY cmo_id, data_domain ORDER BY o_orderkey)
    + coalesce((SELECT count(*) FROM v_contracts c WHERE c.cmo_id = o.cmo_id AND c.data_domain = o.data_domain), 0) AS n
  FROM (SELECT o_orderkey, concat('cmo-', CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE o_custkey % 40 END) AS cmo_id,
    CASE o_orderkey % 2 WHEN 0 THEN 'building' ELSE 'furniture' END AS data_domain FROM orders) o)""", ("v_contracts",))
def assign_contract_ids(spark, sf):
    """A third of the requests come from one supplier."""
    o = B.table(spark, sf, "orders")
    key = F.col("o_orderkey")
    tenant = F.when(key % 3 == 0, F.lit(1).cast("bigint")).otherwise(F.col("o_custkey") % 40)
    requests = o.select(key.alias("contract_key"), F.concat(F.lit("cmo-"), tenant.cast("string")).alias("cmo_id"),
                        F.when(key % 2 == 0, "building").otherwise("furniture").alias("data_domain"))
    return contracts.assign_contract_ids(requests, B.contracts(spark, sf), ["contract_key"]).select("contract_key", "contract_id")


_IDS = """(SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'bad-id' ELSE concat('CMO-', replace(upper(c_name), '#', '-'), '-', c_mktsegment, '-X-',
  lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')) END AS id FROM customer)"""


@query("parse_contract_ids", "CTR-7", f"""SELECT c_custkey, regexp_matches(id, '^CMO-[A-Z0-9\\-]+-[A-Z0-9\\-]+-\\d{{3}}$') AS is_valid,
  CASE WHEN id <> 'bad-id' THEN string_split(id, '-')[2] END AS cmo_name,
  CASE WHEN id <> 'bad-id' THEN array_to_string(string_split(id, '-')[3:-2], '-') END AS data_domain,
  CASE WHEN id <> 'bad-id' THEN CAST(string_split(id, '-')[-1] AS INTEGER) END AS number FROM {_IDS}""")
def parse_contract_ids(spark, sf):
    c = B.table(spark, sf, "customer")
    good = F.concat(F.lit("CMO-"), F.replace(F.upper("c_name"), F.lit("#"), F.lit("-")), F.lit("-"), F.col("c_mktsegment"), F.lit("-X-"),
                    F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"))
    cid = F.when(F.col("c_custkey") % 5 == 0, "bad-id").otherwise(good)
    return c.select("c_custkey", contracts.contract_id_valid(cid).alias("is_valid"), contracts.parse_contract_id(cid).alias("p")).select(
        "c_custkey", "is_valid", "p.cmo_name", "p.data_domain", "p.number")


_STATES = "CASE contract_id % 5 WHEN 0 THEN 'draft' WHEN 1 THEN 'pending_cmo_review' WHEN 2 THEN 'pending_owner_approval' ELSE status END"
_ACTIONS = "CASE contract_id % 7 WHEN 0 THEN 'submit' WHEN 1 THEN 'accept' WHEN 2 THEN 'approve' WHEN 3 THEN 'reject' END"


@query("contract_transitions", "CTR-8", f"""
SELECT contract_id, coalesce(target, status) AS status, CASE WHEN action IS NOT NULL AND target IS NULL
  THEN concat('Cannot ', action, ' contract in status: ', status) END AS error FROM (
  SELECT contract_id, status, action, CASE WHEN action = 'submit' AND status = 'draft' THEN 'pending_cmo_review'
    WHEN action = 'accept' AND status = 'pending_cmo_review' THEN 'pending_owner_approval'
    WHEN action = 'approve' AND status = 'pending_owner_approval' THEN 'active'
    WHEN action = 'reject' AND status IN ('pending_cmo_review', 'pending_owner_approval') THEN 'rejected' END AS target
  FROM (SELECT contract_id, {_STATES} AS status, {_ACTIONS} AS action FROM v_contracts))""", ("v_contracts",))
def contract_transitions(spark, sf):
    key = F.col("contract_id")
    state = (F.when(key % 5 == 0, "draft").when(key % 5 == 1, "pending_cmo_review").when(key % 5 == 2, "pending_owner_approval")
             .otherwise(F.col("status")))
    rows = B.contracts(spark, sf).select("contract_id", state.alias("status"))
    act = F.element_at(F.array(*[F.lit(a) for a in ("submit", "accept", "approve", "reject")]), (key % 7 + 1).cast("int"))
    actions = B.contracts(spark, sf).where(key % 7 < 4).select("contract_id", act.alias("action"), F.lit("someone").alias("actor"))
    return contracts.apply_transitions(rows, actions, F.lit(NOW)).select("contract_id", "status", "error")


@query("deployable_contracts", "CTR-9", """
SELECT contract_id, CASE WHEN contract_id % 11 = 0 THEN 'Missing required field: integrationPattern'
  WHEN status <> 'active' THEN concat('Contract must be ''active'' to deploy, current status: ''', status, '''')
  WHEN contract_id % 13 = 0 THEN 'Invalid integration pattern ''odd''. Must be one of [''ai-unstructured'', ''native-connector'', ''secure-transfer'']'
  ELSE '' END AS errors FROM v_contracts""", ("v_contracts",))
def deployable_contracts(spark, sf):
    key = F.col("contract_id")
    pattern = F.when(key % 11 == 0, None).when(key % 13 == 0, "odd").otherwise(F.col("connection_type"))
    rows = B.contracts(spark, sf).withColumn("contract_id", key.cast("string")).withColumn("integration_pattern", pattern)
    return contracts.deployable(rows).select(F.col("contract_id").cast("bigint").alias("contract_id"),
                                             F.array_join("errors", "; ").alias("errors"))


@query("upsert_contracts", "CTR-11", """
SELECT coalesce(c.contract_id, n.id) AS contract_id, CASE WHEN c.contract_id IS NULL THEN 'draft' WHEN n.id % 4 = 0 THEN 'suspended' ELSE c.status END AS status,
  CASE WHEN n.id IS NOT NULL THEN 'v2' ELSE 'v1' END AS schema_version, coalesce(c.cmo_id, 'cmo-new') AS cmo_id
FROM v_contracts c FULL JOIN (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 = 0) n ON n.id = c.contract_id""", ("v_contracts",))
def upsert_contracts(spark, sf):
    now = F.lit(NOW).cast("timestamp")
    rows = B.contracts(spark, sf).select("contract_id", "cmo_id", "status", F.lit("v1").alias("schema_version"),
                                         now.alias("created_at"), now.alias("updated_at"))
    key = F.col("o_orderkey")
    changes = B.table(spark, sf, "orders").where(key % 3 == 0).select(
        key.alias("contract_id"), F.lit("cmo-new").alias("cmo_id"), F.lit("v2").alias("schema_version"),
        F.when(key % 4 == 0, "suspended").when(key % 4 == 1, "no-such-status").alias("status"))
    return contracts.upsert_contracts(rows, changes, now).select("contract_id", "status", "schema_version", "cmo_id")


_BAD = "c_custkey % 12"


def _contract_docs(spark, sf):
    """A contract document per customer, most of them with one defect."""
    c = B.table(spark, sf, "customer")
    bad, key = F.col("c_custkey") % 12, F.col("c_custkey").cast("string")

    def pick(case: int, broken: str, fine: str):
        return F.when(bad == case, F.lit(broken)).otherwise(F.lit(fine))

    doc = F.concat(
        F.lit('{"cmoId": "cmo-'), key, F.lit('", "dataDomain": '), pick(1, '" "', '"batch-records"'),
        F.lit(', "schemaId": "s", "schemaVersion": "1"'), pick(2, "", ', "sla": {"timeliness": '),
        F.when(bad != 2, pick(3, '{"maxDelayHours": 0, "measurementWindow": "daily"}', '{"maxDelayHours": 24, "measurementWindow": "daily"}')).otherwise(""),
        F.when(bad != 2, pick(4, "", ', "availability": {"uptimePercentage": 99.5, "measurementWindow": "monthly"}')).otherwise(""),
        F.when(bad != 2, F.lit(', "quality": {"minQualityScore": 95, "measurementWindow": "x"}}')).otherwise(""),
        F.lit(', "qualityRules": '), F.when(bad == 5, F.lit("[]")).otherwise(F.concat(
            F.lit('[{"ruleId": "r1", "ruleName": "n", "ruleType": '), pick(6, '"speed"', '"completeness"'),
            F.lit(', "expression": '), pick(7, '"Completness \\"x\\""', '"Completeness \\"x\\" > 0.9"'),
            F.lit(', "threshold": '), pick(8, "101", "99.5"), F.lit(', "severity": "error"}]'))),
        F.lit(', "deliverySchedule": {"frequency": '), pick(9, '"yearly"', '"daily"'),
        F.lit(', "cronExpression": '), pick(10, '"0 2 *"', '"0 2 * * *"'),
        F.lit('}, "governance": {"dataClassification": "internal", "retentionYears": '), pick(11, "2.5", "7"),
        F.lit(', "allowedUsers": [], "allowedGroups": [], "piiFields": ["a"], "encryptionRequired": true}}'))
    return c.select("c_custkey", doc.alias("doc"))


@query("create_contracts", "CTR-11 CTR-6 CTR-1", f"""
SELECT c_custkey, concat('CMO-CMO-', c_custkey, '-BATCH-RECORDS-001') AS contract_id, 'draft' AS status FROM customer WHERE {_BAD} = 0
UNION ALL SELECT c_custkey, NULL, 'rejected' FROM customer WHERE {_BAD} <> 0""")
def create_contracts(spark, sf):
    """Each customer's document as a new contract: the sound ones get an id, the others come back with their errors."""
    made, refused = contracts.create_contracts(_contract_docs(spark, sf), None, ["c_custkey"], F.lit(NOW).cast("timestamp"))
    refused = refused.where(F.size("errors") > 0).select("c_custkey", F.lit(None).cast("string").alias("contract_id"), F.lit("rejected").alias("status"))
    return made.select("c_custkey", "contract_id", "status").unionByName(refused)


@query("validate_contracts", "CTR-1 CTR-2 CTR-3 CTR-4 CTR-5", f"""
SELECT c_custkey, CASE {_BAD} WHEN 1 THEN 'dataDomain must be a non-empty string' WHEN 2 THEN 'Missing required field: sla'
  WHEN 3 THEN 'sla.timeliness.maxDelayHours must be a positive number' WHEN 4 THEN 'sla: missing required section ''availability'''
  WHEN 5 THEN 'qualityRules must contain at least one rule'
  WHEN 6 THEN 'qualityRules[0]: invalid ruleType ''speed''. Must be one of [''accuracy'', ''completeness'', ''consistency'', ''uniqueness'']'
  WHEN 7 THEN 'qualityRules[0]: expression is not valid DQDL. Must start with a recognised DQDL keyword (e.g. Completeness, ColumnExists, Uniqueness, …)'
  WHEN 8 THEN 'qualityRules[0]: threshold must be between 0 and 100'
  WHEN 9 THEN 'deliverySchedule: invalid frequency ''yearly''. Must be one of [''daily'', ''hourly'', ''monthly'', ''real-time'', ''weekly'']'
  WHEN 10 THEN 'deliverySchedule: cronExpression is not a valid cron format. Expected 5 or 6 space-separated fields'
  WHEN 11 THEN 'governance: retentionYears must be a positive integer' ELSE '' END AS errors, {_BAD} = 0 AS is_valid FROM customer""")
def validate_contracts(spark, sf):
    return contracts.validate_contracts(_contract_docs(spark, sf)).select(
        "c_custkey", F.array_join("errors", "; ").alias("errors"), "is_valid")
