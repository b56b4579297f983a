"""Domain views over the shared tables: each as a DataFrame and, for checks, as SQL text.

Suppliers are tenants; line items are delivered batch records (their batch id repeats); orders are
batches with four data elements; customers hold one contract each; events are runs and audit events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.operators.batches import ELEMENTS_TYPE, OPTIONAL_ELEMENTS, REQUIRED_ELEMENTS, element, with_missing

TENANTS = 120  # tenant numbers of batches, runs and contracts wrap here


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _tenant(number: Column) -> Column:
    return F.concat(F.lit("cmo-"), number.cast("string"))


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(_tenant(F.col("s_suppkey")).alias("cmo_id"), F.col("s_name").alias("organization_name"),
                    (F.col("s_acctbal") >= 0).alias("gxp_certified"), F.col("s_nationkey").alias("nation_key"))


def products(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_id"),
                    F.col("p_name").alias("product_name"))


def batch_records(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    flag = F.col("l_returnflag")
    return li.select(
        F.concat(F.lit("B"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
        .alias("batch_id"),
        _tenant(F.col("l_suppkey")).alias("cmo_id"),
        F.when(flag == "A", "batch-records").when(flag == "N", "quality-data").otherwise("yield-data").alias("data_domain"),
        F.col("l_quantity").alias("quantity"),
        F.when(F.col("l_linestatus") == "F", "PASS").otherwise("FAIL").alias("quality_status"),
        F.col("l_shipdate").alias("ts"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"), F.col("l_partkey").alias("part_key"))


def delivered(spark: SparkSession, sf: str) -> DataFrame:
    """Batch records as a supplier would deliver them: text cells, gaps and bad values."""
    li = table(spark, sf, "lineitem")
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    whole = F.col("l_quantity").cast("bigint").cast("string")
    quantity = (F.when(order % 11 == 0, "n/a").when(order % 7 == 0, None)
                .when(order % 5 == 0, F.concat(whole, F.lit(".5"))).otherwise(whole))
    approved = (F.when(line == 1, "TRUE").when(line == 2, "1").when(line == 3, "Yes").when(line == 4, "no")
                .when(line == 5, " true").when(line == 6, "0"))
    return li.select(
        F.concat(F.lit("B"), order.cast("string"), F.lit("-"), line.cast("string")).alias("batch_id"),
        F.when(F.col("l_partkey") % 53 != 0, F.concat(F.lit("P"), F.col("l_partkey").cast("string"))).alias("product_id"),
        _tenant(F.col("l_suppkey")).alias("cmo_id"), quantity.alias("quantity"), approved.alias("approved"),
        F.when(order % 13 != 0, F.col("l_returnflag")).alias("note"), F.col("l_shipdate").alias("ts"),
        F.col("l_extendedprice").alias("price"))


def contracts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    key = F.col("c_custkey")
    return c.select(
        key.alias("contract_id"), _tenant(key % TENANTS).alias("cmo_id"),
        F.lower("c_mktsegment").alias("data_domain"),
        F.when(key % 4 == 0, "draft").when(key % 4 == 1, "suspended").otherwise("active").alias("status"),
        F.when(key % 3 == 0, "secure-transfer").when(key % 3 == 1, "ai-unstructured").otherwise("native-connector")
        .alias("connection_type"),
        ((key % 10 + 1) * 0.004).alias("max_delay_hours"), (key % 60 + 30).cast("double").alias("min_quality_score"),
        (key % 25 + 70).cast("double").alias("uptime_percentage"),
        F.when(key % 4 == 0, "public").when(key % 4 == 1, "internal").when(key % 4 == 2, "confidential")
        .otherwise("restricted").alias("classification"), F.col("c_name").alias("contact_name"),
        F.col("c_acctbal").alias("balance"))


def element_days(key: Column) -> dict[str, Column]:
    return {"bmr": key % 30 + 5, "coa": key % 60 + 10, "in_process": key % 90 + 15, "yield": key % 120 + 20}


def contract_slas(spark: SparkSession, sf: str) -> DataFrame:
    """Contracts with their element deadlines; every tenth has none."""
    key = F.col("contract_id")
    slas = F.array(*[F.struct(F.lit(e).alias("element_type"), d.cast("int").alias("max_days"))
                     for e, d in element_days(key).items()])
    return contracts(spark, sf).select(
        "contract_id", F.when(key % 10 == 9, F.array().cast("array<struct<element_type:string,max_days:int>>"))
        .otherwise(slas).alias("element_slas"))


def receipts(spark: SparkSession, sf: str) -> DataFrame:
    """One row per delivered line; the first four line numbers are required elements, the others optional ones."""
    li = table(spark, sf, "lineitem")
    kind = F.element_at(F.array(*[F.lit(e) for e in (*REQUIRED_ELEMENTS, *OPTIONAL_ELEMENTS)]), F.col("l_linenumber"))
    return li.select(F.col("l_orderkey").alias("batch_id"), kind.alias("element_type"),
                     F.col("l_shipdate").cast("timestamp").alias("received_at"),
                     F.concat(F.lit("bronze/"), F.col("l_partkey").cast("string"), F.lit("/"),
                              F.col("l_suppkey").cast("string")).alias("s3_path"))


def batch_heads(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    return o.select(
        key.alias("batch_id"), F.concat(F.lit("LOT-"), key.cast("string")).alias("lot_number"),
        F.concat(F.lit("P"), (key % 2500).cast("string")).alias("product_id"),
        _tenant(F.col("o_custkey") % TENANTS).alias("cmo_id"), F.col("o_custkey").alias("contract_id"),
        F.col("o_orderdate").cast("date").alias("manufacturing_date"),
        F.when(status == "O", "in_progress").when(status == "P", "submitted").otherwise("complete").alias("status"),
        F.col("o_totalprice").alias("yield_value"))


def empty_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches with four unreceived elements."""
    none_ts, none_text = F.lit(None).cast("timestamp"), F.lit(None).cast("string")
    blank = F.array(*[element(e, F.lit(False), none_ts, none_text, F.lit(False)) for e in REQUIRED_ELEMENTS])
    return with_missing(batch_heads(spark, sf).withColumn("data_elements", blank.cast(ELEMENTS_TYPE)))


def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches whose elements are received when a line with the element's number was delivered, optional ones only then."""
    kinds = (*REQUIRED_ELEMENTS, *OPTIONAL_ELEMENTS)
    first = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("batch_id")).agg(*[
        F.min(F.when(F.col("l_linenumber") == i + 1, F.col("l_shipdate"))).cast("timestamp").alias(e)
        for i, e in enumerate(kinds)])
    joined = batch_heads(spark, sf).join(first, "batch_id", "left")
    items = F.array(*[element(e, F.col(e).isNotNull(), F.col(e), F.lit(None).cast("string"), F.lit(False))
                      for e in kinds]).cast(ELEMENTS_TYPE)
    there = F.filter(items, lambda e: e["element_type"].isin(*REQUIRED_ELEMENTS) | e["received"])
    return with_missing(joined.withColumn("data_elements", there).drop(*kinds))


def connections(spark: SparkSession, sf: str) -> DataFrame:
    """Connections of suppliers, eight customers a supplier, so that their number per supplier doesn't grow."""
    return contracts(spark, sf).select(
        F.col("contract_id").alias("connection_id"), _tenant(F.floor(F.col("contract_id") / 8)).alias("cmo_id"), "status")


def supplied_batches(spark: SparkSession, sf: str) -> DataFrame:
    """(batch_id, cmo_id): batches of those suppliers."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("batch_id"), _tenant(F.floor(F.col("o_custkey") / 8)).alias("cmo_id"))


def executions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    value = F.col("value")
    return e.select(
        F.col("event_id").alias("execution_id"), F.col("user_id").alias("contract_id"),
        _tenant(F.col("user_id") % TENANTS).alias("cmo_id"), "ts", (F.col("event_type") != "error").alias("success"),
        F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"),
        value.alias("execution_time_seconds"),
        F.when(value > 100, 0.0).otherwise(100.0 - value).alias("quality_score"),
        (F.col("event_id") % 1000).alias("records_processed"))


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    kind = F.col("event_type")
    name = (F.when(kind == "view", "GetObject").when(kind == "click", "ListObjects").when(kind == "purchase", "PutObject")
            .when(kind == "signup", "CreateUser").otherwise("DeleteObject"))
    tenant = _tenant(F.col("user_id") % TENANTS)
    raw = F.concat(F.lit('{"tenant":"'), F.when(F.col("event_id") % 3 == 0, tenant).otherwise("none"),
                   F.lit('","k":'), F.col("event_id").cast("string"), F.lit("}"))
    resource = F.concat(F.lit("bronze/"), tenant, F.lit("/"), F.col("event_id").cast("string"))
    return e.select(
        F.concat(F.lit("evt-"), (F.col("event_id") - F.col("event_id") % 2).cast("string")).alias("event_id"),
        name.alias("event_name"), F.col("ts").alias("event_time"),
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"),
        F.array(F.struct(F.when(F.col("event_id") % 5 == 0, resource).otherwise("shared").alias("ResourceName"),
                         F.when(F.col("event_id") % 2 == 0, "AWS::S3::Object").otherwise("other")
                         .alias("ResourceType"))).alias("resources"),
        raw.alias("cloud_trail_event"))


def manifest(spark: SparkSession, sf: str) -> DataFrame:
    """File listing: one delivered file per line item."""
    li = table(spark, sf, "lineitem")
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    ext = (F.when(line == 1, "csv").when(line == 2, "JSON").when(line == 3, "parquet").when(line == 4, "pdf")
           .when(line == 5, "exe").otherwise("json"))
    place = (F.when(line == 1, "incoming/").when(line == 6, "manual-review/")
             .otherwise("year=2001/month=01/day=05/"))
    domain = F.element_at(F.array(*[F.lit(x) for x in DOMAINS]), (order % 5 + 1).cast("int"))
    base = F.concat(F.lit("bronze/"), _tenant(F.col("l_suppkey")), F.lit("/"), domain, F.lit("/"), place)
    inside = F.when(line == 1, F.concat(order.cast("string"), F.lit("/coa/"))).otherwise("")
    key = F.concat(base, inside, F.lit("f"), order.cast("string"), F.lit("-"), F.col("l_partkey").cast("string"),
                   F.lit("."), ext)
    return li.select(key.alias("path"), (F.col("l_extendedprice") * 10000).cast("bigint").alias("size"),
                     F.col("l_shipdate").alias("modified"))


DOMAINS = ("automobile", "building", "furniture", "household", "machinery")

_DOMAIN_CASE = " ".join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS))

# The same views for the SQL side of a check.
SQL_VIEWS = {
    "v_supplier": """SELECT concat('cmo-', s_suppkey) AS cmo_id, s_name AS organization_name,
  s_acctbal >= 0 AS gxp_certified, s_nationkey AS nation_key FROM supplier""",
    "v_product": "SELECT concat('P', p_partkey) AS product_id, p_name AS product_name FROM part",
    "v_batch_records": """SELECT concat('B', l_orderkey, '-', l_linenumber) AS batch_id,
  concat('cmo-', l_suppkey) AS cmo_id,
  CASE l_returnflag WHEN 'A' THEN 'batch-records' WHEN 'N' THEN 'quality-data' ELSE 'yield-data' END AS data_domain,
  l_quantity AS quantity, CASE l_linestatus WHEN 'F' THEN 'PASS' ELSE 'FAIL' END AS quality_status,
  l_shipdate AS ts, l_extendedprice AS price, l_discount AS discount, l_tax AS tax, l_partkey AS part_key
  FROM lineitem""",
    "v_delivered": """SELECT concat('B', l_orderkey, '-', l_linenumber) AS batch_id,
  CASE WHEN l_partkey % 53 <> 0 THEN concat('P', l_partkey) END AS product_id, concat('cmo-', l_suppkey) AS cmo_id,
  CASE WHEN l_orderkey % 11 = 0 THEN 'n/a' WHEN l_orderkey % 7 = 0 THEN NULL
    WHEN l_orderkey % 5 = 0 THEN concat(CAST(l_quantity AS BIGINT), '.5')
    ELSE CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) END AS quantity,
  CASE l_linenumber WHEN 1 THEN 'TRUE' WHEN 2 THEN '1' WHEN 3 THEN 'Yes' WHEN 4 THEN 'no' WHEN 5 THEN ' true'
    WHEN 6 THEN '0' END AS approved,
  CASE WHEN l_orderkey % 13 <> 0 THEN l_returnflag END AS note, l_shipdate AS ts, l_extendedprice AS price
  FROM lineitem""",
    "v_contracts": f"""SELECT c_custkey AS contract_id, concat('cmo-', c_custkey % {TENANTS}) AS cmo_id,
  lower(c_mktsegment) AS data_domain,
  CASE c_custkey % 4 WHEN 0 THEN 'draft' WHEN 1 THEN 'suspended' ELSE 'active' END AS status,
  CASE c_custkey % 3 WHEN 0 THEN 'secure-transfer' WHEN 1 THEN 'ai-unstructured' ELSE 'native-connector' END
    AS connection_type,
  CAST(c_custkey % 10 + 1 AS DOUBLE) * 0.004::DOUBLE AS max_delay_hours,
  CAST(c_custkey % 60 + 30 AS DOUBLE) AS min_quality_score,
  CAST(c_custkey % 25 + 70 AS DOUBLE) AS uptime_percentage,
  CASE c_custkey % 4 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' ELSE 'restricted' END
    AS classification, c_name AS contact_name, c_acctbal AS balance,
  CASE WHEN c_custkey % 10 <> 9 THEN c_custkey % 30 + 5 END AS bmr_days,
  CASE WHEN c_custkey % 10 <> 9 THEN c_custkey % 60 + 10 END AS coa_days,
  CASE WHEN c_custkey % 10 <> 9 THEN c_custkey % 90 + 15 END AS in_process_days,
  CASE WHEN c_custkey % 10 <> 9 THEN c_custkey % 120 + 20 END AS yield_days
  FROM customer""",
    "v_batches": f"""SELECT o_orderkey AS batch_id, concat('LOT-', o_orderkey) AS lot_number,
  concat('P', o_orderkey % 2500) AS product_id, concat('cmo-', o_custkey % {TENANTS}) AS cmo_id,
  o_custkey AS contract_id, CAST(o_orderdate AS DATE) AS manufacturing_date,
  CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'P' THEN 'submitted' ELSE 'complete' END AS status,
  o_totalprice AS yield_value, bmr, coa, in_process, "yield", deviation, env_monitoring, equipment_logs
  FROM orders LEFT JOIN (SELECT l_orderkey,
    min(CASE WHEN l_linenumber = 1 THEN l_shipdate END) AS bmr, min(CASE WHEN l_linenumber = 2 THEN l_shipdate END) AS coa,
    min(CASE WHEN l_linenumber = 3 THEN l_shipdate END) AS in_process,
    min(CASE WHEN l_linenumber = 4 THEN l_shipdate END) AS "yield", min(CASE WHEN l_linenumber = 5 THEN l_shipdate END) AS deviation,
    min(CASE WHEN l_linenumber = 6 THEN l_shipdate END) AS env_monitoring, min(CASE WHEN l_linenumber = 7 THEN l_shipdate END) AS equipment_logs
    FROM lineitem GROUP BY l_orderkey) r ON l_orderkey = o_orderkey""",
    "v_executions": f"""SELECT event_id AS execution_id, user_id AS contract_id,
  concat('cmo-', user_id % {TENANTS}) AS cmo_id, ts, event_type <> 'error' AS success,
  CASE WHEN event_type = 'error' THEN 'failed' ELSE 'succeeded' END AS status, value AS execution_time_seconds,
  CASE WHEN value > 100 THEN 0.0::DOUBLE ELSE 100.0::DOUBLE - value END AS quality_score,
  event_id % 1000 AS records_processed FROM events""",
    "v_audit": f"""SELECT concat('evt-', event_id - event_id % 2) AS event_id,
  CASE event_type WHEN 'view' THEN 'GetObject' WHEN 'click' THEN 'ListObjects' WHEN 'purchase' THEN 'PutObject'
    WHEN 'signup' THEN 'CreateUser' ELSE 'DeleteObject' END AS event_name, ts AS event_time,
  concat('user-', user_id) AS username,
  CASE WHEN event_id % 5 = 0 THEN concat('bronze/cmo-', user_id % {TENANTS}, '/', event_id) ELSE 'shared' END
    AS resource_name,
  CASE WHEN event_id % 2 = 0 THEN 'AWS::S3::Object' ELSE 'other' END AS resource_type,
  concat('{{"tenant":"', CASE WHEN event_id % 3 = 0 THEN concat('cmo-', user_id % {TENANTS}) ELSE 'none' END,
    '","k":', event_id, '}}') AS cloud_trail_event, event_id AS row_no FROM events""",
    "v_manifest": f"""SELECT concat(base, inside, 'f', l_orderkey, '-', l_partkey, '.', ext) AS path, size, modified,
  base, tenant, data_domain, l_linenumber AS line, l_orderkey AS order_key FROM (
  SELECT *, concat('bronze/', tenant, '/', data_domain, '/',
    CASE l_linenumber WHEN 1 THEN 'incoming/' WHEN 6 THEN 'manual-review/' ELSE 'year=2001/month=01/day=05/' END) AS base,
    CASE WHEN l_linenumber = 1 THEN concat(l_orderkey, '/coa/') ELSE '' END AS inside,
    CASE l_linenumber WHEN 1 THEN 'csv' WHEN 2 THEN 'JSON' WHEN 3 THEN 'parquet' WHEN 4 THEN 'pdf' WHEN 5 THEN 'exe'
      ELSE 'json' END AS ext,
    CAST(trunc(l_extendedprice * 10000) AS BIGINT) AS size, l_shipdate AS modified
  FROM (SELECT *, concat('cmo-', l_suppkey) AS tenant, CASE l_orderkey % 5 {_DOMAIN_CASE} END AS data_domain
    FROM lineitem))""",
}


def with_views(body: str, *names: str) -> str:
    """A SELECT over named views as one statement."""
    if not names:
        return body
    head = "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in names)
    body = body.strip()
    # a body with its own WITH list continues this one
    return f"{head},\n{body[5:]}" if body.upper().startswith("WITH ") else f"{head}\n{body}"
