"""Registered queries: range joins by cells, pages from an order index, changes between listings, searches by postings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import audit
from tenantlake.operators.ranges import range_join
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query
from tenantlake.session import scratch_path
from tenantlake.sources.order_index import OrderIndex
from tenantlake.sources.snapshots import ListingSnapshots
from tenantlake.sources.text_index import TextIndex


@query("orders_in_key_blocks", "SQL-13", """SELECT c_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total, max(o_orderkey) AS newest
FROM orders JOIN (SELECT c_custkey, c_custkey * 40 AS lo, c_custkey * 40 + CASE WHEN c_custkey % 97 = 0 THEN 5000 ELSE 10 + c_custkey % 90 END AS hi
  FROM customer) ON o_orderkey BETWEEN lo AND hi GROUP BY 1""")
def orders_in_key_blocks(spark, sf):
    """Orders whose number lies in a block of numbers given to a customer; blocks overlap and some are long."""
    lo, key = F.col("c_custkey").cast("long") * 40, F.col("c_custkey")
    blocks = B.table(spark, sf, "customer").select(
        "c_custkey", lo.alias("lo"), (lo + F.when(key % 97 == 0, 5000).otherwise(key % 90 + 10)).alias("hi"))
    orders = B.table(spark, sf, "orders").select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice")
    return range_join(orders, blocks, "o_orderkey", "lo", "hi").groupBy("c_custkey").agg(
        F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.max("o_orderkey").alias("newest"))


@query("runs_in_error_windows", "SQL-13", """WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CAST(value AS DOUBLE) AS value FROM events)
SELECT b.event_id AS error_id, count(*) AS runs, min(a.event_id) AS first_run FROM e a JOIN e b ON a.user_id = b.user_id
  AND a.us BETWEEN b.us AND b.us + (60 + b.event_id % 10 * 86400) * 1000000 WHERE b.event_type = 'error' AND a.event_type <> 'error' GROUP BY 1""")
def runs_in_error_windows(spark, sf):
    """A contract's runs in the minute to nine days after each of its errors, by contract and time."""
    events = B.table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    failed = F.col("event_type") == "error"
    windows = events.where(failed).select(F.col("event_id").alias("error_id"), "user_id", F.col("us").alias("lo"),
                                          (F.col("us") + (F.col("event_id") % 10 * 86400 + 60) * 1_000_000).alias("hi"))
    runs = events.where(~failed).select("event_id", "user_id", "us")
    return range_join(runs, windows, "us", "lo", "hi", ["user_id"]).groupBy("error_id").agg(
        F.count(F.lit(1)).alias("runs"), F.min("event_id").alias("first_run"))


_PAGE = 10
_BY_PRICE = "ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS FIRST, o_custkey NULLS FIRST"


@query("pages_of_orders", "SRT-2", f"""WITH o AS (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER ({_BY_PRICE}) - 1 AS place, count(*) OVER () AS n FROM orders)
SELECT 'third' AS page, o_orderkey, o_totalprice, n FROM o WHERE place // {_PAGE} = 2
UNION ALL SELECT 'after it', o_orderkey, o_totalprice, n FROM o WHERE place // {_PAGE} = 3
UNION ALL SELECT 'last', o_orderkey, o_totalprice, n FROM o WHERE place // {_PAGE} = (n - 1) // {_PAGE}""")
def pages_of_orders(spark, sf):
    """Of all orders by falling price the third page, the one behind its last row, and the last page, with the number of orders."""
    index = OrderIndex(spark, scratch_path(spark, "orders-by-price"), ["-o_totalprice", "o_orderkey"])
    index.build(B.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 10_000)
    n = index.total()
    third = index.page(3, _PAGE)
    pages = [("third", third), ("last", index.page(max(1, -(-n // _PAGE)), _PAGE))]
    shown = third.collect()  # a page
    if shown:
        pages.append(("after it", index.after(shown[-1].asDict(), _PAGE)))
    out = None
    for name, page in pages:
        page = page.select(F.lit(name).alias("page"), "o_orderkey", "o_totalprice", F.lit(n).cast("long").alias("n"))
        out = page if out is None else out.unionByName(page)
    return out


@query("listing_changes", "SRC-7", """WITH f AS (SELECT DISTINCT concat('bronze/cmo-', l_suppkey, '/coa/incoming/', l_orderkey, '/', l_linenumber, '.csv') AS path, l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS l FROM lineitem)
SELECT path, CASE WHEN k % 7 = 0 THEN 'added' WHEN k % 11 = 0 THEN 'removed' ELSE 'changed' END AS change,
  CASE WHEN k % 7 = 0 OR k % 11 <> 0 THEN l * 100 + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END END AS size, CASE WHEN k % 7 <> 0 THEN l * 100 END AS size_before
FROM f WHERE (k % 7 = 0) <> (k % 11 = 0) OR k % 13 = 0 AND k % 7 <> 0 AND k % 11 <> 0""")
def listing_changes(spark, sf):
    """Two listings of the delivered files: orders divisible by seven come, those by eleven go, those by thirteen grow."""
    k, line = F.col("l_orderkey"), F.col("l_linenumber").cast("long")
    path = F.concat(F.lit("bronze/cmo-"), F.col("l_suppkey").cast("string"), F.lit("/coa/incoming/"), k.cast("string"),
                    F.lit("/"), line.cast("string"), F.lit(".csv"))
    files = B.table(spark, sf, "lineitem").select(path.alias("path"), k.alias("k"), (line * 100).alias("size"),
                                                  F.lit("2024-01-01").cast("timestamp").alias("modified"))
    kept = ListingSnapshots(spark, scratch_path(spark, "listings"))
    first = kept.take(files.where(F.col("k") % 7 != 0))
    kept.take(files.where(F.col("k") % 11 != 0).withColumn("size", F.col("size") + F.when(F.col("k") % 13 == 0, 1).otherwise(0)))
    return kept.since(first).select("path", "change", "size", "size_before")


@query("searched_customers", "FLT-9", """SELECT 'segment' AS search, c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'build')
UNION ALL SELECT 'number', c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#00000001')
UNION ALL SELECT 'none', c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'nobody')
UNION ALL SELECT 'short', c_custkey, c_name FROM customer WHERE contains(lower(c_name), '77')""")
def searched_customers(spark, sf):
    """Customers who come in two loads, searched by their trigrams; one text is too short for any."""
    customers = B.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    index = TextIndex(spark, scratch_path(spark, "customers"), ["c_name", "c_mktsegment"])
    for load in (0, 1):
        index.add(load, customers.where(F.col("c_custkey") % 2 == load))
    out = None
    for name, term in (("segment", "BUILD"), ("number", "R#00000001"), ("none", "nobody"), ("short", "77")):
        found = index.search(term).select(F.lit(name).alias("search"), "c_custkey", "c_name")
        out = found if out is None else out.unionByName(found)
    return out


_WINDOW = (dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 20))
_TENANT = "cmo-7"
_HAS = f"'(^|[^A-Za-z0-9_-]){_TENANT}([^A-Za-z0-9_-]|$)'"
_FOUND = f"""event_id, event_name, username, CAST(epoch_us(event_time) AS BIGINT) AS at FROM v_audit
WHERE event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND (regexp_matches(cloud_trail_event, {_HAS}) OR regexp_matches(resource_name, {_HAS}))"""


@query("indexed_tenant_events", "AUD-3 AUD-4", f"""SELECT 'data_access' AS report, {_FOUND} AND resource_type = 'AWS::S3::Object'
UNION ALL SELECT 'user_actions', {_FOUND} UNION ALL SELECT 'data_modifications', {_FOUND} AND event_name = 'PutObject'""", ("v_audit",))
def indexed_tenant_events(spark, sf):
    """A tenant's reports from the events that its token's postings name; the events come in a load a half-month."""
    events = B.audit_events(spark, sf)
    index = TextIndex(spark, scratch_path(spark, "audit"), records=[audit.tenant_text, lambda names: F.to_json(F.struct(*names))])
    half = dt.datetime(2024, 1, 15)
    index.add(1, events.where(F.col("event_time") < half))
    index.add(2, events.where(~F.coalesce(F.col("event_time") < half, F.lit(False))))
    mine = index.with_token(_TENANT)
    reports = [audit.compliance_events(mine, kind, _TENANT, *_WINDOW).select(
        F.lit(kind).alias("report"), "event_id", "event_name", "username", F.unix_micros(F.col("event_time").cast("timestamp")).alias("at"))
        for kind in ("data_access", "user_actions", "data_modifications")]
    return reports[0].unionByName(reports[1]).unionByName(reports[2])
