"""Registered queries: the guarded SQL surface and the shapes of SELECT it serves."""

from __future__ import annotations

from pyspark.sql import functions as F

from tenantlake.operators import sqlsurface as Q
from tenantlake.operators.windows import global_rank
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import REGISTRY, Entry, query


def _loaders(sf: str, *names: str):
    return {n: (lambda session, n=n: B.table(session, sf, n)) for n in names}


def statement(name: str, covers: str, tables: str, sql: str, check: str | None = None) -> None:
    """Register a guarded SELECT over whole tables; ``check`` is the other dialect's text where it differs."""
    def run(spark, sf):
        return Q.guarded_select(spark, sql, _loaders(sf, *tables.split()))
    REGISTRY[name] = Entry(run, check or sql, tuple(covers.split()))


_STATEMENTS = """(SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('SELECT * FROM t WHERE k = ', event_id)
  WHEN 1 THEN concat('drop table t', event_id) WHEN 2 THEN concat('-- note', chr(10), 'select ', event_id) WHEN 3 THEN 'WITH a AS (SELECT 1) SELECT * FROM a'
  WHEN 4 THEN 'SELECT ''please update me''' ELSE ' ' END AS sql FROM events)"""


@query("guard_statements", "SQL-1", f"""SELECT event_id, event_id % 6 IN (0, 2) AS allowed,
  CASE event_id % 6 WHEN 1 THEN 'DROP' WHEN 4 THEN 'UPDATE' END AS keyword,
  CASE event_id % 6 WHEN 1 THEN 'Generated SQL contains forbidden operation: DROP' WHEN 3 THEN 'Generated SQL must be a SELECT statement'
    WHEN 4 THEN 'Generated SQL contains forbidden operation: UPDATE' WHEN 5 THEN 'sql is required' END AS message FROM {_STATEMENTS}""")
def guard_statements(spark, sf):
    k, text = F.col("event_id") % 6, F.col("event_id").cast("string")
    sql = (F.when(k == 0, F.concat(F.lit("SELECT * FROM t WHERE k = "), text)).when(k == 1, F.concat(F.lit("drop table t"), text))
           .when(k == 2, F.concat(F.lit("-- note\nselect "), text)).when(k == 3, "WITH a AS (SELECT 1) SELECT * FROM a")
           .when(k == 4, "SELECT 'please update me'").otherwise(" "))
    return Q.guard_sql(B.table(spark, sf, "events").select("event_id", sql.alias("sql"))).drop("sql")


@query("extract_statements", "SQL-3", """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN concat('SELECT ', conv_id) WHEN 1 THEN concat('select ', turn, ' from x') ELSE '' END AS sql
FROM conversations""")
def extract_statements(spark, sf):
    """Statements planted around the reply texts: fenced, bare and none. Words of the text itself are kept out of the way."""
    c = B.table(spark, sf, "conversations")
    calm = F.regexp_replace(F.regexp_replace("text", "(?i)select", "choose"), "```", "'''")
    turn, conv = F.col("turn").cast("string"), F.col("conv_id").cast("string")
    body = (F.when(F.col("turn") % 3 == 0, F.concat(calm, F.lit("\n```sql\nSELECT "), conv, F.lit("\n```\n"), calm))
            .when(F.col("turn") % 3 == 1, F.concat(calm, F.lit(" select "), turn, F.lit(" from x  "))).otherwise(calm))
    return c.select("conv_id", "turn", Q.extract_sql(body).alias("sql"))


@query("guarded_text_result", "SQL-2 SRT-4 ACL-2", """SELECT CAST(n_regionkey AS VARCHAR) AS n_regionkey, CAST(count(*) AS VARCHAR) AS suppliers,
  CAST(max(s_suppkey) AS VARCHAR) AS newest FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey ORDER BY 1 LIMIT 1000""")
def guarded_text_result(spark, sf):
    sql = "SELECT n_regionkey, count(*) AS suppliers, max(s_suppkey) AS newest FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_regionkey"
    return Q.guarded_sql(spark, sql, _loaders(sf, "supplier", "nation"))


@query("guarded_tenant_view", "SQL-2 ACL-2", """SELECT l_orderkey, l_quantity FROM lineitem WHERE l_suppkey = 7 AND l_quantity > 10""")
def guarded_tenant_view(spark, sf):
    """The principal's view holds one supplier's rows without the price columns."""
    view = {"my_lines": lambda s: B.table(s, sf, "lineitem").where(F.col("l_suppkey") == 7).select("l_orderkey", "l_quantity")}
    return Q.guarded_select(spark, "SELECT l_orderkey, l_quantity FROM my_lines WHERE l_quantity > 10", view)


# --- questions from the user guide ---

@query("average_score_last_month", "SQL-5", """SELECT cmo_id, round(avg(quality_score), 6) AS avg_score FROM v_executions
WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01' GROUP BY 1""", ("v_executions",))
def average_score_last_month(spark, sf):
    month = F.date_trunc("month", F.col("ts")).cast("date") == F.lit("2024-01-01").cast("date")
    return B.executions(spark, sf).where(month).groupBy("cmo_id").agg(F.round(F.avg("quality_score"), 6).alias("avg_score"))


@query("batches_per_quarter", "SQL-6", """SELECT cmo_id, CAST(date_trunc('quarter', manufacturing_date) AS DATE) AS quarter, count(*) AS batch_count
FROM v_batches GROUP BY 1, 2""", ("v_batches",))
def batches_per_quarter(spark, sf):
    quarter = F.date_trunc("quarter", F.col("manufacturing_date")).cast("date")
    return B.batch_heads(spark, sf).groupBy("cmo_id", quarter.alias("quarter")).agg(F.count(F.lit(1)).alias("batch_count"))


@query("failed_checks_last_days", "SQL-7", """SELECT execution_id, contract_id FROM v_executions
WHERE NOT success AND ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY""", ("v_executions",))
def failed_checks_last_days(spark, sf):
    since = F.lit("2024-01-24").cast("timestamp_ntz")
    return B.executions(spark, sf).where(~F.col("success") & (F.col("ts") >= since)).select("execution_id", "contract_id")


@query("rank_by_yield", "SQL-8", """SELECT cmo_id, round(avg(yield_value), 2) AS avg_yield, rank() OVER (ORDER BY round(avg(yield_value), 2) DESC) AS place
FROM v_batches GROUP BY 1""", ("v_batches",))
def rank_by_yield(spark, sf):
    per = B.batch_heads(spark, sf).groupBy("cmo_id").agg(F.round(F.avg("yield_value"), 2).alias("avg_yield"))
    return global_rank(per, "avg_yield", "cmo_id", "place")


@query("sla_rate_by_domain", "SQL-9", """SELECT data_domain, round(avg(CASE WHEN execution_time_seconds / 3600 <= max_delay_hours THEN 100.0::DOUBLE ELSE 0 END), 6) AS sla_rate
FROM v_executions e JOIN v_contracts c ON c.contract_id = e.contract_id GROUP BY 1""", ("v_executions", "v_contracts"))
def sla_rate_by_domain(spark, sf):
    limits = B.contracts(spark, sf).select("contract_id", "data_domain", "max_delay_hours")
    met = F.when(F.col("execution_time_seconds") / 3600 <= F.col("max_delay_hours"), 100.0).otherwise(0.0)
    return B.executions(spark, sf).join(limits, "contract_id").groupBy("data_domain").agg(F.round(F.avg(met), 6).alias("sla_rate"))


@query("compare_two_suppliers", "SQL-10", """SELECT CAST(ts AS DATE) AS on_day, round(avg(quality_score) FILTER (WHERE cmo_id = 'cmo-1'), 6) AS first_score,
  round(avg(quality_score) FILTER (WHERE cmo_id = 'cmo-2'), 6) AS second_score FROM v_executions WHERE cmo_id IN ('cmo-1', 'cmo-2') GROUP BY 1""", ("v_executions",))
def compare_two_suppliers(spark, sf):
    rows = B.executions(spark, sf).where(F.col("cmo_id").isin("cmo-1", "cmo-2"))
    wide = rows.groupBy(F.col("ts").cast("date").alias("on_day")).pivot("cmo_id", ["cmo-1", "cmo-2"]).agg(F.round(F.avg("quality_score"), 6))
    return wide.select("on_day", F.col("`cmo-1`").alias("first_score"), F.col("`cmo-2`").alias("second_score"))


@query("recent_overdue_and_yield", "SQL-11", """SELECT 'overdue' AS kind, cmo_id AS name, CAST(count(*) AS DOUBLE) AS value FROM v_batches
  WHERE status = 'in_progress' AND manufacturing_date BETWEEN DATE '1999-05-31' AND DATE '1999-06-30'
  AND ((bmr IS NULL AND manufacturing_date + 5 < DATE '1999-06-30') OR (coa IS NULL AND manufacturing_date + 10 < DATE '1999-06-30')) GROUP BY 2
UNION ALL SELECT 'yield', product_id, round(avg(yield_value), 2) FROM v_batches WHERE manufacturing_date BETWEEN DATE '1999-05-31' AND DATE '1999-06-30' GROUP BY 2""", ("v_batches",))
def recent_overdue_and_yield(spark, sf):
    import datetime as dt

    from tenantlake.operators.batches import flag_overdue
    from tenantlake.operators.filters import has_overdue, standard_filters

    span = (dt.date(1999, 5, 31), dt.date(1999, 6, 30))
    recent = standard_filters(B.batches(spark, sf), date_range=span, date_col="manufacturing_date")
    slas = F.array(*[F.struct(F.lit(e).alias("element_type"), F.lit(d).alias("max_days")) for e, d in (("bmr", 5), ("coa", 10))])
    limits = B.contracts(spark, sf).select("contract_id", slas.alias("element_slas"))
    late = has_overdue(flag_overdue(recent, limits, F.lit(dt.datetime(1999, 6, 30))))
    overdue = late.groupBy(F.col("cmo_id").alias("name")).agg(F.count(F.lit(1)).cast("double").alias("value")).withColumn("kind", F.lit("overdue"))
    yields = recent.groupBy(F.col("product_id").alias("name")).agg(F.round(F.avg("yield_value"), 2).alias("value")).withColumn("kind", F.lit("yield"))
    return overdue.unionByName(yields)


# --- the SELECT surface over whole tables ---

statement("sql_inner_join", "SQL-12", "orders customer nation", """
SELECT n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
statement("sql_left_join", "SQL-12", "customer orders", """
SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
statement("sql_right_join", "SQL-12", "orders customer", """
SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'F'""")
statement("sql_full_join", "SQL-12", "supplier customer", """
SELECT s_suppkey, c_custkey, coalesce(s_name, c_name) AS name FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey""")
statement("sql_semi_join", "SQL-12", "customer orders", """
SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000""", """
SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000""")
statement("sql_anti_join", "SQL-12", "customer orders", """
SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000""", """
SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000""")
statement("sql_range_join", "SQL-13", "lineitem orders", """
SELECT o_orderpriority, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL 90 DAY
GROUP BY o_orderpriority""")
statement("sql_theta_join", "SQL-13", "lineitem part", """
SELECT p_brand, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > 20 * p_retailprice AND l_quantity <> p_size
GROUP BY p_brand""")
statement("sql_grouping", "SQL-14", "lineitem", """
SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts,
  sum(l_quantity) FILTER (WHERE l_discount > 0.05) AS discounted FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10""")
statement("sql_grouping_sets", "SQL-15", "lineitem", """
SELECT l_returnflag, l_linestatus, grouping_id(l_returnflag, l_linestatus) AS level, count(*) AS n FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""", """
SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n FROM lineitem
GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
statement("sql_cube_rollup", "SQL-15", "orders", """
SELECT 'cube' AS kind, o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)
UNION ALL SELECT 'rollup', o_orderstatus, o_orderpriority, count(*) FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
statement("sql_ranking_windows", "SQL-16", "orders", """
SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS quarter FROM orders
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""", """
SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS rn, CAST(rank() OVER w AS INTEGER) AS rk, CAST(dense_rank() OVER w AS INTEGER) AS dr,
  CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)""")
statement("sql_analytic_windows", "SQL-17", "orders", """
SELECT o_orderkey, lag(o_totalprice) OVER w AS before, lead(o_totalprice, 2) OVER w AS later, first_value(o_orderkey) OVER w AS first_key,
  last_value(o_orderkey) OVER w AS last_key, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS near,
  count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL 365 DAY PRECEDING AND CURRENT ROW) AS in_year
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
statement("sql_set_operations", "SQL-18", "customer supplier", """
SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) u
UNION ALL SELECT 'intersect', k FROM (SELECT c_custkey AS k FROM customer INTERSECT SELECT s_suppkey FROM supplier) i
UNION ALL SELECT 'except', k FROM (SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier) e""")
statement("sql_subqueries", "SQL-19", "orders customer lineitem", """
SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)
  AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)
  AND o_totalprice > (SELECT min(l_extendedprice) FROM lineitem WHERE l_orderkey = o_orderkey)""")
statement("sql_ordering_top_k", "SQL-20 SRT-2", "orders", """
SELECT * FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5) a
UNION ALL SELECT * FROM (SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) t WHERE rn <= 2) b""")
statement("sql_scalar_functions", "SQL-21", "customer orders", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, upper(substring(c_name, 1, 4)) AS head, length(c_name) AS size,
  c_name LIKE '%00001%' AS hit, concat_ws('-', c_mktsegment, CAST(c_nationkey AS STRING)) AS code, abs(floor(c_acctbal)) AS whole,
  year(o_orderdate) AS made_in, date_add(CAST(o_orderdate AS DATE), 30) AS due, array_join(array(c_mktsegment, o_orderstatus), '/') AS joined,
  element_at(map('a', o_orderstatus), 'a') AS mapped, get_json_object(concat('{"k": "', o_orderpriority, '"}'), '$.k') AS from_json
FROM customer JOIN orders ON o_custkey = c_custkey""", """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'credit' END AS side, upper(substring(c_name, 1, 4)) AS head, CAST(length(c_name) AS INTEGER) AS size,
  c_name LIKE '%00001%' AS hit, concat_ws('-', c_mktsegment, CAST(c_nationkey AS VARCHAR)) AS code, CAST(abs(floor(c_acctbal)) AS BIGINT) AS whole,
  CAST(year(o_orderdate) AS INTEGER) AS made_in, CAST(CAST(o_orderdate AS DATE) + 30 AS DATE) AS due, concat(c_mktsegment, '/', o_orderstatus) AS joined,
  o_orderstatus AS mapped, o_orderpriority AS from_json FROM customer JOIN orders ON o_custkey = c_custkey""")
