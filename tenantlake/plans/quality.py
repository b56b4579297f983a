"""Registered queries: quality rules, reports, gate outcomes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import gate, keywords, quality
from tenantlake.operators.quality import QualityRule
from tenantlake.plans import bindings as B
from tenantlake.plans.registry import query

RULES = [
    QualityRule("r1", "batch id present", "completeness", 'Completeness "batch_id" > 0.99', 99.0),
    QualityRule("r2", "product present", "completeness", 'Completeness "product_id" > 0.99', 99.0, "warning"),
    QualityRule("r3", "gone column", "completeness", 'Completeness "missing" > 0.99', 99.0, "warning"),
    QualityRule("r4", "known notes", "accuracy", 'ColumnValues "note" in ["A", "N"]', 60.0),
    QualityRule("r5", "id shape", "accuracy", r'ColumnValues "batch_id" matches "B\d+-\d"', 95.0),
    QualityRule("r6", "quantity range", "accuracy", 'ColumnValues "quantity" between 0 and 25', 75.0, "warning"),
    QualityRule("r7", "anything", "accuracy", 'ColumnValues "note" unknown', 100.0),
    QualityRule("r8", "unique ids", "uniqueness", 'Uniqueness "batch_id" > 0.99', 70.0),
    QualityRule("r9", "row count", "consistency", "RowCount between 1 and 1000000000", 100.0),
    QualityRule("r10", "price over tax", "consistency", 'ColumnValues "price" >= "floor_price"', 90.0),
    QualityRule("r11", "own sql", "consistency", 'CustomSql "SELECT COUNT(*) FROM primary" > 0', 0.0, "warning"),
    QualityRule("r12", "no such type", "timeliness", "whatever", 10.0, "warning"),
]
NOW = dt.datetime(2001, 12, 31)


def _checked(spark, sf):
    return B.delivered(spark, sf).withColumn("floor_price", F.lit(5000.0))


_N = "TRY_CAST(quantity AS DOUBLE)"
_MEASURES = f"""count(*) AS n, count(product_id) AS products, count(note) AS notes,
  count(*) FILTER (WHERE note IN ('A', 'N')) AS known_notes,
  count(*) FILTER (WHERE regexp_full_match(batch_id, 'B\\d+-\\d')) AS shaped, count(quantity) AS quantities,
  count(*) FILTER (WHERE {_N} BETWEEN 0 AND 25) AS in_range, count(DISTINCT batch_id) AS ids,
  count(*) FILTER (WHERE price >= 5000) AS priced"""
_RULE_ROWS = """(VALUES (0, 'r1', 'error', 99.0), (1, 'r2', 'warning', 99.0), (2, 'r3', 'warning', 99.0),
  (3, 'r4', 'error', 60.0), (4, 'r5', 'error', 95.0), (5, 'r6', 'warning', 75.0), (6, 'r7', 'error', 100.0),
  (7, 'r8', 'error', 70.0), (8, 'r9', 'error', 100.0), (9, 'r10', 'error', 90.0), (10, 'r11', 'warning', 0.0),
  (11, 'r12', 'warning', 10.0)) AS rules(rule_order, rule_id, severity, threshold)"""
_ACTUAL = """CASE rule_order WHEN 0 THEN 100.0::DOUBLE WHEN 1 THEN products / n * 100 WHEN 2 THEN 0
  WHEN 3 THEN known_notes / notes * 100 WHEN 4 THEN shaped / n * 100 WHEN 5 THEN in_range / quantities * 100
  WHEN 6 THEN 100 WHEN 7 THEN ids / n * 100 WHEN 8 THEN n WHEN 9 THEN priced / n * 100 WHEN 10 THEN 100 ELSE 0 END"""


def _results(group: str) -> str:
    """Rule rows in SQL, measured per group."""
    by = f"{group}, " if group else ""
    grouped = f"GROUP BY {group}" if group else ""
    return f"""(SELECT {by}rule_order, rule_id, severity, CAST(threshold AS DOUBLE) AS threshold,
  CASE rule_order WHEN 8 THEN true WHEN 10 THEN true WHEN 11 THEN false ELSE actual >= threshold END AS passed,
  round_even(actual * 100, 0) / 100 AS actual_value FROM (
    SELECT *, CAST({_ACTUAL} AS DOUBLE) AS actual FROM (SELECT {by}{_MEASURES} FROM v_delivered {grouped}) m, {_RULE_ROWS}))"""


@query("quality_rules", "DQ-1 DQ-2 DQ-4 DQ-5 DQ-6 DQ-7 DQ-8 DQ-9 DQ-10 DQ-11 DQ-12 DQ-14", f"""
SELECT * FROM {_results('')}""", ("v_delivered",))
def quality_rules(spark, sf):
    return quality.evaluate_rules(_checked(spark, sf), RULES).select(
        "rule_order", "rule_id", "severity", "threshold", "passed", "actual_value")


@query("quality_rules_by_supplier", "DQ-14", f"SELECT * FROM {_results('cmo_id')}", ("v_delivered",))
def quality_rules_by_supplier(spark, sf):
    return quality.evaluate_rules(_checked(spark, sf), RULES, by=["cmo_id"]).select(
        "cmo_id", "rule_order", "rule_id", "severity", "threshold", "passed", "actual_value")


@query("completeness_all_columns", "DQ-3", """
SELECT round_even((count(batch_id) + count(product_id) + count(quantity) + count(note)) / (count(*) * 4) * 10000, 0) / 100
  AS actual_value FROM v_delivered""", ("v_delivered",))
def completeness_all_columns(spark, sf):
    rule = QualityRule("c", "cells", "completeness", "Completeness > 0.9", 90.0)
    cells = B.delivered(spark, sf).select("batch_id", "product_id", "quantity", "note")
    return quality.evaluate_rules(cells, [rule]).select("actual_value")


def _report(group: str) -> str:
    by = f"{group}, " if group else ""
    grouped = f"GROUP BY {group}" if group else ""
    return f"""(SELECT {by}round_even(count(*) FILTER (WHERE passed) / count(*) * 10000, 0) / 100 AS overall_score,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') = 0 AS passed,
  count(*) FILTER (WHERE passed) AS rules_passed, count(*) FILTER (WHERE NOT passed) AS rules_failed,
  count(*) FILTER (WHERE NOT passed AND severity = 'warning') AS warnings,
  count(*) FILTER (WHERE NOT passed AND severity = 'error') AS errors, count(*) AS total_rules
  FROM {_results(group)} {grouped})"""


@query("quality_report", "DQ-13", f"SELECT * FROM {_report('')}", ("v_delivered",))
def quality_report(spark, sf):
    return quality.quality_report(quality.evaluate_rules(_checked(spark, sf), RULES))


def _supplier_reports(spark, sf):
    """One report per supplier, the supplier's number standing for its contract."""
    results = quality.evaluate_rules(_checked(spark, sf), RULES, by=["cmo_id"])
    results = results.withColumn("contract_id", F.regexp_extract("cmo_id", r"(\d+)", 1).cast("bigint"))
    return quality.quality_report(results, by=["contract_id", "cmo_id"]), results


@query("quality_report_by_supplier", "DQ-13", f"SELECT * FROM {_report('cmo_id')}", ("v_delivered",))
def quality_report_by_supplier(spark, sf):
    return _supplier_reports(spark, sf)[0].drop("contract_id")


@query("quality_custom_sql", "DQ-11", """
SELECT 0 AS rule_order, true AS passed, CAST(count(*) AS DOUBLE) AS actual_value FROM v_delivered
UNION ALL SELECT 1, max(price) < 10, max(price) FROM v_delivered""", ("v_delivered",))
def quality_custom_sql(spark, sf):
    rules = [QualityRule("s1", "rows", "consistency", 'CustomSql "SELECT COUNT(*) FROM primary" > 0', 0.0),
             QualityRule("s2", "dear", "consistency", 'CustomSql "SELECT max(price) FROM primary" < 10', 0.0)]
    return quality.evaluate_rules(B.delivered(spark, sf), rules, strict=True).select(
        "rule_order", "passed", "actual_value")


@query("row_verdicts", "DQ-16", f"""
SELECT batch_id, ts, concat_ws(',', CASE WHEN product_id IS NULL THEN 'r2' END,
  CASE WHEN note IS NOT NULL AND note NOT IN ('A', 'N') THEN 'r4' END,
  CASE WHEN quantity IS NOT NULL AND NOT coalesce({_N} BETWEEN 0 AND 25, false) THEN 'r6' END,
  CASE WHEN price < 5000 THEN 'r10' END) AS failed_rules FROM v_delivered""", ("v_delivered",))
def row_verdicts(spark, sf):
    chosen = [r for r in RULES if r.rule_id in ("r1", "r2", "r4", "r5", "r6", "r10")]
    return quality.row_verdicts(_checked(spark, sf), chosen).select(
        "batch_id", "ts", F.array_join("failed_rules", ",").alias("failed_rules"))


@query("rulesets_by_contract", "DQ-15", """
SELECT contract_id, concat('Rules = [', chr(10), '    Completeness "c', contract_id % 3, '" > 0.9', ',', chr(10),
  '    RowCount between 1 and ', contract_id + 1, chr(10), ']') AS ruleset FROM v_contracts""", ("v_contracts",))
def rulesets_by_contract(spark, sf):
    key = F.col("contract_id")
    lines = F.array(F.concat(F.lit(' Completeness "c'), (key % 3).cast("string"), F.lit('" > 0.9 ')),
                    F.concat(F.lit("RowCount between 1 and "), (key + 1).cast("string")))
    rules = B.contracts(spark, sf).select("contract_id", F.posexplode(lines).alias("rule_order", "expression"))
    return quality.build_rulesets(rules, ["contract_id"])


@query("keyword_rules", "DQ-20 DQ-21 DQ-22 DQ-23 DQ-24 DQ-25 DQ-26 DQ-27 DQ-28 DQ-30 DQ-31", f"""
WITH m AS (SELECT count(*) AS n, count(note) AS notes, count(DISTINCT batch_id) AS ids,
  count(DISTINCT note) AS kinds, count(*) FILTER (WHERE price > 20000) AS dear,
  count(*) FILTER (WHERE {_N} = floor({_N})) AS whole, count(quantity) AS quantities,
  avg({_N}) AS mean, sum({_N}) AS total, stddev_samp({_N}) AS sd, corr({_N}, price) AS r, max(ts) AS newest,
  count(*) = count(DISTINCT (batch_id, ts, price, cmo_id)) AS is_key FROM v_delivered)
SELECT rule_order, round(CAST(actual AS DOUBLE), 4) AS actual_value, passed FROM (
  SELECT 0 AS rule_order, 1.0 AS actual, true AS passed FROM m
  UNION ALL SELECT 1, dear / n, dear / n = 1.0 FROM m UNION ALL SELECT 2, 1, true FROM m
  UNION ALL SELECT 3, (ids = n)::INT, ids = n FROM m UNION ALL SELECT 4, is_key::INT, is_key FROM m
  UNION ALL SELECT 5, whole / quantities, whole / quantities > 0.5 FROM m
  UNION ALL SELECT 6, 1.0, true FROM m UNION ALL SELECT 7, r, r BETWEEN -0.5 AND 0.9 FROM m
  UNION ALL SELECT 8, sd, sd < 100 FROM m UNION ALL SELECT 9, mean, mean > 10 FROM m
  UNION ALL SELECT 10, total, total > 0 FROM m UNION ALL SELECT 11, kinds, kinds = 3 FROM m
  UNION ALL SELECT 12, date_diff('hour', newest, TIMESTAMP '2001-12-31'),
    date_diff('hour', newest, TIMESTAMP '2001-12-31') <= 2400 FROM m
  UNION ALL SELECT 13, n, n > 100 FROM m UNION ALL SELECT 14, notes / n, notes / n > 0.9 FROM m
  UNION ALL SELECT 15, ids / n, ids / n > 0.99 FROM m)""", ("v_delivered",))
def keyword_rules(spark, sf):
    texts = ['ColumnExists "note"', 'ColumnValues "price" > 20000', 'IsComplete "batch_id"', 'IsUnique "batch_id"',
             'IsPrimaryKey "batch_id" "ts" "price" "cmo_id"', 'ColumnDataType "quantity" "bigint" > 0.5',
             'ColumnNamesMatchPattern "[a-z]+(_id)?"', 'ColumnCorrelation "quantity" "price" between -0.5 and 0.9',
             'StandardDeviation "quantity" < 100', 'Mean "quantity" > 10', 'Sum "quantity" > 0',
             'DistinctValuesCount "note" = 3', 'DataFreshness "ts" <= 100 days', "RowCount > 100",
             'Completeness "note" > 0.9', 'Uniqueness "batch_id" > 0.99']
    return keywords.evaluate_keywords(B.delivered(spark, sf), texts, now=NOW).select(
        "rule_order", F.round("actual_value", 4).alias("actual_value"), "passed")


@query("keyword_rules_distribution", "DQ-29 DQ-30", """
WITH c AS (SELECT part_key, CAST(count(*) AS DOUBLE) AS n FROM v_batch_records GROUP BY 1),
s AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM v_batch_records GROUP BY batch_id)
SELECT 0 AS rule_order, round((SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM c), 4) AS actual_value, true AS passed
UNION ALL SELECT 1, round((SELECT count(*) FILTER (WHERE n = 1) / count(*) FROM s), 4), false""", ("v_batch_records",))
def keyword_rules_distribution(spark, sf):
    texts = ['Entropy "part_key" > 1', 'UniqueValueRatio "batch_id" > 0.999']
    return keywords.evaluate_keywords(B.batch_records(spark, sf), texts).select(
        "rule_order", F.round("actual_value", 4).alias("actual_value"), "passed")


@query("keyword_rules_references", "DQ-32 DQ-33 DQ-34 DQ-35", """
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders),
b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 10 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS p,
  o_orderstatus AS s FROM orders WHERE o_orderkey % 7 <> 0)
SELECT 0 AS rule_order, round((SELECT count(*) FILTER (WHERE k IN (SELECT k FROM b)) / count(*) FROM a), 4) AS actual_value, false AS passed
UNION ALL SELECT 1, round((SELECT count(*) FILTER (WHERE b.p = a.p AND b.s = a.s) / count(*) FROM a FULL JOIN b ON a.k = b.k), 4), true
UNION ALL SELECT 2, 1.0, true
UNION ALL SELECT 3, round((SELECT count(*) FROM a) / (SELECT count(*) FROM b), 4), false
UNION ALL SELECT 4, round((SELECT max(k) FROM a) / (SELECT max(k) FROM b), 4), true""")
def keyword_rules_references(spark, sf):
    o = B.table(spark, sf, "orders")
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    a = o.select(key.alias("k"), price.alias("p"), F.col("o_orderstatus").alias("s"))
    b = (o.where(key % 7 != 0)
         .select(key.alias("k"), F.when(key % 10 == 0, price + 1).otherwise(price).alias("p"), F.col("o_orderstatus").alias("s")))
    texts = ['ReferentialIntegrity "k" "b.k" > 0.9', 'DatasetMatch "b" "k" > 0.7', 'SchemaMatch "b" = 1.0',
             'RowCountMatch "b" = 1.0', 'AggregateMatch "max(k)" "max(b.k)" between 0.99 and 1.01']
    return keywords.evaluate_keywords(a, texts, {"b": b}).select(
        "rule_order", F.round("actual_value", 4).alias("actual_value"), "passed")


@query("quality_metric_points", "QG-2 SNK-8", f"""
SELECT metric, value, unit, contract_id, cmo_id FROM (
  SELECT CAST(regexp_extract(cmo_id, '(\\d+)', 1) AS BIGINT) AS contract_id,
    unnest([{{'metric': 'QualityScore', 'value': overall_score, 'unit': 'Percent', 'cmo_id': cmo_id}},
            {{'metric': 'RulesPassedCount', 'value': CAST(rules_passed AS DOUBLE), 'unit': 'Count', 'cmo_id': NULL}},
            {{'metric': 'RulesFailedCount', 'value': CAST(rules_failed AS DOUBLE), 'unit': 'Count', 'cmo_id': NULL}},
            {{'metric': 'ValidationResult', 'value': CAST(passed::INT AS DOUBLE), 'unit': 'Count', 'cmo_id': cmo_id}}],
      max_depth := 2) FROM {_report('cmo_id')})""", ("v_delivered",))
def quality_metric_points(spark, sf):
    return gate.quality_metric_rows(_supplier_reports(spark, sf)[0], F.lit(NOW)).drop("ts")


@query("quality_alerts", "QG-3 SNK-9", f"""
SELECT alert_type, severity, contract_id, cmo_id, failed_rules FROM (
  SELECT 'sla_quality_breach' AS alert_type, 'warning' AS severity, r.contract_id, r.cmo_id, f.all_failed AS failed_rules
  FROM r JOIN v_contracts c ON c.contract_id = r.contract_id JOIN f ON f.cmo_id = r.cmo_id
  WHERE overall_score < min_quality_score
  UNION ALL SELECT 'error_rules_failed', 'critical', r.contract_id, r.cmo_id, f.error_failed
  FROM r JOIN f ON f.cmo_id = r.cmo_id WHERE errors > 0)""".replace("FROM (\n  SELECT 'sla", "FROM (\n  WITH r AS (SELECT *, CAST(regexp_extract(cmo_id, '(\\d+)', 1) AS BIGINT) AS contract_id FROM " + _report("cmo_id") + "),\n  f AS (SELECT cmo_id, string_agg(rule_id, ',' ORDER BY rule_id) FILTER (WHERE NOT passed) AS all_failed, string_agg(rule_id, ',' ORDER BY rule_id) FILTER (WHERE NOT passed AND severity = 'error') AS error_failed FROM " + _results("cmo_id") + " GROUP BY cmo_id)\n  SELECT 'sla"),
       ("v_delivered", "v_contracts"))
def quality_alerts(spark, sf):
    reports, results = _supplier_reports(spark, sf)
    alerts = gate.quality_alerts(reports, B.contracts(spark, sf), results, F.lit(NOW))
    return alerts.select("alert_type", "severity", "contract_id", "cmo_id",
                         F.array_join("failed_rules", ",").alias("failed_rules"))


@query("contract_status_after_quality", "QG-4", f"""
SELECT c.contract_id, CASE WHEN errors > 0 THEN 'suspended' WHEN passed THEN 'active' ELSE status END AS status
FROM v_contracts c LEFT JOIN (SELECT *, CAST(regexp_extract(cmo_id, '(\\d+)', 1) AS BIGINT) AS contract_id
  FROM {_report('cmo_id')}) r ON r.contract_id = c.contract_id""", ("v_delivered", "v_contracts"))
def contract_status_after_quality(spark, sf):
    return gate.apply_contract_status(B.contracts(spark, sf), _supplier_reports(spark, sf)[0]).select(
        "contract_id", "status")
