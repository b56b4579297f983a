"""The quality gate and what follows from a report: metrics, alerts, contract status."""

from __future__ import annotations

import datetime as dt
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.sources import sinks

# Why rows were set aside.
SCHEMA_FAILURE = "schema_validation_failure"
QUALITY_FAILURE = "quality_check_failure"


class GateOutcome(NamedTuple):
    records_promoted: int
    records_quarantined: int
    silver_path: str | None
    quarantine_path: str | None
    catalog_table: str | None
    report: dict


def gate(silver: DataFrame, invalid: DataFrame | None, report: DataFrame, root: str, cmo_id: str, domain: str,
         contract_id: str, at: dt.datetime, database: str | None = None) -> GateOutcome:
    """Promote the batch when its report passed, else quarantine all of it; invalid rows always go aside.

    ``report`` is the one-row report; only that row reaches the driver.
    """
    verdict = report.first().asDict()
    quarantined, promoted = 0, 0
    silver_path = quarantine_path = table = None
    if invalid is not None:
        quarantine_path, quarantined = sinks.quarantine(invalid, root, contract_id, SCHEMA_FAILURE, at)
    if verdict["passed"]:
        silver_path, promoted = sinks.promote_to_silver(silver, root, cmo_id, domain, at)
        if promoted and database:
            table = sinks.register_silver_table(silver.sparkSession, root, cmo_id, domain, database, at.date())
    else:
        path, rows = sinks.quarantine(silver, root, contract_id, QUALITY_FAILURE, at)
        quarantine_path, quarantined = quarantine_path or path, quarantined + rows
    return GateOutcome(promoted, quarantined, silver_path, quarantine_path, table, verdict)


def quality_metric_rows(reports: DataFrame, at: Column | None = None) -> DataFrame:
    """Four metric points per report (with contract_id, cmo_id); rule counts carry no tenant."""
    at = F.current_timestamp() if at is None else at
    none = F.lit(None).cast("string")
    points = F.array(*[
        F.struct(F.lit(metric).alias("metric"), value.cast("double").alias("value"), F.lit(unit).alias("unit"),
                 (F.col("cmo_id") if tenant else none).alias("tenant"))
        for metric, value, unit, tenant in (
            ("QualityScore", F.col("overall_score"), "Percent", True),
            ("RulesPassedCount", F.col("rules_passed"), "Count", False),
            ("RulesFailedCount", F.col("rules_failed"), "Count", False),
            ("ValidationResult", F.when(F.col("passed"), 1.0).otherwise(0.0), "Count", True))])
    return reports.select(at.alias("ts"), "contract_id", F.inline(points)).select(
        "ts", "metric", "value", "unit", "contract_id", F.col("tenant").alias("cmo_id"))


def quality_alerts(reports: DataFrame, contracts: DataFrame, results: DataFrame | None = None,
                   at: Column | None = None) -> DataFrame:
    """Alert rows: score under the contract's minimum, and failed error rules.

    ``contracts`` has (contract_id, min_quality_score), ``results`` the rule rows per contract_id; the
    failed rules of one report are a short list by construction.
    """
    at = F.current_timestamp() if at is None else at
    limits = contracts.select("contract_id", F.coalesce("min_quality_score", F.lit(0.0)).alias("min_score"),
                              F.lit(True).alias("_known"))
    rows = reports.join(limits, "contract_id", "left")
    empty = F.array().cast("array<struct<rule_id:string,severity:string>>")
    if results is not None:
        failed = results.where(~F.col("passed")).groupBy("contract_id").agg(
            F.array_sort(F.collect_list(F.struct("rule_id", "severity"))).alias("failed"))
        rows = rows.join(failed, "contract_id", "left").withColumn("failed", F.coalesce("failed", empty))
    else:
        rows = rows.withColumn("failed", empty)
    score, low = F.col("overall_score"), F.col("min_score")
    breach = F.when(F.coalesce(F.col("_known") & (score < low), F.lit(False)), F.struct(
        F.lit("sla_quality_breach").alias("alert_type"), F.lit("warning").alias("severity"),
        F.concat(F.lit("Quality score "), score.cast("string"), F.lit("% is below the SLA threshold of "),
                 low.cast("string"), F.lit("%. Review failed rules and resubmit data after corrections."))
        .alias("message"),
        F.transform("failed", lambda r: r["rule_id"]).alias("failed_rules")))
    errors = F.when(F.col("errors") > 0, F.struct(
        F.lit("error_rules_failed").alias("alert_type"), F.lit("critical").alias("severity"),
        F.concat(F.col("errors").cast("string"),
                 F.lit(" error-severity rule(s) failed. Contract will be suspended. Review the failed rules and "
                       "resubmit corrected data to reactivate.")).alias("message"),
        F.transform(F.filter("failed", lambda r: r["severity"] == "error"), lambda r: r["rule_id"])
        .alias("failed_rules")))
    return rows.select(at.alias("ts"), "contract_id", "cmo_id",
                       F.inline(F.array_compact(F.array(breach, errors)))).select(*sinks.ALERT_COLUMNS)


def next_contract_status(reports: DataFrame) -> DataFrame:
    """(contract_id, new_status): failed error rules suspend, a pass activates, otherwise null."""
    status = F.when(F.col("errors") > 0, "suspended").when(F.col("passed"), "active")
    return reports.select("contract_id", status.alias("new_status"))


def apply_contract_status(contracts: DataFrame, reports: DataFrame) -> DataFrame:
    """Contracts with the status their report implies; the caller writes it as the next table version."""
    implied = next_contract_status(reports)
    return (contracts.join(implied, "contract_id", "left")
            .withColumn("status", F.coalesce("new_status", "status")).drop("new_status"))
