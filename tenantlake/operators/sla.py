"""Service levels: metric points, availability, compliance, period series and alarms."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.operators.windows import running_totals
from tenantlake.sources.sinks import ALERT_COLUMNS

# Metric period, consecutive periods and default run time.
PERIOD_SECONDS = 300
EVALUATION_PERIODS = 3
MAX_RUN_SECONDS = 3600.0


@dataclass(frozen=True)
class Alarm:
    name: str
    metric: str
    threshold: float
    above: bool
    severity: str

    @property
    def targets(self) -> tuple[str, ...]:
        return ("critical", "sla-breach") if self.severity == "critical" else ("warning",)


def execution_time_alarms(max_seconds: float = MAX_RUN_SECONDS, warning: float = 0.8,
                          critical: float = 1.0) -> list[Alarm]:
    return [Alarm("SLA-ExecutionTime-Warning", "ExecutionTime", max_seconds * warning, True, "warning"),
            Alarm("SLA-ExecutionTime-Critical", "ExecutionTime", max_seconds * critical, True, "critical")]


def quality_score_alarms(warning: float = 95.0, critical: float = 90.0) -> list[Alarm]:
    return [Alarm("SLA-QualityScore-Warning", "QualityScore", warning, False, "warning"),
            Alarm("SLA-QualityScore-Critical", "QualityScore", critical, False, "critical")]


def success_rate_alarms(warning: float = 99.0, critical: float = 95.0) -> list[Alarm]:
    return [Alarm("SLA-SuccessRate-Warning", "SuccessRate", warning, False, "warning"),
            Alarm("SLA-SuccessRate-Critical", "SuccessRate", critical, False, "critical")]


def all_alarms(max_seconds: float = MAX_RUN_SECONDS) -> list[Alarm]:
    return [*execution_time_alarms(max_seconds), *quality_score_alarms(), *success_rate_alarms()]


def pipeline_metrics(executions: DataFrame) -> DataFrame:
    """Three metric points per execution, in long form."""
    points = F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(c).cast("double").alias("value"), F.lit(u).alias("unit"))
        for m, c, u in (("ExecutionTime", "execution_time_seconds", "Seconds"),
                        ("RecordsProcessed", "records_processed", "Count"),
                        ("QualityScore", "quality_score", "Percent"))])
    return executions.select("ts", "contract_id", "cmo_id", F.inline(points)).select(
        "ts", "metric", "value", "unit", "contract_id", "cmo_id")


def availability(executions: DataFrame, contracts: DataFrame | None = None,
                 window: tuple[Column, Column] | None = None) -> DataFrame:
    """Per contract: executions, successes and success rate (= uptime); a contract never run scores 100.

    All executions count unless a ``window`` (from, to) narrows them.
    """
    rows = executions
    if window is not None:
        rows = rows.where((F.col("ts") >= window[0]) & (F.col("ts") < window[1]))
    counted = rows.groupBy("contract_id").agg(F.count(F.lit(1)).alias("total_executions"),
                                              F.count_if("success").alias("successful_executions"))
    if contracts is not None:
        counted = contracts.select("contract_id").join(counted, "contract_id", "left")
    total = F.coalesce("total_executions", F.lit(0).cast("bigint"))
    good = F.coalesce("successful_executions", F.lit(0).cast("bigint"))
    rate = F.coalesce(S.pct(good, total), F.lit(100.0))
    return counted.select("contract_id", total.alias("total_executions"), good.alias("successful_executions"),
                          rate.alias("success_rate"), rate.alias("uptime_percentage"))


def running_availability(executions: DataFrame) -> DataFrame:
    """The success rate after each execution of its contract, in (ts, execution_id) order."""
    one = F.when(F.col("success"), 1).otherwise(0)
    keyed = executions.where(F.col("contract_id").isNotNull())
    rows = running_totals(keyed, ["contract_id"], ["ts", "execution_id"],
                          {"executions_so_far": F.lit(1), "successes_so_far": one})
    return rows.withColumn("success_rate", S.pct(F.col("successes_so_far"), F.col("executions_so_far")))


def sla_compliance(executions: DataFrame, contracts: DataFrame) -> DataFrame:
    """Timeliness, quality and availability of each execution against its contract, with the breaches.

    ``contracts``: (contract_id, max_delay_hours, min_quality_score, uptime_percentage). A missing
    contract or threshold counts as met. Limits and availability, both one row per contract, are
    joined first, so executions are shuffled at most once.
    """
    uptime = availability(executions).select("contract_id", F.col("uptime_percentage").alias("actual_uptime"))
    limits = contracts.select(
        "contract_id", F.col("max_delay_hours").alias("max_hours"), F.col("min_quality_score").alias("min_score"),
        F.col("uptime_percentage").alias("min_uptime")).join(uptime, "contract_id", "left")
    hours = F.col("execution_time_seconds") / 3600
    late = F.coalesce(hours > F.col("max_hours"), F.lit(False))
    poor = F.coalesce(F.col("quality_score") < F.col("min_score"), F.lit(False))
    down = F.coalesce(F.col("actual_uptime") < F.col("min_uptime"), F.lit(False))

    def breach(flag: Column, kind: str, threshold: Column, actual: Column) -> Column:
        return F.when(flag, F.struct(F.lit(kind).alias("type"), threshold.cast("double").alias("threshold"),
                                     actual.cast("double").alias("actual")))

    breaches = F.array_compact(F.array(
        breach(late, "timeliness", F.col("max_hours"), S.round_to(hours, 4)),
        breach(poor, "quality", F.col("min_score"), F.col("quality_score")),
        breach(down, "availability", F.col("min_uptime"), F.col("actual_uptime"))))
    return executions.join(limits, "contract_id", "left").select(
        *executions.columns, (~late).alias("timeliness_ok"), (~poor).alias("quality_ok"),
        (~down).alias("availability_ok"), (~late & ~poor & ~down).alias("overall_compliant"),
        breaches.alias("breaches"))


def metric_series(metrics: DataFrame, period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    """Average per period, metric, tenant and contract."""
    slot = F.window("ts", f"{period_seconds} seconds")["start"].alias("period_start")
    return metrics.groupBy("metric", "cmo_id", "contract_id", slot).agg(F.avg("value").alias("value"))


def latest_value(series: DataFrame) -> DataFrame:
    """The newest period's value per metric, tenant and contract."""
    return series.groupBy("metric", "cmo_id", "contract_id").agg(
        F.max("period_start").alias("period_start"), F.max_by("value", "period_start").alias("value"))


def evaluate_alarms(series: DataFrame, alarms: Sequence[Alarm], periods: int = EVALUATION_PERIODS,
                    period_seconds: int = PERIOD_SECONDS) -> DataFrame:
    """Periods in which an alarm fires: it and the ``periods - 1`` before it all breach.

    A missing period does not breach, so among breaching periods only, an alarm fires where the one
    ``periods - 1`` places earlier is exactly that many periods old; no dense grid is needed. The
    alarms, a fixed short list, become an array per metric instead of a join.
    """
    chosen = F.lit(None)
    for metric in sorted({a.metric for a in alarms}):
        entries = F.array(*[F.struct(F.lit(a.name).alias("alarm_name"), F.lit(a.severity).alias("severity"),
                                     F.lit(float(a.threshold)).alias("threshold"), F.lit(a.above).alias("above"))
                            for a in alarms if a.metric == metric])
        chosen = F.when(F.col("metric") == metric, entries).otherwise(chosen)
    tested = series.select("*", F.inline(chosen))
    breaching = tested.where(F.when(F.col("above"), F.col("value") > F.col("threshold"))
                             .otherwise(F.col("value") < F.col("threshold")))
    order = Window.partitionBy("alarm_name", "metric", "cmo_id", "contract_id").orderBy("period_start")
    start = F.unix_timestamp(F.col("period_start").cast("timestamp"))
    since = F.lag(start, periods - 1).over(order) if periods > 1 else start
    return (breaching.withColumn("_span", start - since)
            .where(F.col("_span") == (periods - 1) * period_seconds)
            .select("alarm_name", "severity", "metric", "cmo_id", "contract_id", "period_start", "value", "threshold"))


def sla_alerts(compliance: DataFrame, severity: str = "critical", at: Column | None = None) -> DataFrame:
    """One alert row per breach."""
    if severity not in ("warning", "critical"):
        raise ValueError(f"severity must be 'warning' or 'critical', got: {severity}")
    at = F.current_timestamp() if at is None else at
    rows = compliance.select(at.alias("ts"), "contract_id", "cmo_id", F.explode("breaches").alias("b"))
    message = F.concat(F.col("b.type"), F.lit(" breach: actual "), F.col("b.actual").cast("string"),
                       F.lit(", threshold "), F.col("b.threshold").cast("string"))
    return rows.select("ts", F.concat(F.lit("sla_"), F.col("b.type")).alias("alert_type"),
                       F.lit(severity).alias("severity"), "contract_id", "cmo_id", message.alias("message"),
                       F.array().cast("array<string>").alias("failed_rules")).select(*ALERT_COLUMNS)
