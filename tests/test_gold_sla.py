from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tenantlake.operators import gold, sla
from tenantlake.operators.gold import GoldError
from tenantlake.operators.windows import running_totals
from tests.conftest import rows

DDL = "batch_id string, product_name string, quantity string, quality_status string, cmo_id string, data_domain string, _validation_timestamp string"
SILVER = [("B001", "Aspirin", "100", "PASS", "cmo-alpha", "batch-records", "2024-06-01T10:00:00+00:00"),
          ("B002", "Ibuprofen", "200", "FAIL", "cmo-alpha", "batch-records", "2024-06-01T11:00:00+00:00"),
          ("B003", "Paracetamol", "150", "pass", "cmo-beta", "batch-records", "2024-06-15T09:00:00+00:00"),
          ("B004", "Aspirin", "300", "PASS", "cmo-beta", "quality-data", "2024-07-01T08:00:00+00:00"),
          ("B005", "Ibuprofen", "250", "FAIL", "cmo-alpha", "batch-records", "2024-07-01T12:00:00+00:00")]


@pytest.fixture
def silver(spark):
    return spark.createDataFrame(SILVER, DDL)


def test_batch_summary_periods(silver):
    daily = rows(gold.batch_summary(silver).select("period_start", "cmo_id", "data_domain", "record_count", "quantity_sum", "quantity_avg"))
    assert (dt.date(2024, 6, 1), "cmo-alpha", "batch-records", 2, 300.0, 150.0) in daily and len(daily) == 4
    weekly = gold.batch_summary(silver, "weekly").select("period_start").distinct()
    assert dt.date(2024, 5, 27) in [r[0] for r in weekly.collect()]
    assert gold.batch_summary(silver, "monthly").count() == 4


def test_batch_summary_missing_columns_bad_values_and_errors(spark, silver):
    bare = gold.batch_summary(silver.drop("quantity", "cmo_id", "data_domain"), "monthly").orderBy("period_start").first()
    assert bare.asDict() == {"period_start": dt.date(2024, 6, 1), "cmo_id": None, "data_domain": None, "record_count": 3,
                             "quantity_sum": 0.0, "quantity_avg": 0.0, "aggregation_period": "monthly"}
    dirty = silver.limit(2).withColumn("quantity", F.lit("n/a"))
    assert gold.batch_summary(dirty, "monthly").first()["quantity_avg"] == 0.0
    bad_time = silver.withColumn("_validation_timestamp", F.lit("not a time"))
    assert gold.batch_summary(bad_time).count() == 0
    with pytest.raises(GoldError):
        gold.batch_summary(silver, "hourly")
    with pytest.raises(GoldError):
        gold.batch_summary(silver, "daily", "nope")


def test_quality_trend(silver):
    got = rows(gold.quality_trend(silver).select("period_start", "cmo_id", "total_records", "pass_count", "fail_count", "pass_rate"))
    assert (dt.date(2024, 6, 1), "cmo-alpha", 2, 1, 1, 50.0) in got and (dt.date(2024, 7, 1), "cmo-beta", 1, 1, 0, 100.0) in got
    assert gold.quality_trend(silver.drop("quality_status")).agg(F.min("pass_rate")).first()[0] == 100.0


def test_scorecard(silver):
    got = {r["cmo_id"]: r for r in gold.supplier_scorecard(silver).collect()}
    assert got["cmo-beta"]["domain_count"] == 2 and got["cmo-alpha"]["pass_rate"] == 33.33
    assert got["cmo-alpha"]["avg_quantity"] == pytest.approx(550 / 3)
    alone = gold.supplier_scorecard(silver.drop("cmo_id", "data_domain", "quantity")).first()
    assert (alone["cmo_id"], alone["domain_count"], alone["avg_quantity"]) == ("unknown", 0, 0.0)


def test_null_groups_are_left_out(spark, silver):
    none = silver.withColumn("cmo_id", F.lit(None).cast("string"))
    assert gold.batch_summary(none).count() == 0 and gold.supplier_scorecard(none).count() == 0


def test_pass_rate_rounds_half_to_even(spark):
    df = spark.range(8).select(F.lit("c").alias("cmo_id"), F.when(F.col("id") < 1, "PASS").otherwise("FAIL").alias("quality_status"))
    assert gold.supplier_scorecard(df).first()["pass_rate"] == 12.5


def test_drill_down_needs_levels(silver):
    with pytest.raises(GoldError):
        gold.drill_down(silver, [], [])
    with pytest.raises(GoldError):
        gold.dataset(silver, "nope")


EXE = "execution_id int, contract_id string, cmo_id string, ts timestamp, success boolean, execution_time_seconds double, quality_score double, records_processed long"


def _runs(spark):
    t = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(1, "C1", "cmo-a", t, True, 3600.0 * 5, 97.0, 10), (2, "C1", "cmo-a", t + dt.timedelta(hours=1), False, 60.0, 90.0, 0),
                                  (3, "C1", "cmo-a", t + dt.timedelta(hours=2), True, 60.0, 99.0, 10), (4, "C9", "cmo-z", t, True, 99999.0, 1.0, 1)], EXE)


def test_compliance(spark):
    limits = spark.createDataFrame([("C1", 4.0, 95.0, 99.0), ("C2", None, None, None)],
                                   "contract_id string, max_delay_hours double, min_quality_score double, uptime_percentage double")
    got = {r["execution_id"]: r for r in sla.sla_compliance(_runs(spark), limits).collect()}
    assert [b["type"] for b in got[1]["breaches"]] == ["timeliness", "availability"] and got[1]["breaches"][0]["actual"] == 5.0
    assert [b["type"] for b in got[2]["breaches"]] == ["quality", "availability"] and got[2]["breaches"][1]["actual"] == 66.67
    assert got[4]["overall_compliant"] is True
    assert sla.sla_alerts(sla.sla_compliance(_runs(spark), limits)).count() == 5
    with pytest.raises(ValueError):
        sla.sla_alerts(sla.sla_compliance(_runs(spark), limits), "info")


def test_availability_of_contracts_never_run(spark):
    contracts = spark.createDataFrame([("C1",), ("C2",)], "contract_id string")
    assert rows(sla.availability(_runs(spark), contracts)) == [("C1", 3, 2, 66.67, 66.67), ("C2", 0, 0, 100.0, 100.0)]
    window = (F.lit("2024-01-01 00:30:00").cast("timestamp"), F.lit("2024-01-02").cast("timestamp"))
    assert sla.availability(_runs(spark), contracts, window).where("contract_id = 'C1'").first()["success_rate"] == 50.0


def test_running_availability(spark):
    got = sla.running_availability(_runs(spark)).where("contract_id = 'C1'").orderBy("ts").select("success_rate")
    assert [r[0] for r in got.collect()] == [100.0, 50.0, 66.67]


def test_running_totals_split_a_hot_key(spark):
    """Half of the rows share one key: it spreads over slices and still matches a plain window."""
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("k"), "id", (F.col("id") % 7).alias("v"))
    got = running_totals(df, ["k"], ["id"], {"total": F.col("v"), "n": F.lit(1)}, slices=8)
    plain = df.selectExpr("k", "id", "v", "sum(v) over (partition by k order by id) as total", "count(*) over (partition by k order by id) as n")
    assert got.exceptAll(plain).count() == 0 and got.count() == 20000
    ranges = df.repartitionByRange(8, "k", "id").select("k", F.spark_partition_id().alias("p")).where("k = 0").distinct().count()
    assert ranges > 1


def _series(spark, values, start=dt.datetime(2024, 1, 1)):
    data = [("ExecutionTime", "cmo-a", "C1", start + dt.timedelta(minutes=5 * i), v) for i, v in values]
    return spark.createDataFrame(data, "metric string, cmo_id string, contract_id string, period_start timestamp, value double")


@pytest.mark.parametrize("values,fires", [
    ([(0, 4000.0), (1, 4000.0), (2, 4000.0)], 1), ([(0, 4000.0), (1, 4000.0)], 0),
    ([(0, 4000.0), (2, 4000.0), (3, 4000.0)], 0), ([(0, 4000.0), (1, 10.0), (2, 4000.0), (3, 4000.0)], 0),
    ([(i, 4000.0) for i in range(5)], 3), ([(i, 3600.0) for i in range(5)], 0)])
def test_alarm_needs_consecutive_periods(spark, values, fires):
    critical = [a for a in sla.execution_time_alarms() if a.severity == "critical"]
    assert sla.evaluate_alarms(_series(spark, values), critical).count() == fires


def test_alarm_definitions():
    names = {a.name: (a.threshold, a.above, a.targets) for a in sla.all_alarms()}
    assert len(names) == 6 and names["SLA-ExecutionTime-Warning"][:2] == (2880.0, True)
    assert names["SLA-SuccessRate-Critical"] == (95.0, False, ("critical", "sla-breach"))


def test_metric_series_and_latest(spark):
    points = sla.pipeline_metrics(_runs(spark))
    series = sla.metric_series(points.unionByName(points.withColumn("value", F.col("value") + 2)))
    first = series.where("metric = 'QualityScore' and contract_id = 'C1'").orderBy("period_start").first()
    assert first["value"] == 98.0
    assert sla.latest_value(series).where("metric = 'QualityScore' and contract_id = 'C1'").first()["value"] == 100.0
