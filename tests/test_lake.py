"""Sources, sinks, catalog tables, the gate and streams, on temporary folders."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenantlake.operators import filters, sla
from tenantlake.operators.quality import QualityRule
from tenantlake.operators.schema import TableSchema
from tenantlake.plans.flows import load_batch, silver_to_gold
from tenantlake.session import scratch, scratch_path, shared_dir, spread
from tenantlake.sources import readers, sinks
from tenantlake.sources.readers import SourceError
from tenantlake.sources.tables import VersionedTable
from tenantlake.streaming import streams
from tests.conftest import rows

AT = dt.datetime(2024, 6, 1, 10, 30, tzinfo=dt.timezone.utc)
DAY = AT.date()


def test_bronze_append_and_partition_reads(spark, tmp_path):
    root = str(tmp_path)
    for cmo, day in (("cmo-a", DAY), ("cmo-a", DAY), ("cmo-b", DAY), ("cmo-a", DAY + dt.timedelta(days=1))):
        sinks.write_bronze(spark.range(3), root, cmo, "batch-records", day)
    assert readers.read_bronze(spark, root, cmo_id="cmo-a", date=DAY).count() == 6
    assert readers.read_bronze(spark, root).count() == 12
    assert os.path.isdir(tmp_path / "bronze/cmo_id=cmo-a/data_domain=batch-records/year=2024/month=06/day=01")
    with pytest.raises(ValueError):
        sinks.write_bronze(spark.range(1), root, "alpha", "x", DAY)


def test_silver_rewrites_its_day_only(spark, tmp_path):
    root = str(tmp_path)
    other = dt.datetime(2024, 6, 2)
    assert sinks.promote_to_silver(spark.range(5), root, "cmo-a", "d", AT)[1] == 5
    sinks.promote_to_silver(spark.range(4), root, "cmo-a", "d", other)
    assert sinks.promote_to_silver(spark.range(2), root, "cmo-a", "d", AT)[1] == 2
    assert readers.read_silver(spark, root, date=DAY).count() == 2 and readers.read_silver(spark, root).count() == 6
    assert sinks.promote_to_silver(spark.range(0), root, "cmo-a", "d", AT) == (None, 0)
    assert readers.read_silver(spark, root, date=DAY).count() == 2
    assert "_validation_timestamp" in readers.read_silver(spark, root).columns


def test_quarantine_keeps_reasons_apart(spark, tmp_path):
    path, n = sinks.quarantine(spark.range(2), str(tmp_path), "C-1", "schema_validation_failure", AT)
    sinks.quarantine(spark.range(3), str(tmp_path), "C-1", "quality_check_failure", AT)
    sinks.quarantine(spark.range(2), str(tmp_path), "C-1", "schema_validation_failure", AT)  # a retry replaces
    assert n == 2 and path.endswith("bronze/quarantine/C-1/20240601T103000")
    assert rows(spark.read.parquet(path).groupBy("_quarantine_reason").count()) == [("quality_check_failure", 3), ("schema_validation_failure", 2)]


def test_gold_flow_registers_tables(spark, tmp_path):
    silver = spark.createDataFrame([("cmo-a", "d", 1.0, "PASS", AT.isoformat())], "cmo_id string, data_domain string, quantity double, quality_status string, _validation_timestamp string")
    done = silver_to_gold(silver, str(tmp_path), DAY, database="gold_test")
    again = silver_to_gold(silver, str(tmp_path), DAY, database="gold_test")
    assert done["tables_registered"] == again["tables_registered"] == ["batch_summary_daily_gold", "quality_metrics_monthly_gold", "cmo_performance_dashboard_gold"]
    assert spark.table("gold_test.batch_summary_daily_gold").select("record_count", "day").first() == (1, "01")
    silver_to_gold(silver, str(tmp_path), DAY + dt.timedelta(days=1), database="gold_test")  # one more partition of the same table
    assert rows(spark.table("gold_test.batch_summary_daily_gold").select("record_count", "day")) == [(1, "01"), (1, "02")]
    empty = silver_to_gold(silver.limit(0), str(tmp_path / "none"), DAY, database="gold_test")
    assert set(empty["paths"].values()) == {None} and empty["tables_registered"] == []


SCHEMA = TableSchema({"batch_id": "string", "quantity": "number"}, ("batch_id",))


@pytest.mark.parametrize("threshold,promoted,aside", [(90.0, 2, 1), (100.1, 0, 3)])
def test_gate_is_all_or_nothing(spark, tmp_path, threshold, promoted, aside):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "x"), (None, "3")], "batch_id string, quantity string")
    rules = [QualityRule("r", "n", "completeness", 'Completeness "batch_id"', threshold)]
    done = load_batch(df, str(tmp_path), "cmo-a", "d", "C-1", SCHEMA, rules, ["batch_id"], ["quantity"], AT, database="gate_test")
    assert (done.records_promoted, done.records_quarantined) == (promoted, aside)
    assert (done.catalog_table == "cmo_a_d_silver") is bool(promoted)
    if promoted:
        assert rows(spark.table("gate_test.cmo_a_d_silver").select("batch_id", "quantity")) == [("a", 2.0), ("b", 0.0)]


def test_delivered_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("batch_id,quantity\nB1,5\nB2,oops\n")
    (tmp_path / "a.json").write_text('[{"batch_id": "B1", "quantity": 1}, {"batch_id": "B2"}]')
    (tmp_path / "one.json").write_text('{"batch_id": "B9"}')
    assert readers.read_delivered(spark, str(tmp_path / "a.csv"), "CSV").dtypes == [("batch_id", "string"), ("quantity", "string")]
    typed = readers.read_delivered(spark, str(tmp_path / "a.csv"), "csv", SCHEMA.struct_type()).cache()
    assert typed.where("_corrupt_record is not null").count() == 1 and typed.count() == 2
    assert readers.read_delivered(spark, str(tmp_path / "a.json"), "json").count() == 2
    assert readers.read_delivered(spark, str(tmp_path / "one.json"), "json").count() == 1
    with pytest.raises(SourceError):
        readers.read_delivered(spark, str(tmp_path), "xml")


def test_jdbc_options():
    assert readers.jdbc_options({"connectionType": "oracle", "host": "h", "database": "d"})["url"] == "jdbc:oracle:thin:@h:1521/d"
    assert readers.jdbc_options({"connectionType": "sap", "port": 1, "database": "d"})["url"] == "jdbc:sap://localhost:1/?databaseName=d"
    assert readers.jdbc_options({"connectionType": "sqlserver", "connectionUrl": "jdbc:x"})["url"] == "jdbc:x"
    with pytest.raises(SourceError):
        readers.jdbc_options({"connectionType": "mysql"})
    assert readers.table_mappings({"database": "db"}, "Yield Data") == [("db", "yield-data")]
    assert readers.table_mappings({"tableMappings": [{"sourceTable": "t", "dataDomain": "A B"}]}, "d") == [("t", "a-b")]


def _drop(root, key, text="x"):
    path = os.path.join(root, key)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_manifest_and_acceptance(spark, tmp_path):
    root = str(tmp_path / "lake")
    _drop(root, "bronze/cmo-a/d/incoming/b1/coa/sub/f.CSV")
    _drop(root, "bronze/cmo-a/d/year=2024/x.exe")
    _drop(root, "bronze/cmo-a/d/noext")
    listed = {r["key"]: r for r in filters.accept_files(readers.list_files(spark, root)).collect()}
    f = listed["bronze/cmo-a/d/incoming/b1/coa/sub/f.CSV"]
    assert (f["layer"], f["cmo_id"], f["data_domain"], f["batch_id"], f["element_type"], f["incoming_name"], f["extension"], f["accepted"]) == (
        "bronze", "cmo-a", "d", "b1", "coa", "sub/f.CSV", ".csv", True)
    assert listed["bronze/cmo-a/d/year=2024/x.exe"]["reject_reason"].startswith("File extension '.exe' is not allowed")
    assert listed["bronze/cmo-a/d/noext"]["extension"] == "" and listed["bronze/cmo-a/d/noext"]["batch_id"] is None
    big = spark.createDataFrame([("f.csv", filters.MAX_FILE_BYTES + 1)], "path string, size long")
    assert "exceeds maximum" in filters.accept_files(big).first()["reject_reason"]


def test_versioned_table_ignores_unfinished_versions(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"))
    assert table.read("id long").count() == 0 and table.write(spark.range(1)) == 1
    assert table.write(table.read().unionByName(spark.range(1))) == 2
    os.makedirs(tmp_path / "t" / "version=3")
    assert table.read().count() == 2 and table.current_version() == 2 and table.write(spark.range(9)) == 4


def test_retention_keeps_unmatched_and_drops_expired(spark):
    df = spark.createDataFrame([("bronze/quarantine/x", DAY), ("other/x", DAY), ("bronze/x", DAY)], "key string, modified date")
    now = F.lit(DAY + dt.timedelta(days=100))
    assert rows(sinks.apply_retention(df, now).select("key", "retention")) == [("bronze/x", "archive"), ("other/x", "keep")]


def test_spread_is_one_rule(spark, tmp_path):
    spark.range(2_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    for df in (one, one.groupBy("id").count()):
        assert spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_scratch_goes_with_its_block(spark):
    with scratch(spark):
        path = scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        with scratch(spark):
            inner = scratch_path(spark, "y")
            spark.range(3).write.parquet(inner)
        assert os.path.isdir(path) and not os.path.exists(inner)
    assert not os.path.exists(path)


# --- streams ---

def test_ingest_stream(spark, tmp_path):
    root, out, state = str(tmp_path / "lake"), str(tmp_path / "out"), str(tmp_path / "state")
    lots = spark.createDataFrame([("b1", "LOT-1")], "batch_id string, lot_number string")
    at = F.lit(dt.datetime(2024, 6, 1))

    def run():
        streams.ingest_stream(spark, root, out, state, lots, at).awaitTermination()
        return spark.read.parquet(f"{out}/landed")

    _drop(root, "bronze/cmo-a/d/incoming/b1/coa/f.pdf")
    _drop(root, "bronze/cmo-a/d/incoming/b2/coa/g.csv")
    _drop(root, "bronze/cmo-a/d/incoming/b2/coa/h.exe")
    _drop(root, "bronze/cmo-a/d/f.csv")
    assert rows(run().select("destination_key")) == [("bronze/cmo-a/d/lot=LOT-1/year=2024/month=06/day=01/f.pdf",), ("bronze/cmo-a/d/lot=b2/year=2024/month=06/day=01/g.csv",)]
    _drop(root, "bronze/cmo-a/d/incoming/b3/coa/i.json")
    assert run().count() == 3 and spark.read.parquet(f"{out}/receipts").where("element_type = 'coa'").count() == 3


def test_document_stream(spark, tmp_path):
    src = tmp_path / "ocr"
    src.mkdir()
    for job, conf in (("j1", 99.0), ("j2", 10.0), ("j3", 99.0)):
        (src / f"{job}.json").write_text(json.dumps({"JobId": job, "Blocks": [{"Id": "1", "BlockType": "LINE", "Text": "hi", "Confidence": conf}]}))
    assert readers.read_ocr_json(spark, str(src)).where("size(blocks) = 1").count() == 3
    jobs = spark.createDataFrame([("j1", "cmo-a", "coa", "a.pdf"), ("j2", "cmo-a", "coa", "b.pdf")], "job_id string, cmo_id string, data_domain string, file_key string")
    streams.document_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state"), jobs, "lake", F.lit(dt.datetime(2024, 6, 1))).awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("doc_id", "destination")) == [("j1", "bronze"), ("j2", "manual_review")]


def test_document_stream_of_three_batches_leaves_no_scratch(spark, tmp_path):
    src = tmp_path / "ocr"
    src.mkdir()
    jobs = spark.createDataFrame([(f"j{i}", "cmo-a", "coa", f"{i}.pdf") for i in range(3)], "job_id string, cmo_id string, data_domain string, file_key string")
    before = set(os.listdir(shared_dir(spark).removeprefix("file:")))
    for i in range(3):
        (src / f"j{i}.json").write_text(json.dumps({"JobId": f"j{i}", "Blocks": [{"Id": "1", "BlockType": "LINE", "Text": "hi", "Confidence": 99.0}]}))
        streams.document_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "state"), jobs, "lake", F.lit(dt.datetime(2024, 6, 1))).awaitTermination()
    assert len(os.listdir(tmp_path / "out")) >= 3 and spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert set(os.listdir(shared_dir(spark).removeprefix("file:"))) == before


def test_quality_stream_drops_a_key_delivered_in_two_batches(spark, tmp_path):
    ddl = "id string, kind string, day string, ts timestamp"
    t = dt.datetime(2024, 1, 1)
    schema = TableSchema({"id": "string", "kind": "string", "day": "string"}, ("kind",))
    rules = [QualityRule("r", "known", "completeness", 'Completeness "id"', 99.0)]
    for i, ids in enumerate((["a", "b"], ["b", "c"], ["a", "d"])):
        spark.createDataFrame([(x, "k", f"d{i}", t + dt.timedelta(minutes=i)) for x in ids], ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    streams.quality_stream(src, schema, rules, ["id"], ["ts"], out, str(tmp_path / "state"), ts="ts", levels=["day"]).awaitTermination()
    silver = spark.read.option("basePath", f"{out}/silver").parquet(f"{out}/silver")
    assert rows(silver.select("id")) == [("a",), ("b",), ("c",), ("d",)] and "day" in silver.columns


def _points(spark, tmp_path, name, data):
    schema = "ts timestamp, metric string, cmo_id string, contract_id string, value double"
    spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(T._parse_datatype_string(schema)).parquet(str(tmp_path / name))


def test_windows_drop_late_points(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    m = ("QualityScore", "cmo-a", "C1")
    out, state = str(tmp_path / "rows"), str(tmp_path / "state")
    src = _points(spark, tmp_path, "in", [(t, *m, 10.0), (t + dt.timedelta(minutes=1), *m, 20.0), (t + dt.timedelta(minutes=40), *m, 1.0)])
    streams.run_to_parquet(streams.metric_windows(src), out, state)
    assert spark.read.parquet(out).first()["value"] == 15.0
    src = _points(spark, tmp_path, "in", [(t + dt.timedelta(minutes=2), *m, 99.0), (t + dt.timedelta(hours=2), *m, 1.0)])
    streams.run_to_parquet(streams.metric_windows(src), out, state)
    assert rows(spark.read.parquet(out).select("value")) == [(1.0,), (15.0,)]


def test_alarm_stream_matches_batch(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    data = [(t + dt.timedelta(minutes=5 * i), "QualityScore", "cmo-a", "C1", v) for i, v in enumerate([80.0, 80.0, 80.0, 80.0, 99.0, 80.0, 80.0, 99.0, 80.0, 80.0, 80.0])]
    data.append((t + dt.timedelta(hours=9), "QualityScore", "cmo-a", "C1", 100.0))
    alarms = sla.quality_score_alarms()
    src = _points(spark, tmp_path, "in", data)
    streams.run_to_parquet(streams.alarm_stream(src, alarms), str(tmp_path / "rows"), str(tmp_path / "state"))
    got = rows(spark.read.parquet(str(tmp_path / "rows")).select("alarm_name", "period_start"))
    batch = sla.evaluate_alarms(sla.metric_series(spark.read.parquet(str(tmp_path / "in"))), alarms)
    assert got == rows(batch.select("alarm_name", "period_start")) and len(got) == 6
