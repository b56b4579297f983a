from __future__ import annotations

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenantlake.operators import cleanse
from tenantlake.operators.cleanse import CleanseError
from tenantlake.operators.schema import TableSchema
from tests.conftest import rows

SCHEMA = TableSchema({"batch_id": "string", "product_name": "string", "quantity": "number", "quality_status": "string"},
                     ("batch_id", "product_name"))
DDL = "batch_id string, product_name string, quantity double, quality_status string"
BATCH = [("B001", "Aspirin", 100.0, "PASS"), ("B002", "Ibuprofen", 200.0, "FAIL"), ("B003", "Paracetamol", 150.0, "PASS")]


def test_split_valid_keeps_good_rows(spark):
    good, bad = cleanse.split_valid(spark.createDataFrame(BATCH, DDL), SCHEMA)
    assert good.count() == 3 and bad.count() == 0


def test_missing_required_column_fails_every_row(spark):
    df = spark.createDataFrame(BATCH, DDL).drop("product_name")
    good, bad = cleanse.split_valid(df, SCHEMA)
    assert good.count() == 0 and bad.count() == 3
    findings = [r[0] for r in cleanse.schema_findings(df, SCHEMA).collect()]
    assert findings == ["Missing required columns: ['product_name']"]


def test_null_in_required_field_is_set_aside(spark):
    df = spark.createDataFrame([*BATCH, (None, "X", 1.0, "PASS")], DDL).withColumn("extra", F.lit(1))
    good, bad = cleanse.split_valid(df, SCHEMA)
    assert good.count() == 3 and bad.count() == 1 and "extra" in good.columns
    findings = [r[0] for r in cleanse.schema_findings(df, SCHEMA).collect()]
    assert findings == ["Unexpected columns (will be kept): ['extra']", "1 records have null values in required fields"]


def test_empty_table(spark):
    silver, bad = cleanse.bronze_to_silver(spark.createDataFrame([], DDL), SCHEMA, ["batch_id"], ["quantity"])
    assert silver.count() == 0 and bad.count() == 0


@pytest.mark.parametrize("text,integer,number", [
    ("12", 12, 12.0), (" 12 ", 12, 12.0), ("1.5", None, 1.5), ("12.0", 12, 12.0), ("1e3", 1000, 1000.0), ("-7", -7, -7.0),
    ("abc", None, None), ("", None, None), ("1d", None, None), (None, None, None), ("9007199254740993", 9007199254740993, 9007199254740992.0)])
def test_number_coercion(spark, text, integer, number):
    df = spark.createDataFrame([(text, text)], "i string, n string")
    assert cleanse.convert_types(df, TableSchema({"i": "integer", "n": "number"})).first() == (integer, number)


@pytest.mark.parametrize("text,expected", [("true", True), ("YES", True), ("1", True), ("0", False), (" true", False),
                                           ("maybe", False), (None, None)])
def test_boolean_words(spark, text, expected):
    df = spark.createDataFrame([(text,)], "b string")
    assert cleanse.convert_types(df, TableSchema({"b": "boolean"})).first()[0] is expected


def test_convert_leaves_other_columns_and_null_strings(spark):
    df = spark.createDataFrame([(None, 3, [1])], "s string, n int, a array<int>")
    out = cleanse.convert_types(df, TableSchema({"s": "string", "n": "string", "a": "array", "gone": "integer"}))
    assert out.first() == (None, "3", [1]) and out.columns == ["s", "n", "a"]


def test_fill_nulls_by_type_and_explicit_default(spark):
    df = spark.createDataFrame([(None, None, None, None, None)], "r string, s string, i long, n double, b boolean")
    schema = TableSchema({"r": "string", "s": "string", "i": "integer", "n": "number", "b": "boolean"}, ("r",))
    assert cleanse.fill_nulls(df, schema).first() == (None, "", 0, 0.0, False)
    assert cleanse.fill_nulls(df, schema, {"r": "x", "n": 9.5}).first() == ("x", "", 0, 9.5, False)


def test_deduplicate_last_first_composite_and_null_keys(spark):
    df = spark.createDataFrame([("B1", 1, "a"), ("B1", 2, "b"), (None, 1, "c"), (None, 5, "d"), ("B2", 1, "e")],
                               "k string, seq int, v string")
    assert rows(cleanse.deduplicate(df, ["k"], ["seq"]).select("v")) == [("b",), ("d",), ("e",)]
    assert rows(cleanse.deduplicate(df, ["k"], ["seq"], "first").select("v")) == [("a",), ("c",), ("e",)]
    assert cleanse.deduplicate(df, ["k", "seq"], ["v"]).count() == 5
    with pytest.raises(CleanseError):
        cleanse.deduplicate(df, ["nope"], ["seq"])
    with pytest.raises(CleanseError):
        cleanse.deduplicate(df, ["k"], ["seq"], "middle")


def test_deduplicate_cuts_hot_keys_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    plan = cleanse.deduplicate(df, ["k"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)), st.integers(0, 9)), min_size=1, max_size=30))
def test_deduplicate_is_idempotent_and_picks_the_last(spark, data):
    df = spark.createDataFrame(data, "k int, v int")
    once = cleanse.deduplicate(df, ["k"], ["v"])
    best = {}
    for k, v in data:
        best[k] = max(best.get(k, -1), v)
    assert {r["k"]: r["v"] for r in once.collect()} == best
    assert rows(cleanse.deduplicate(once, ["k"], ["v"])) == rows(once)


def test_bronze_to_silver_and_metrics(spark):
    data = [*BATCH, ("B001", "Aspirin", 300.0, "PASS"), (None, "X", 1.0, "PASS"), ("B004", "Y", None, None)]
    df = spark.createDataFrame(data, DDL)
    at = dt.datetime(2024, 6, 1, tzinfo=dt.timezone.utc)
    silver, bad = cleanse.bronze_to_silver(df, SCHEMA, ["batch_id"], ["quantity"], at=at)
    got = {r["batch_id"]: r for r in silver.collect()}
    assert got["B001"]["quantity"] == 300.0 and got["B004"]["quantity"] == 0.0 and got["B004"]["quality_status"] == ""
    assert got["B001"]["_validation_timestamp"] == "2024-06-01T00:00:00+00:00" and bad.count() == 1
    assert cleanse.etl_metrics(df, SCHEMA, ["batch_id"]).drop("errors").first() == (6, 4, 1, 1)
    assert cleanse.etl_metrics(df, SCHEMA, ["batch_id"]).first()["errors"] == cleanse.schema_findings(df, SCHEMA).count()
    assert silver.count() + bad.count() + 1 == df.count()


def test_null_optional_keys_collapse_into_the_default(spark):
    schema = TableSchema({"id": "string", "k": "string"}, ("id",))
    df = spark.createDataFrame([("a", None), ("b", "")], "id string, k string")
    assert cleanse.bronze_to_silver(df, schema, ["k"], ["id"]).silver.count() == 1
    assert cleanse.etl_metrics(df, schema, ["k"]).first()["duplicates_removed"] == 1
