"""Schemas, contracts, paths and the SQL guard."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenantlake.functions import paths as P
from tenantlake.operators import contracts, schema
from tenantlake.operators import sqlsurface as Q
from tenantlake.operators.schema import SchemaError, TableSchema
from tests.conftest import rows

NOW = dt.datetime(2024, 1, 1)


def test_csv_inference(spark):
    data = [("1", "1.5", "true", "x", "2024-01-01", "", "0", "nan"), ("2", "2", "0", "7", "2024-01-02", " ", "1", "1e5"), (" 3 ", "", "FALSE", "y", None, None, "1", "-.5")]
    df = spark.createDataFrame(data, "i string, n string, b string, t string, d string, blank string, flags string, odd string")
    assert {r["field"]: (r["type"], r["required"]) for r in schema.infer_csv_schema(df).collect()} == {
        "i": ("integer", True), "n": ("number", False), "b": ("boolean", True), "t": ("string", True), "d": ("string", False),
        "blank": ("string", False), "flags": ("boolean", True), "odd": ("number", True)}
    assert {r["type"] for r in schema.infer_csv_schema(df.limit(0)).collect()} == {"string"}
    with pytest.raises(SchemaError):
        schema.infer_csv_schema(spark.createDataFrame([("a",)], "` ` string"))


def test_json_inference(spark):
    docs = ['{"a": 1, "b": 1, "c": null, "d": true, "e": [1], "f": {"x": 1}, "g": 1.0}', '{"a": 2.5, "b": "x", "c": 1, "d": false, "e": [], "f": {}, "g": 2.0}', "[1]"]
    got = {r["field"]: (r["type"], r["required"]) for r in schema.infer_json_schema(spark.createDataFrame([(d,) for d in docs[:2]], "json string")).collect()}
    assert got == {"a": ("number", True), "b": ("string", True), "c": ("string", True), "d": ("boolean", True), "e": ("array", True),
                   "f": ("object", True), "g": ("number", True)}
    partial = schema.infer_json_schema(spark.createDataFrame([(d,) for d in docs], "json string")).where("field = 'a'").first()
    assert partial["required"] is False


def test_parquet_and_first_row_inference(spark):
    df = spark.createDataFrame([(1, 1.0, True, "x", dt.date(2024, 1, 1), [1])], "i int, n double, b boolean, s string, d date, a array<int>")
    assert [r["type"] for r in schema.infer_schema(df, "parquet").collect()] == ["integer", "number", "boolean", "string", "string", "string"]
    text = spark.createDataFrame([("2", "b", "x"), ("1", "7", "1.5")], "k string, v string, w string")
    assert rows(schema.infer_first_row_schema(text, ["k"])) == [("k", "integer", True), ("v", "integer", True), ("w", "double", True)]
    docs = spark.createDataFrame([('{"a": 1, "b": 2.5}', 1)], "doc string, n int")
    assert rows(schema.infer_first_record_schema(docs, "doc", ["n"])) == [("a", "integer", True), ("b", "double", True)]
    with pytest.raises(SchemaError):
        schema.infer_schema(df, "xml")


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.dictionaries(st.sampled_from("abc"), st.sampled_from(["string", "integer", "number", "boolean"]), min_size=1), min_size=1, max_size=4))
def test_merge_equals_pairwise_folding(spark, schemas):
    def widest(a, b):
        return a if a == b else ("number" if {a, b} == {"integer", "number"} else "string")
    folded = {}
    for s in schemas:
        for f, t in s.items():
            folded[f] = widest(folded[f], t) if f in folded else t
    df = spark.createDataFrame([(i, f, t) for i, s in enumerate(schemas) for f, t in s.items()], "schema_id int, field string, type string")
    got = {r["field"]: (r["type"], r["required"]) for r in schema.merge_schemas(df, len(schemas)).collect()}
    assert got == {f: (t, all(f in s for s in schemas)) for f, t in folded.items()}


def test_registry_versions(spark, tmp_path):
    registry = schema.registry_at(spark, str(tmp_path / "registry"))
    one, two = TableSchema({"a": "integer"}, ("a",)), TableSchema({"a": "number", "b": "string"}, ())
    assert schema.register_schema(registry, "s", one) == 1 and schema.register_schema(registry, "s", two) == 2
    assert schema.register_schema(registry, "other", one, "AVRO") == 1
    assert schema.get_schema(registry, "s").properties == {"a": "number", "b": "string"}
    assert schema.get_schema(registry, "s", 1).required == ("a",) and schema.get_schema(registry, "s", "1").properties == {"a": "integer"}
    for bad in (lambda: schema.get_schema(registry, "gone"), lambda: schema.get_schema(registry, "s", 9), lambda: schema.register_schema(registry, "s", one, "XML")):
        with pytest.raises(SchemaError):
            bad()
    assert schema.editor_schema_name("cmo-A", "Batch Records") == "cmo-a-batch-records"
    assert TableSchema.from_json_schema(two.to_json_schema()) == two and TableSchema.from_fields(one.fields_view()) == one
    assert [f.dataType.simpleString() for f in two.struct_type()] == ["double", "string"]


def test_compatibility(spark):
    def frame(**fields):
        return TableSchema({n: t.rstrip("!") for n, t in fields.items()}, tuple(n for n, t in fields.items() if t.endswith("!"))).to_rows(spark)
    old = frame(a="integer!", b="string")
    cases = [(frame(a="number!", b="string", c="string"), "BACKWARD", True), (frame(b="string"), "BACKWARD", False), (frame(a="integer!", b="integer"), "BACKWARD", False),
             (frame(a="integer!", b="string", c="string!"), "BACKWARD", False), (frame(a="number!", b="string"), "FORWARD", False),
             (frame(a="integer!", b="string", c="string"), "FULL", True), (frame(a="number!", b="string"), "FULL", False)]
    for new, mode, ok in cases:
        assert schema.check_compatibility(old, new, mode, "s").first()["compatible"] is ok, (mode, ok)
    with pytest.raises(SchemaError):
        schema.check_compatibility(old, old, "SIDEWAYS")


GOOD = {"cmoId": "cmo-a", "dataDomain": "d", "schemaId": "s", "schemaVersion": "1",
        "qualityRules": [{"ruleId": "r", "ruleName": "n", "ruleType": "accuracy", "expression": "IsComplete \"a\"", "threshold": 0, "severity": "warning"}],
        "sla": {"timeliness": {"maxDelayHours": 24, "measurementWindow": "d"}, "availability": {"uptimePercentage": 99.5, "measurementWindow": "m"},
                "quality": {"minQualityScore": 95, "measurementWindow": "x"}},
        "deliverySchedule": {"frequency": "daily"},
        "governance": {"dataClassification": "public", "retentionYears": 7, "allowedUsers": [], "allowedGroups": [], "piiFields": [], "encryptionRequired": True}}


def _with(path, value):
    doc = json.loads(json.dumps(GOOD))
    node = doc
    for key in path[:-1]:
        node = node[key]
    if value is KeyError:
        del node[path[-1]]
    else:
        node[path[-1]] = value
    return doc


RULE = ("qualityRules", 0)
DEFECTS = [
    (("cmoId",), KeyError, "Missing required field: cmoId"), (("sla",), None, "Missing required field: sla"), (("cmoId",), 5, "cmoId must be a non-empty string"),
    (("schemaVersion",), " ", "schemaVersion must be a non-empty string"), (("qualityRules",), {}, "qualityRules must be a list"),
    (("qualityRules",), [], "qualityRules must contain at least one rule"), (RULE, "x", "qualityRules[0]: must be a dictionary"),
    ((*RULE, "ruleName"), KeyError, "qualityRules[0]: missing required field 'ruleName'"), ((*RULE, "threshold"), "9", "qualityRules[0]: threshold must be a number"),
    ((*RULE, "threshold"), -1, "qualityRules[0]: threshold must be between 0 and 100"), ((*RULE, "threshold"), 100.5, "qualityRules[0]: threshold must be between 0 and 100"),
    ((*RULE, "severity"), "fatal", "qualityRules[0]: invalid severity 'fatal'. Must be one of ['error', 'warning']"),
    ((*RULE, "ruleType"), "speed", "qualityRules[0]: invalid ruleType 'speed'. Must be one of ['accuracy', 'completeness', 'consistency', 'uniqueness']"),
    (("sla",), [], "sla must be a dictionary"), (("sla", "quality"), KeyError, "sla: missing required section 'quality'"), (("sla", "quality"), 1, "sla.quality must be a dictionary"),
    (("sla", "timeliness", "maxDelayHours"), KeyError, "sla.timeliness: missing 'maxDelayHours'"),
    (("sla", "timeliness", "maxDelayHours"), "2", "sla.timeliness.maxDelayHours must be a positive number"),
    (("sla", "availability", "uptimePercentage"), 101, "sla.availability.uptimePercentage must be between 0 and 100"),
    (("sla", "quality", "measurementWindow"), KeyError, "sla.quality: missing 'measurementWindow'"),
    (("sla", "quality", "measurementWindow"), "", "sla.quality: measurementWindow must be a non-empty string"),
    (("deliverySchedule",), "daily", "deliverySchedule must be a dictionary"), (("deliverySchedule", "frequency"), KeyError, "deliverySchedule: missing required field 'frequency'"),
    (("deliverySchedule", "cronExpression"), "", "deliverySchedule: cronExpression must be a non-empty string"),
    (("deliverySchedule", "cronExpression"), "* * *", "deliverySchedule: cronExpression is not a valid cron format. Expected 5 or 6 space-separated fields"),
    (("governance",), 1, "governance must be a dictionary"), (("governance", "dataClassification"), KeyError, "governance: missing required field 'dataClassification'"),
    (("governance", "retentionYears"), 0, "governance: retentionYears must be a positive integer"), (("governance", "retentionYears"), 7.0, "governance: retentionYears must be a positive integer"),
    (("governance", "allowedUsers"), "bob", "governance: allowedUsers must be a list"), (("governance", "piiFields"), KeyError, "governance: missing required field 'piiFields'"),
    (("governance", "encryptionRequired"), "yes", "governance: encryptionRequired must be a boolean"),
    (("governance", "encryptionRequired"), None, "governance: missing required field 'encryptionRequired'"),
]


def test_contract_defects(spark):
    docs = [(-1, json.dumps(GOOD)), (-2, "not json")] + [(i, json.dumps(_with(p, v))) for i, (p, v, _) in enumerate(DEFECTS)]
    got = {r["i"]: r for r in contracts.validate_contracts(spark.createDataFrame(docs, "i int, doc string")).collect()}
    assert got[-1]["errors"] == [] and got[-1]["is_valid"] and len(got[-2]["errors"]) == 8
    for i, (_, _, text) in enumerate(DEFECTS):
        assert got[i]["errors"] == [text] and not got[i]["is_valid"], (i, text, got[i]["errors"])


@pytest.mark.parametrize("name,expected", [("alpha", "ALPHA"), ("Alpha  Pharma", "ALPHA-PHARMA"), ("--a- -b-", "A-B"), (" ", "UNKNOWN"), ("", "UNKNOWN")])
def test_name_part(spark, name, expected):
    assert spark.createDataFrame([(name,)], "n string").select(contracts.name_part(F.col("n"))).first()[0] == expected


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet="abcXYZ019 -", max_size=12), st.sampled_from(["batch-records", "q"]), st.integers(1, 999))
def test_contract_ids_are_well_formed(spark, name, domain, number):
    made = spark.createDataFrame([(name, domain, number)], "n string, d string, i int").select(contracts.contract_id(F.col("n"), F.col("d"), F.col("i")).alias("c"))
    got = made.select("c", contracts.contract_id_valid(F.col("c")), contracts.parse_contract_id(F.col("c"))["number"]).first()
    assert got[1] is True and got[2] == number


def test_contract_id_numbers(spark):
    df = spark.createDataFrame([("cmo-a", "x", i) for i in range(3)], "cmo_id string, data_domain string, n int")
    existing = spark.createDataFrame([("cmo-a", "x")] * 998, "cmo_id string, data_domain string")
    ids = [r["contract_id"] for r in contracts.assign_contract_ids(df, existing, ["n"]).orderBy("n").collect()]
    assert ids == ["CMO-CMO-A-X-999", "CMO-CMO-A-X-1000", "CMO-CMO-A-X-1001"]


def test_transitions_and_unknown_contracts(spark):
    df = spark.createDataFrame([("a", "draft"), ("b", "active"), ("c", "draft")], "contract_id string, status string")
    acts = spark.createDataFrame([("a", "submit", "x"), ("b", "submit", "x"), ("z", "approve", "x"), ("c", "fly", "x")], "contract_id string, action string, actor string")
    got = {r["contract_id"]: (r["status"], r["error"]) for r in contracts.apply_transitions(df, acts, F.lit(NOW)).collect()}
    assert got["a"] == ("pending_cmo_review", None) and got["b"] == ("active", "Cannot submit contract in status: active")
    assert got["z"][1] == "Contract 'z' not found" and got["c"] == ("draft", "Unknown action: fly")


def test_deployable_order_of_checks(spark):
    df = spark.createDataFrame([("c", None, "d", None, "active"), ("c", "cmo-a", "d", "odd", "draft"), ("c", "cmo-a", "d", "odd", "active"), ("c", "cmo-a", "d", "secure-transfer", "active")],
                               "contract_id string, cmo_id string, data_domain string, integration_pattern string, status string")
    got = [r["errors"] for r in contracts.deployable(df).collect()]
    assert got[0] == ["Missing required field: cmoId", "Missing required field: integrationPattern"] and got[3] == []
    assert got[1][0].startswith("Contract must be 'active'") and got[2][0].startswith("Invalid integration pattern 'odd'")


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.from_regex(r"cmo-[a-z0-9]{1,6}", fullmatch=True), st.from_regex(r"[a-z][a-z-]{0,8}", fullmatch=True), st.dates(dt.date(1970, 1, 1), dt.date(2100, 1, 1)))
def test_paths_round_trip(spark, cmo, domain, day):
    path = P.layer_path("lake", "silver", F.col("c"), F.col("d"), F.col("day"))
    got = spark.createDataFrame([(cmo, domain, day)], "c string, d string, day date").select(path.alias("p")).select("p", P.parse_path(F.col("p")).alias("x"), P.path_valid(F.col("p"), "silver").alias("ok")).first()
    if domain == "quarantine":
        return
    assert (got.x.cmo_id, got.x.data_domain, got.x.bucket, got.ok) == (cmo, domain, "lake", True)
    assert got.x.partitions == {"year": f"{day:%Y}", "month": f"{day:%m}", "day": f"{day:%d}"}


def test_odd_paths(spark):
    texts = ["s3://b/bronze/quarantine/C-1/20240115T143022/", "s3://b/gold/daily/year=2024/", "s3://b/bronze/x", "http://b/bronze/c/d", "s3://b/lead/c/d", "s3://b/bronze/c/d/k=1/k=2=3"]
    got = [(r.x, r.ok) for r in spark.createDataFrame([(t,) for t in texts], "p string").select(P.parse_path(F.col("p")).alias("x"), P.path_valid(F.col("p")).alias("ok")).collect()]
    assert got[0][0].contract_id == "C-1" and got[0][0].quarantine_timestamp == "20240115T143022" and got[0][1]
    assert got[1][0].aggregation_type == "daily" and got[1][0].partitions == {"year": "2024"} and got[1][0].cmo_id is None
    assert [g[0] is None for g in got] == [False, False, True, True, False, False] and [g[1] for g in got] == [True, True, False, False, False, True]
    assert got[5][0].partitions == {"k": "2=3"}
    steps = P.with_parsed_path(spark.createDataFrame([(t,) for t in texts], "p string"), "p", "x")
    assert [r.x for r in steps.collect()] == [g[0] for g in got]
    assert spark.range(1).select(P.layer_path("b", "bronze", "alpha", "d")).first()[0] is None
    with pytest.raises(ValueError):
        P.layer_path("b", "lead", "cmo-a", "d")


@pytest.mark.parametrize("sql", ["", "DROP TABLE x", "select 1; delete from t", "SELECT 'please update me'", "WITH a AS (SELECT 1) SELECT * FROM a", "/* x */ SELECT 1", "SHOW TABLES"])
def test_guard_refuses(spark, sql):
    with pytest.raises(Q.SqlRejected):
        Q.check_sql(sql)
    assert Q.guard_sql(spark.createDataFrame([(sql,)], "sql string")).first()["allowed"] is False


@pytest.mark.parametrize("sql", ["SELECT * FROM t", "-- note\nSELECT created_at FROM t", "  select updated FROM t"])
def test_guard_allows(spark, sql):
    Q.check_sql(sql)
    assert Q.guard_sql(spark.createDataFrame([(sql,)], "sql string")).first()["allowed"] is True


def test_guarded_session_holds_only_permitted_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(2000).write.parquet(path)
    spark.sql("CREATE DATABASE IF NOT EXISTS hidden")
    spark.sql(f"CREATE TABLE IF NOT EXISTS hidden.secret USING parquet LOCATION '{path}'")
    spark.sql(f"CREATE TABLE IF NOT EXISTS plain_secret USING parquet LOCATION '{path}'")
    tables = {"mine": lambda s: s.read.parquet(path)}
    got = Q.guarded_sql(spark, "SELECT id FROM mine", tables)
    assert got.count() == 2000 and Q.guarded_sql(spark, "SELECT id FROM mine", tables, 10).count() == 10 and got.dtypes == [("id", "string")]
    assert Q.guarded_select(spark, "SELECT count(*) FROM (WITH x AS (SELECT id FROM mine) SELECT * FROM x)", tables).first()[0] == 2000
    for sql in ("SELECT * FROM hidden.secret", "SELECT * FROM plain_secret", f"SELECT * FROM parquet.`{path}`", "SELECT * FROM mine WHERE id IN (SELECT id FROM plain_secret)",
                "SELECT reflect('java.lang.System', 'currentTimeMillis') FROM mine",
                "SELECT `reflect`('java.lang.System', 'currentTimeMillis') FROM mine",
                "SELECT reflect /* x */ ('java.lang.System', 'currentTimeMillis') FROM mine",
                "SELECT Try_Reflect -- y\n ('java.lang.System', 'currentTimeMillis') FROM mine",
                "SELECT * FROM IDENTIFIER('plain_secret')", "SELECT * FROM IDENTIFIER('hidden.' || 'secret')",
                "SELECT * FROM mine WHERE EXISTS (SELECT 1 FROM IDENTIFIER('plain_secret'))",
                "SELECT * FROM mine WHERE EXISTS (SELECT 1 FROM plain_secret)",
                "SELECT (SELECT max(id) FROM hidden.secret) FROM mine",
                "SELECT id FROM mine UNION ALL SELECT id FROM plain_secret",
                "SELECT id FROM mine UNION ALL SELECT id FROM IDENTIFIER('plain_secret')",
                "SELECT * FROM (WITH y AS (SELECT * FROM plain_secret) SELECT * FROM y)",
                "SELECT * FROM (WITH plain_secret AS (SELECT 1) SELECT * FROM plain_secret)"):
        with pytest.raises(Q.SqlRejected):
            Q.guarded_select(spark, sql, tables)
    for sql in ("SELECT 'reflect(x)' AS a, `id` FROM mine", "SELECT m.id FROM mine m JOIN range(5) r ON m.id = r.id",
                "SELECT id FROM mine WHERE id IN (SELECT max(id) FROM mine)"):
        assert Q.guarded_select(spark, sql, tables).columns


@pytest.mark.parametrize("text,sql", [("x ```sql\nSELECT 1\n``` y", "SELECT 1"), ("```\nselect 2```", "select 2"), ("  SELECT 3 ", "SELECT 3"),
                                      ("Sure: select a\nfrom b", "select a\nfrom b"), ("nothing", ""), (None, "")])
def test_extract(spark, text, sql):
    assert spark.createDataFrame([(text,)], "t string").select(Q.extract_sql(F.col("t"))).first()[0] == sql
