"""Batches, audit, failures, documents, masking, access."""

from __future__ import annotations

import datetime as dt
import hashlib
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tenantlake.operators import access, audit, batches, documents, failures, filters, pii
from tenantlake.sources.readers import OCR_BLOCK
from tests.conftest import rows

T0 = dt.datetime(2024, 1, 1)
BATCH_DDL = f"batch_id string, contract_id string, status string, manufacturing_date string, data_elements {batches.ELEMENTS_TYPE}"


def _el(kind, got=False, at=None, path=None, late=False):
    return (kind, got, at, path, late)


def _batch(bid, elements, status="in_progress", day="2024-01-01", contract="C1"):
    return (bid, contract, status, day, elements)


def test_receipts_keep_first_time_and_last_path(spark):
    df = spark.createDataFrame([_batch("b1", [_el("bmr"), _el("coa", True, T0, "old"), _el("in_process"), _el("yield"), _el("deviation")]),
                                _batch("b2", [_el(e, True) for e in batches.REQUIRED_ELEMENTS])], BATCH_DDL)
    got = spark.createDataFrame([("b1", "bmr", T0 + dt.timedelta(days=2), "p2"), ("b1", "bmr", T0 + dt.timedelta(days=1), "p1"),
                                 ("b1", "coa", T0 + dt.timedelta(days=3), None), ("zz", "bmr", T0, "x")],
                                "batch_id string, element_type string, received_at timestamp, s3_path string")
    out = {r["batch_id"]: r for r in batches.apply_receipts(df, got).collect()}
    bmr, coa = out["b1"]["data_elements"][:2]
    assert (bmr["received"], bmr["received_at"], bmr["s3_path"]) == (True, T0 + dt.timedelta(days=1), "p2")
    assert (coa["received_at"], coa["s3_path"]) == (T0, "old")
    assert out["b1"]["missing_elements"] == ["in_process", "yield"] and not out["b1"]["is_complete"]
    assert out["b2"]["is_complete"] and len(out) == 2


def test_overdue_rules(spark):
    now = F.lit(dt.datetime(2024, 1, 11, 0, 0, 1)).cast("timestamp")
    slas = spark.createDataFrame([("C1", [("bmr", 10), ("coa", 11)])], "contract_id string, element_slas array<struct<element_type:string,max_days:int>>")
    df = spark.createDataFrame([
        _batch("late", [_el("bmr"), _el("coa"), _el("yield")]), _batch("submitted", [_el("bmr")], "submitted"),
        _batch("baddate", [_el("bmr")], day="01/01/2024"), _batch("nocontract", [_el("bmr")], contract=None),
        _batch("sticky", [_el("bmr", True, late=True)]), _batch("again", [_el("bmr", late=True)])], BATCH_DDL)
    flagged = batches.flag_overdue(df, slas, now)
    late = {r["batch_id"]: [e["overdue"] for e in r["data_elements"]] for r in flagged.collect()}
    assert late == {"late": [True, False, False], "submitted": [False], "baddate": [False], "nocontract": [False], "sticky": [True], "again": [True]}
    assert batches.overdue_counts(flagged).first() == (5, 1)
    exact = F.lit(dt.datetime(2024, 1, 11)).cast("timestamp")
    assert batches.overdue_counts(batches.flag_overdue(df, slas, exact)).first()["flagged"] == 0


def test_new_batches_and_submit(spark):
    req = spark.createDataFrame([("L1", "P1", "2024-01-01", "cmo-a"), ("L2", None, "", "cmo-a"), ("L3", "P1", "2024-01-01", None)],
                                "lot_number string, product_id string, manufacturing_date string, cmo_id string")
    made = {r["lot_number"]: r for r in batches.new_batches(req, F.current_timestamp()).collect()}
    assert made["L1"]["batch_id"].startswith("batch-") and made["L1"]["missing_elements"] == list(batches.REQUIRED_ELEMENTS)
    assert made["L2"]["error"] == "Missing required fields: product_id, manufacturing_date" and made["L3"]["batch_id"] is None
    df = spark.createDataFrame([_batch("b1", []), _batch("b2", [], "submitted")], BATCH_DDL)
    ids = spark.createDataFrame([("b1",), ("b2",), ("b3",), ("b1",)], "batch_id string")
    after, outcome = batches.submit(df, ids, F.current_timestamp())
    assert rows(after.select("batch_id", "status")) == [("b1", "submitted"), ("b2", "submitted")]
    assert [r["error"] for r in outcome.orderBy("batch_id").collect()] == [None, "Batch already submitted (status: submitted)", "Batch b3 not found"]


def test_completeness_band(spark):
    df = spark.createDataFrame([([],), (["bmr"],), (list(batches.REQUIRED_ELEMENTS),)], "missing_elements array<string>")
    assert [r["completeness_band"] for r in batches.completeness(df).collect()] == ["green", "blue", "red"]


EVENT_DDL = "event_id string, event_name string, event_time timestamp, username string, resources array<struct<ResourceName:string,ResourceType:string>>, cloud_trail_event string"


def _events(spark):
    def e(i, name, user, res, raw, kind="AWS::S3::Object"):
        return (i, name, T0, user, [(res, kind)], raw)
    return spark.createDataFrame([e("evt-001", "GetObject", "user-123", "lake/cmo-alpha/x", "{}"), e("evt-001", "GetObject", "user-123", "other", "{}"),
                                  e("evt-002", "PutObject", "user-456", "x", '{"t":"cmo-alpha"}', "other"), e("", "PutObject", "u", "cmo-alpha", ""),
                                  e("", "PutObject", "u", "cmo-alpha", "")], EVENT_DDL)


def test_audit_reports(spark):
    ev, span = _events(spark), (T0 - dt.timedelta(days=1), T0 + dt.timedelta(days=1))
    assert audit.data_access(ev, "cmo-alpha", *span).count() == 3
    assert audit.compliance_events(ev, "data_modifications", "cmo-alpha", *span).count() == 3
    whole = audit.compliance_events(ev, "comprehensive", "cmo-alpha", *span)
    assert sorted(r["event_id"] for r in whole.collect())[-1] == "evt-002" and whole.where("event_id = 'evt-001'").count() <= 1
    total, users, names = audit.report_summary(ev).first()
    assert (total, users, names) == (5, 3, 2)
    assert rows(audit.event_breakdown(ev)) == [("GetObject", 2), ("PutObject", 3)]
    assert audit.data_access(ev, "cmo-alph", *span).count() == 0
    for bad in (lambda: audit.query_events(ev, T0, T0), lambda: audit.compliance_events(ev, "nope", "cmo-a", *span),
                lambda: audit.data_access(ev, "", *span), lambda: audit.user_report(ev, "", *span)):
        with pytest.raises(audit.AuditError):
            bad()


def test_signatures(spark):
    df = spark.createDataFrame([("u", "export_data", "r", "i", "pw", "2024-01-01T00:00:00Z"), ("u", "look", "r", "i", "pw", "t"), ("", "export_data", "r", "i", "pw", "t")],
                               "user_id string, action string, resource string, intent string, auth_method string, timestamp_iso string")
    good, refused, blank = audit.sign(df).collect()
    assert good["content_hash"] == hashlib.sha256(b"uexport_datari2024-01-01T00:00:00Z").hexdigest()
    assert refused["content_hash"] is None and "not a critical action" in refused["error"] and blank["error"] == "user_id is required"
    signed = audit.sign(df).where("error is null")
    assert audit.verify_signatures(signed).first()["valid"] and not audit.verify_signatures(signed.withColumn("intent", F.lit("z"))).first()["valid"]


@pytest.mark.parametrize("name,message,expected", [
    ("ConnectionError", "x", "network"), ("ValueError", "ReadTimeoutError happened", "timeout"), ("Error", "schemavalidationerror", "validation"),
    ("KeyError", "nothing", "unknown"), ("TimeoutError", "connectionerror", "network"), (None, None, "unknown")])
def test_error_classes(spark, name, message, expected):
    df = spark.createDataFrame([(name, message)], "error_name string, error_message string")
    assert failures.classify_errors(df).first()["error_type"] == expected


def test_queue_life(spark):
    now = F.lit(T0).cast("timestamp")
    df = spark.createDataFrame([("r1", "C", "network", "m"), ("r2", "C", "weird", "m")], "record_id string, contract_id string, error_type string, error_message string")
    queue = failures.enqueue(df, now)
    assert rows(queue.select("error_type", "retry_count", "status")) == [("network", 0, "queued"), ("unknown", 0, "queued")]
    fail = queue.select("queue_id", F.lit(False).alias("success"), F.lit("again").alias("error_message"))
    for _ in range(4):
        queue = failures.advance_queue(queue, fail).drop("disposition")
    assert rows(failures.dead_letters(queue).select("record_id", "retry_count")) == [("r1", 4), ("r2", 4)]
    assert rows(failures.queue_stats(queue)) == [("dead_letter", 2), ("processing", 0), ("queued", 0)]
    assert [r[0] for r in spark.range(1, 4).select(failures.backoff_seconds(F.col("id"), 0.5)).collect()] == [0.5, 1.0, 2.0]


def test_idempotency(spark, tmp_path):
    payload = {"b": 'q"x', "a": 1}
    raw = f"C|load|{json.dumps(payload, sort_keys=True)}"
    made = spark.range(1).select(failures.idempotency_key(F.lit("C"), F.lit("load"), F.lit(json.dumps(payload, sort_keys=True)))).first()[0]
    assert made == hashlib.sha256(raw.encode()).hexdigest()
    text = spark.range(1).select(failures.sorted_json(F.create_map(F.lit("b"), F.lit('q"x'), F.lit("a"), F.lit("y")))).first()[0]
    assert text == json.dumps({"a": "y", "b": 'q"x'})
    ledger, calls = failures.ledger_at(spark, str(tmp_path / "ledger")), []

    def work():
        calls.append(1)
        return None

    def broken():
        raise RuntimeError("boom")

    with pytest.raises(RuntimeError):
        failures.run_once(spark, ledger, "k", broken, 100.0)
    failures.run_once(spark, ledger, "k", work, 101.0)
    failures.run_once(spark, ledger, "k", work, 102.0)
    assert len(calls) == 1
    failures.run_once(spark, ledger, "k", work, 102.0 + 25 * 3600)
    assert len(calls) == 2
    ledger = failures.ledger_at(spark, str(tmp_path / "other"))
    ledger.append("k", [("k", "in_progress", 1.0, 10**12, None, None)])
    with pytest.raises(failures.InProgressError):
        failures.run_once(spark, ledger, "k", work, 200.0)


def test_two_claims_at_once_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    ledger, calls = failures.ledger_at(spark, str(tmp_path / "ledger")), []

    def attempt(_):
        try:
            failures.run_once(spark, ledger, "k", lambda: calls.append(1), 100.0)
            return True
        except failures.InProgressError:
            return False

    with ThreadPoolExecutor(4) as pool:
        won = list(pool.map(attempt, range(4)))
    assert len(calls) == 1 and any(won)
    with ThreadPoolExecutor(4) as pool:
        assert sum(pool.map(lambda _: ledger.claim("other", 1), range(4))) == 1


def _block(kind, bid, text=None, conf=None, row=None, col=None, entity=None, rel=None):
    return (bid, kind, text, conf, row, col, [entity] if entity else None, rel)


DOC_DDL = f"doc_id string, blocks {OCR_BLOCK.simpleString()}"


def _docs(spark, *docs):
    return spark.createDataFrame(list(docs), f"doc_id string, blocks array<{OCR_BLOCK.simpleString()}>")


def test_document_tables(spark):
    blocks = [_block("TABLE", "t", rel=[("CHILD", ["c1", "c2", "c3", "c4"])])]
    for i, (r, c, w) in enumerate([(1, 1, "BatchID"), (1, 2, "Status"), (2, 1, "B001"), (2, 2, "PASS")], 1):
        blocks += [_block("CELL", f"c{i}", row=r, col=c, rel=[("CHILD", [f"w{i}"])]), _block("WORD", f"w{i}", w)]
    staged = documents.stage_blocks(_docs(spark, ("d", blocks), ("none", [])))
    assert [r["record"] for r in documents.table_records(staged).collect()] == [{"BatchID": "B001", "Status": "PASS"}]
    assert documents.matrices(staged).first()["matrix"] == [["BatchID", "Status"], ["B001", "PASS"]]
    assert documents.record_tables(staged).first()["records"] == [{"BatchID": "B001", "Status": "PASS"}]


def test_header_by_place_and_last_duplicate(spark):
    """Header at columns 2 and 3, cells read at 1 and 2; equal header names keep the last."""
    blocks = [_block("TABLE", "t", rel=[("CHILD", ["a", "b", "c", "d"])])]
    for bid, r, c, w in (("a", 1, 2, "H"), ("b", 1, 3, "H"), ("c", 2, 1, "one"), ("d", 2, 2, "two")):
        blocks += [_block("CELL", bid, row=r, col=c, rel=[("CHILD", [f"w{bid}"])]), _block("WORD", f"w{bid}", w)]
    staged = documents.stage_blocks(_docs(spark, ("d", blocks)))
    assert documents.table_records(staged).first()["record"] == {"H": "two"}


def test_document_forms(spark):
    blocks = [_block("KEY_VALUE_SET", "k1", entity="KEY", rel=[("CHILD", ["w1", "w2"]), ("VALUE", ["v1"])]),
              _block("KEY_VALUE_SET", "v1", entity="VALUE", rel=[("CHILD", ["w3", "w4"])]), _block("KEY_VALUE_SET", "k2", entity="KEY", rel=[("VALUE", ["v1"])]),
              _block("KEY_VALUE_SET", "k3", entity="KEY", rel=[("CHILD", ["w1", "w2"]), ("VALUE", ["gone"])]),
              *[_block("WORD", f"w{i}", t) for i, t in enumerate(["Lot", "Number", "A", "1"], 1)]]
    staged = documents.stage_blocks(_docs(spark, ("d", blocks[:3] + blocks[4:]), ("e", blocks)))
    assert rows(documents.forms(staged)) == [("d", "Lot Number", "A 1"), ("e", "Lot Number", "")]


def test_confidence_and_routing(spark):
    docs = _docs(spark, ("hi", [_block("LINE", "1", "a", 99.5), _block("LINE", "2", "b", 98.0), _block("WORD", "3")]), ("none", []))
    docs = docs.withColumns({"cmo_id": F.lit("cmo-a"), "data_domain": F.lit("coa"), "file_key": F.lit("x/incoming/b/coa/f.PDF")})
    got = {r["doc_id"]: r for r in documents.process_documents(docs, "lake", F.lit(T0)).collect()}
    assert got["hi"]["confidence"] == 0.9875 and got["hi"]["lines"] == ["a", "b"] and got["hi"]["document_type"] == "pdf"
    assert got["hi"]["destination_path"] == "s3://lake/bronze/cmo-a/coa/year=2024/month=01/day=01/"
    assert got["none"]["needs_review"] and got["none"]["tables"] == [] and got["none"]["forms"] == {}
    key = documents.result_key(F.lit("bronze/c/d/incoming/b1/coa/f.pdf"), F.lit(True), F.lit(""), F.lit(T0))
    assert spark.range(1).select(key).first()[0] == "bronze/c/d/lot=b1/year=2024/month=01/day=01/f.json"


def test_certificate(spark):
    df = spark.createDataFrame([("d", {"Product Name": "X", "Disposition:": "APPROVED", "Other": "y"}, [[["a", "b"]], [["Test", "Spec", "Value", "Status"], ["pH", "7", "7", "PASS"], ["x", "1", "2"]]])],
                               "doc_id string, forms map<string,string>, tables array<array<array<string>>>")
    assert rows(documents.certificate_header(df)) == [("d", "Disposition", "APPROVED"), ("d", "Product Name", "X")]
    assert [(r["result"]["Test"], r["status"]) for r in documents.certificate_view(df).orderBy("row_no").collect()] == [("pH", "success"), ("x", "pending")]


PEOPLE = [("B001", "John Doe", "john.doe@example.com", "555-123-4567", "123-45-6789", 100), ("B002", "Jane Smith", "jane@test.org", "(555) 987-6543", None, 200)]
PEOPLE_DDL = "batch_id string, operator_name string, operator_email string, phone string, ssn string, quantity long"


def test_pii_detection_and_masks(spark):
    df = spark.createDataFrame(PEOPLE, PEOPLE_DDL)
    found = {r["field"]: r["pii_types"] for r in pii.detect_pii(df).collect()}
    assert found == {"operator_name": ["NAME"], "operator_email": ["EMAIL"], "phone": ["PHONE"], "ssn": ["SSN"]}
    assert pii.detect_pii(df.limit(0)).count() == 0
    assert pii.mask(df, ["operator_name"], "hash").first()["operator_name"] == "6cea57c2fb6cbc2a40411135005760f241fffc3e5e67ab99882726431037f908"
    assert [r["ssn"] for r in pii.mask(df, ["ssn"], "partial").collect()] == ["*******6789", None]
    assert pii.mask(df, ["quantity"], "redact").first()["quantity"] == "[REDACTED]"
    assert pii.mask_for_contract(df, {"governance": {"dataClassification": "public", "piiFields": ["ssn"]}}).first()["ssn"] == "123-45-6789"
    for bad in (lambda: pii.mask(df, ["ssn"], "rot13"), lambda: pii.masking_rule("secret")):
        with pytest.raises(ValueError):
            bad()


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.text(alphabet=st.characters(min_codepoint=33, max_codepoint=0x24F), max_size=12))
def test_partial_mask_keeps_length_and_tail(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(pii.mask_value(F.col("t"), "partial")).first()[0]
    assert len(got) == len(text) and got == ("*" * len(text) if len(text) <= 4 else "*" * (len(text) - 4) + text[-4:])


def test_isolation_and_grants(spark):
    alpha = spark.createDataFrame([("cmo-alpha", "Ann", 1), ("cmo-beta", "Bob", 2)], "cmo_id string, operator_name string, n int")
    views = access.isolation_views("cmo-alpha", {"records": (alpha, ["operator_name"])})["records"]
    assert spark.table(views["combined"]).columns == ["cmo_id", "n"] and spark.table(views["combined"]).count() == 1
    assert spark.table(views["column"]).count() == 2
    assert access.revoke_isolation(spark, "cmo-alpha", ["records"]) == 3
    grants = access.isolation_grants(spark, "arn:alpha", ["cmo_alpha_x_silver", "ALL_TABLES"])
    assert [r["table_name"] for r in access.accessible_tables(spark, grants, "arn:alpha").collect()] == ["cmo_alpha_x_silver"]
    verdict = access.verify_isolation(grants.withColumn("cmo_id", F.lit("cmo-alpha"))).first()
    assert (verdict["permissions_checked"], verdict["violations"], verdict["passed"]) == (5, 2, False)
    more, _ = access.grant_user("cmo-alpha", "arn:user", {"records": (alpha, [])}, grants)
    assert more.count() == grants.count() + 3 and access.revoke(more, grants).count() == 3
    rules = access.rls_rules(spark, {"cmo-alpha": ["ann"], "cmo-beta": ["bob"]})
    assert access.rls_join(alpha, rules, "ann").count() == 1 and access.rls_valid(rules, "ann", "cmo-alpha") and not access.rls_valid(rules, "ann", "cmo-beta")
    with pytest.raises(ValueError):
        access.isolation_views("alpha", {})


def test_tenant_scope_denies_unlinked_users(spark):
    df = spark.createDataFrame([("cmo-a",), ("cmo-b",)], "cmo_id string")
    assert filters.tenant_scope(df, {"cmo_id": "cmo-a"}, "cmo-b").first()[0] == "cmo-a"
    with pytest.raises(filters.AccessDenied):
        filters.tenant_scope(df, {"cmo_id": ""})


def test_blocks_are_exchanged_once(spark, tmp_path):
    """Fields and cells of a document are found where its blocks are: one exchange, and no join, whatever is asked."""
    blocks = [_block("KEY_VALUE_SET", "k", entity="KEY", rel=[("CHILD", ["w"]), ("VALUE", ["v", "gone"])]),
              _block("KEY_VALUE_SET", "v", entity="VALUE", rel=[("CHILD", ["w"])]), _block("WORD", "w", "Lot"), _block("WORD", "w", "Last"),
              _block("KEY_VALUE_SET", "k2", entity="KEY", rel=[("VALUE", ["v"]), ("CHILD", ["w"])]), _block("CELL", None, row=1, col=1),
              _block("TABLE", "t", rel=[("CHILD", ["c", None, "c2", "w"])]), _block("CELL", "c", row=1, col=1, rel=[("CHILD", ["w", None])]),
              _block("CELL", "c2", row=1, col=1)]
    _docs(spark, ("d", blocks), ("d2", blocks[:4]), (None, blocks), ("none", None)).write.parquet(f"{tmp_path}/docs")
    staged = documents.stage_blocks(spark.read.parquet(f"{tmp_path}/docs"))
    # of two words with one id the last; the last value that a key names isn't there; of equal cells the last
    assert rows(documents.forms(staged)) == [(None, "Last", "Last"), ("d", "Last", "Last"), ("d2", "Last", "")]
    assert rows(documents.cells(staged)) == [(None, 6, 1, 1, ""), ("d", 6, 1, 1, "")]
    for made in (documents.forms(staged), documents.block_text(staged), documents.table_records(staged), documents.record_tables(staged)):
        made.collect()
        plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
