"""Nulls, ties and repeated changes that the shared tables don't hold."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tenantlake.operators import batches, cleanse, contracts, keywords
from tenantlake.operators.windows import global_rank, running_totals


def test_dataset_match_sees_nulls(spark):
    a = spark.createDataFrame([(1, None, "x"), (2, "y", "y"), (None, "z", "z")], "k int, p string, q string")
    b = spark.createDataFrame([(1, "x", None), (2, "y", "y"), (None, "z", "z")], "k int, p string, q string")
    assert abs(keywords.dataset_match(a, b, ["k"]).first()["actual"] - 2 / 3) < 1e-9
    assert keywords.dataset_match(a, a, ["k"]).first()["actual"] == 1.0


def test_is_unique_on_several_columns_with_nulls(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, None), (None, 3)], "a int, b int")
    got = keywords.evaluate_keywords(df, ['IsUnique "a" "b"'])

    assert got.first()["passed"] is True


def test_rank_keeps_null_rows_and_puts_them_last(spark):
    df = spark.createDataFrame([("a", 3), ("b", None), ("c", 9), ("d", 9)], "id string, v int")
    got = {r.id: r.place for r in global_rank(df, "v", "id", "place").collect()}
    assert got == {"c": 1, "d": 1, "a": 3, "b": 4}


def test_running_totals_of_a_null_key(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("x", 1)], "k string, t int")
    got = sorted((r.k or "", r.t, r.n) for r in running_totals(df, ["k"], ["t"], {"n": F.lit(1)}).collect())
    assert got == [("", 1, 1), ("", 2, 2), ("x", 1, 1)]


def test_contract_ids_of_requests_without_a_supplier(spark):
    df = spark.createDataFrame([(None, "d", 1), ("Acme", "d", 2), (None, None, 3)], "cmo_id string, data_domain string, n int")
    got = {r.n: r.contract_id for r in contracts.assign_contract_ids(df, df.where("n = 1"), ["n"]).collect()}
    assert got == {1: "CMO-UNKNOWN-D-002", 2: "CMO-ACME-D-001", 3: None}


def test_receipts_without_a_known_element_do_not_stop_the_batch(spark):
    requests = spark.createDataFrame([("l1", "p", "c", "2024-01-01")], "lot_number string, product_id string, cmo_id string, manufacturing_date string")
    made = batches.new_batches(requests, F.lit(dt.datetime(2024, 1, 2)).cast("timestamp"))
    made = made.drop("error")
    batch_id = made.first()["batch_id"]
    receipts = spark.createDataFrame(
        [(batch_id, "bmr", dt.datetime(2024, 1, 3), "s3"), (batch_id, None, dt.datetime(2024, 1, 3), "s3"),
         (batch_id, "poem", dt.datetime(2024, 1, 3), "s3"), ("none", "coa", dt.datetime(2024, 1, 3), "s3")],
        "batch_id string, element_type string, received_at timestamp, s3_path string")
    done = batches.apply_receipts(made, receipts).first()
    assert [e["element_type"] for e in done["data_elements"] if e["received"]] == ["bmr"]
    assert sorted(r.reason for r in batches.rejected_receipts(made, receipts).collect()) == [
        "batch is unknown", "element_type is missing", "element_type is unknown"]


def test_duplicates_break_ties_on_arrays_structs_and_maps(spark):
    rows = [(1, [2, 1], {"a": 1}, ("x", 1)), (1, [2, 2], {"a": 1}, ("x", 1)), (1, [2, 2], {"a": 2}, ("x", 1))]
    ddl = "k int, a array<int>, m map<string,int>, s struct<p:string,q:int>"
    kept = {str(cleanse.deduplicate(spark.createDataFrame(r, ddl).coalesce(1), ["k"], []).first()) for r in (rows, rows[::-1])}
    assert len(kept) == 1 and "'a': 2" in kept.pop()


def test_two_actions_of_one_contract_give_one_row(spark):
    table = spark.createDataFrame([("c1", "draft"), ("c2", "draft")], "contract_id string, status string")
    actions = spark.createDataFrame([("c1", "submit", "ann", 1), ("c1", "reject", "bob", 2)], "contract_id string, action string, actor string, at int")
    now = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    got = {r.contract_id: r for r in contracts.apply_transitions(table, actions, now, order_by=["at"]).collect()}
    assert len(got) == 2 and got["c1"]["status"] == "pending_cmo_review" and got["c1"]["changed_by"] == "ann"
    assert [r.actor for r in contracts.superseded(actions, ["at"]).collect()] == ["bob"]
