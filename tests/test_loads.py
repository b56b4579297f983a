"""Partial results over loads equal a full run; a second load reads its own partitions only."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenantlake.operators import gold, quality
from tenantlake.operators.gold_store import GoldStore
from tenantlake.operators.measures import MeasureStore
from tenantlake.operators.quality import QualityRule
from tests.conftest import rows

DDL = "cmo_id string, data_domain string, day string, ts timestamp, quantity string, quality_status string, k string"
LEVELS = ["data_domain", "day"]


def lines(seed, days, n=60):
    chance = random.Random(seed)
    import datetime as dt
    out = []
    for _ in range(n):
        day = chance.choice(days)
        out.append((chance.choice(["cmo-1", "cmo-2", None]), chance.choice(["a", "b c/d", None]), f"d{day}",
                    chance.choice([dt.datetime(2024, 1, day, 5), None, dt.datetime(2024, 3, day)]), chance.choice(["1", "2.5", "x", None]),
                    chance.choice(["PASS", "fail", "pass", None]), chance.choice([None, *map(str, range(seed, seed + 9))])))
    return out


def after(spark, loads, gone=()):
    """All rows with each partition as its last load left it."""
    held = {}
    for load in loads:
        new = {}
        for r in load:
            new.setdefault((r[1], r[2]), []).append(r)
        held |= new
    return spark.createDataFrame([r for p, part in held.items() if p not in gone for r in part], DDL)


def rounded(df):
    return rows(df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]))


def test_gold_over_loads_equals_a_full_run(spark, tmp_path):
    loads = [lines(1, range(1, 9)), lines(2, (3, 4, 20)), lines(3, (20, 21))]
    store = GoldStore(spark, str(tmp_path), LEVELS, "ts")
    for load in loads:
        store.load(spark.createDataFrame(load, DDL))
    gone = spark.createDataFrame([("b c/d", "d3"), (None, "d20")], "data_domain string, day string")
    store.retract(gone)
    whole = after(spark, loads, {("b c/d", "d3"), (None, "d20")})
    for period in ("daily", "weekly", "monthly"):
        assert rounded(store.batch_summary(period)) == rounded(gold.batch_summary(whole, period, "ts"))
        assert rounded(store.quality_trend(period)) == rounded(gold.quality_trend(whole, period, "ts"))
    assert rounded(store.supplier_scorecard()) == rounded(gold.supplier_scorecard(whole))


def test_a_second_load_leaves_other_partitions_untouched(spark, tmp_path):
    store = GoldStore(spark, str(tmp_path), LEVELS, "ts")
    store.load(spark.createDataFrame(lines(1, range(1, 9)), DDL))
    before = set(store.states.read().inputFiles())
    store.load(spark.createDataFrame([r for r in lines(2, (3,)) if r[1] == "a"], DDL))
    now = set(store.states.read().inputFiles())
    assert {f for f in before - now} == {f for f in before if "_data_domain=a/_day=d3" in f} and len(before - now) >= 1


RULES = [
    QualityRule("c", "c", "completeness", 'Completeness "quality_status"', 50.0), QualityRule("all", "all", "completeness", "Completeness", 50.0),
    QualityRule("u", "u", "uniqueness", 'Uniqueness "k"', 10.0), QualityRule("d", "d", "uniqueness", 'Uniqueness "data_domain"', 1.0),
    QualityRule("no", "no", "uniqueness", 'Uniqueness "absent"', 1.0), QualityRule("i", "i", "accuracy", 'Accuracy "quality_status" in ["PASS"]', 20.0),
    QualityRule("r", "r", "consistency", "RowCount between 1 and 500", 1.0), QualityRule("s", "s", "custom", 'CustomSql "select 1 from primary" > 0', 1.0),
]


@pytest.mark.parametrize("n", [1, 3])
def test_measures_over_loads_equal_a_full_pass(spark, tmp_path, n):
    loads = [lines(1, range(1, 9)), lines(4, (3, 4, 20)), lines(7, (20, 21))][:n]
    store = MeasureStore(spark, str(tmp_path), RULES, LEVELS)
    like = spark.createDataFrame([], DDL)
    assert rows(store.results(like)) == rows(quality.evaluate_rules(like, RULES))
    for load in loads:
        store.load(spark.createDataFrame(load, DDL))
    assert rows(store.results(like)) == rows(quality.evaluate_rules(after(spark, loads), RULES))
    store.retract(spark.createDataFrame([("a", "d3")], "data_domain string, day string"))
    assert rows(store.results(like)) == rows(quality.evaluate_rules(after(spark, loads, {("a", "d3")}), RULES))
    words = store._dictionary().collect()
    assert sorted(w.number for w in words) == list(range(len(words)))


def test_gold_store_needs_its_columns(spark, tmp_path):
    with pytest.raises(gold.GoldError, match="data_domain"):
        GoldStore(spark, str(tmp_path), ["day"], "ts").load(spark.createDataFrame([("c", "d")], "cmo_id string, day string"))


def test_the_words_of_a_load_are_written_by_the_tasks_that_hold_them(spark, tmp_path):
    """Failed before: one task wrote all words of a load."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store = MeasureStore(spark, str(tmp_path), RULES, LEVELS)
        store.load(spark.createDataFrame(lines(1, range(1, 30)), DDL))
        store.load(spark.createDataFrame(lines(5, (3, 30)), DDL))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    words = store._dictionary().collect()
    assert sorted(w.number for w in words) == list(range(len(words))) and len(set(words)) == len(words)
    assert len([f for f in store.words.read().inputFiles() if "load=0/" in f]) > 1
