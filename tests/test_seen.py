"""The index of seen keys against a plain loop: late, repeated and first deliveries, replays, folding and expiry."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tenantlake.operators.quality import QualityRule
from tenantlake.operators.schema import TableSchema
from tenantlake.session import scratch, stage
from tenantlake.streaming import streams
from tenantlake.streaming.seen import SeenKeys
from tests.conftest import rows

T = dt.datetime(2024, 1, 1)
DDL = "id string, part int, ts timestamp, v int"


def brute(batches, within, expiry=dt.timedelta(days=90), fold_every=8):
    """(batch, id, part, ts, v, verdict) of every row."""
    known, clock, out = {}, None, []
    for n, batch in enumerate(batches):
        if n and n % fold_every == 0:
            known = {k: t for k, t in known.items() if t is None or t >= clock - expiry}
        before = dict(known)
        for id_, part, ts, v in sorted(batch, key=lambda r: (r[2] is None, r[2] or T, r[0] or "", r[1], r[3])):
            key = (id_, part)
            late = clock is not None and ts is not None and ts < clock - within
            verdict = "repeated" if key in before or key in known else "late" if late else "first"
            known.setdefault(key, ts)
            out.append((n, id_, part, ts, v, verdict))
        clock = max([t for *_, t, _ in batch if t is not None] + ([clock] if clock else []), default=None)
    return sorted(out, key=str)


def judged(spark, root, batches, **more):
    index = SeenKeys(spark, root, ["id", "part"], "ts", "24 hours", buckets=4, **more)
    out = []
    for n, batch in enumerate(batches):
        with scratch(spark):
            got = index.judge(stage(spark.createDataFrame(batch, DDL), "b"), n).collect()
        out += [(n, r.id, r.part, r.ts, r.v, r._delivery) for r in got]
    return sorted(out, key=str), index


def batches(seed, n, keys=30, days=12):
    chance = random.Random(seed)
    out = []
    for k in range(n):
        rows = [(chance.choice([None, *"abcdefgh"]), chance.randrange(keys // 8), T + dt.timedelta(days=days * k / n + chance.uniform(-4, 1)), i)
                for i in range(12)]
        out.append([(a, b, None if chance.random() < 0.05 else c.replace(microsecond=0), v) for a, b, c, v in rows])
    return out


def test_verdicts_equal_a_loop_over_folds(spark, tmp_path):
    data = batches(1, 6)
    got, index = judged(spark, str(tmp_path), data, fold_every=2)
    assert got == brute(data, dt.timedelta(hours=24), fold_every=2)
    assert {v for *_, v in got} == {"first", "late", "repeated"}
    assert index._folders("base") == [4] and index._folders("delta") == [4, 5] and len(index._folders("clock")) <= 4


def test_a_key_is_forgotten_after_its_expiry(spark, tmp_path):
    day = dt.timedelta(days=1)
    data = [[("a", 1, T, 0), ("b", 1, T + 3 * day, 1)], [("c", 1, T + 6 * day, 2)], [("a", 1, T + 6 * day, 3), ("b", 1, T + 6 * day, 4)]]
    got, _ = judged(spark, str(tmp_path), data, expiry="4 days", fold_every=2)
    assert got == brute(data, day, 4 * day, 2) and ("first" in {v for n, *_, v in got if n == 2})


def test_a_replayed_batch_gives_the_same_verdicts(spark, tmp_path):
    data = batches(2, 3)
    got, index = judged(spark, str(tmp_path), data, fold_every=2)
    with scratch(spark):
        again = index.judge(stage(spark.createDataFrame(data[2], DDL), "b"), 2).collect()
    assert sorted(((2, r.id, r.part, r.ts, r.v, r._delivery) for r in again), key=str) == [r for r in got if r[0] == 2]


def test_only_the_buckets_of_a_batch_are_opened(spark, tmp_path):
    index = SeenKeys(spark, str(tmp_path), ["id"], "ts", "24 hours", buckets=16)
    many = spark.range(400).selectExpr("string(id) as id", "timestamp'2024-01-01' as ts")
    index.judge(stage(many, "b"), 0)
    one = stage(many.where("id = '7'"), "b")
    asked = one.select(index._bucket().alias("b")).first().b
    files = index.known(1).where(F.col("bucket") == asked).inputFiles()
    assert index.judge(one, 1).first()._delivery == "repeated"
    read = index.known(1).where(F.col("bucket").isin([asked]))
    assert read.select(F.input_file_name().alias("f")).distinct().count() < len(files)


def test_a_first_delivery_three_days_late_is_kept(spark, tmp_path):
    """Every row of the stream in exactly one output, over several runs of it."""
    schema = TableSchema({"id": "string", "kind": "string"}, ("kind",))
    rules = [QualityRule("r", "known", "completeness", 'Completeness "id"', 99.0)]
    ddl = "id string, kind string, ts timestamp"
    hour = dt.timedelta(hours=1)
    sent = [[("a", "k", T), ("b", "k", T + hour), ("b", "k", T + 2 * hour)], [("c", "k", T + 96 * hour), ("a", "k", T + 96 * hour)],
            [("d", "k", T + 24 * hour), ("a", "k", T), ("e", None, T + 97 * hour), ("f", "k", T + 80 * hour)]]
    out = str(tmp_path / "out")
    for part in sent:
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(ddl).parquet(str(tmp_path / "in"))
        streams.quality_stream(src, schema, rules, ["id"], ["ts"], out, str(tmp_path / "state"), ts="ts", buckets=4).awaitTermination()
    found = {s: [r[0] for r in rows(spark.read.option("recursiveFileLookup", True).parquet(f"{out}/{s}").select("id"))]
             for s in ("silver", "late", "repeated", "quarantine")}
    assert found == {"silver": ["a", "b", "c", "f"], "late": ["d"], "repeated": ["a", "a", "b"], "quarantine": ["e"]}


@pytest.mark.parametrize("buckets", [1, 5])
def test_dedup_stream_keeps_every_row_somewhere(spark, tmp_path, buckets):
    data = batches(3, 4)
    for batch in data:
        spark.createDataFrame(batch, DDL).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        src = spark.readStream.schema(DDL).parquet(str(tmp_path / "in"))
        streams.dedup_stream(src, ["id", "part"], str(tmp_path / "out"), str(tmp_path / "state"), buckets=buckets).awaitTermination()
    want = brute(data, dt.timedelta(hours=24))
    for side, verdict in (("rows", "first"), ("late", "late"), ("repeated", "repeated")):
        got = spark.read.parquet(f"{tmp_path}/out/{side}").select("id", "part", "ts", "v")
        assert rows(got) == sorted((r[1:5] for r in want if r[5] == verdict), key=lambda t: tuple(str(x) for x in t))
