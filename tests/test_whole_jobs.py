"""Queries that must see every row: no result may stop at an id."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from tenantlake.operators import access, filters
from tenantlake.plans import streams
from tenantlake.sources import sinks
from tenantlake.streaming import streams as lake_streams
from tests.conftest import rows


def test_connection_counts_see_every_contract(spark):
    conns = spark.range(2000).selectExpr("id as connection_id", "concat('cmo-', id % 3) as cmo_id",
                                         "if(id % 2 = 0, 'active', 'draft') as status")
    heads = spark.createDataFrame([(1, "cmo-1"), (2, "cmo-1"), (3, "cmo-9")], "batch_id long, cmo_id string")
    live = [i for i in range(2000) if i % 2 == 0 and i % 3 == 1]
    assert rows(filters.active_connection_counts(heads, conns)) == [
        (1, "cmo-1", len(live), live[0]), (2, "cmo-1", len(live), live[0]), (3, "cmo-9", 0, None)]


def test_delivered_files_are_there_a_wave_at_a_time(spark, tmp_path, monkeypatch):
    """Failed before: all files of all deliveries were on the disk at once."""
    spark.range(1, 61).selectExpr("id as l_orderkey", "id % 7 as l_suppkey", "id * 2 as l_partkey", "int(id % 3) + 1 as l_linenumber").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.range(1, 41).selectExpr("id as o_orderkey", "id as o_custkey", "'O' as o_orderstatus", "1.0D as o_totalprice",
                                  "timestamp '2024-01-01' as o_orderdate", "'1' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(streams, "FILES_AT_ONCE", 10)
    roots, there, write = [], [], sinks.write_files
    holds = lambda root: sum(len(f) for _, _, f in os.walk(root))

    def counted(files, root):
        there.append(sum(map(holds, roots)))  # those of earlier waves
        roots.append(root)
        n = write(files, root)
        there.append(holds(root) - sum(f.endswith(".crc") for _, _, fs in os.walk(root) for f in fs))
        return n

    monkeypatch.setattr(sinks, "write_files", counted)
    got = streams.listed_files(spark, str(tmp_path)).collect()
    assert sorted((r.cmo_id, int(r.batch_id)) for r in got) == sorted((f"cmo-{i % 7}", i) for i in range(1, 61))
    assert len(roots) == 6 and not sum(there[::2]) and sum(there[1::2]) == 60 and max(there[1::2]) < 60
    got = streams.stream_ingest_receipts(spark, str(tmp_path)).collect()
    assert sorted((r.batch_key, r.received, r.missing) for r in got) == [(i, 1, 3) for i in range(1, 41)]
    assert len(roots) == 12 and not sum(map(holds, roots))


def test_every_delivery_and_user_is_taken(spark, tmp_path):
    spark.range(1, 61).selectExpr("id as l_orderkey", "id % 7 as l_suppkey", "id * 2 as l_partkey", "1 as l_linenumber").union(
        spark.range(1, 61).selectExpr("id", "id % 7", "id * 3", "2")).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = streams.listed_files(spark, str(tmp_path)).collect()
    assert sorted((r.cmo_id, r.batch_id, r.accepted) for r in got) == sorted((f"cmo-{i % 7}", str(i), True) for i in range(1, 61) for _ in range(2))
    users = spark.range(100).selectExpr("concat('role-', id) as principal")
    alpha = spark.createDataFrame([("cmo-3", 1.0)], "cmo_id string, price double")
    got, _ = access.grant_users("cmo-3", users, {"lines": (alpha, ["price"])}, spark.createDataFrame([], access.GRANTS_DDL))
    one, _ = access.grant_user("cmo-3", "role-57", {"lines": (alpha, ["price"])}, spark.createDataFrame([], access.GRANTS_DDL))
    assert got.count() == 300 and rows(access.list_grants(got, "role-57")) == rows(one)


def test_spent_folders_are_written_over(spark, tmp_path):
    """Failed before: every wave made its files and folders anew and removed them."""
    root, spent = str(tmp_path / "root"), str(tmp_path / "spent")

    def held(at):
        return {os.path.join(d, f).removeprefix(f"{at}/"): open(os.path.join(d, f)).read() for d, _, fs in os.walk(at) for f in fs}

    def inodes(at):
        return {os.stat(os.path.join(d, f)).st_ino for d, _, fs in os.walk(at) for f in fs}

    first = {"a/in/1/x/f.csv": "long text", "a/in/2/x/f.csv": "2", "a/in/2/y/f.csv": "3", "b/in/3/z/f.csv": "4"}
    others = [
        {"a/in/9/x/f.csv": "5", "c/in/8/q/f.csv": "66", "c/in/8/r/g.csv": "\u00fc", "c/in/8/s/f.csv": ""},  # fewer folders, more files in one
        {"d/in/1/x/f.csv": "7", "d/in/2/x/f.csv": "8", "d/in/3/x/f.csv": "9", "d/in/4/x/f.csv": "10", "e/in/5/y/f.csv": "11"}]
    os.makedirs(root)
    seen = set()
    for n, wave in enumerate([first, *others]):
        files = spark.createDataFrame([(k, t, spent) for k, t in wave.items()], "key string, text string, spent string").coalesce(1)
        assert sinks.write_files(files, root) == len(wave) and held(root) == wave
        assert sinks.write_files(files, root) == len(wave) and held(root) == wave  # as a task that is run again
        assert not n or len(inodes(root) & seen) == min(len(wave), len(seen))
        seen |= inodes(root)
        assert sinks.retire_files(files, root) == len(wave) and os.listdir(root) == [] and len(inodes(spent)) == len(seen)
        assert sinks.retire_files(files, root) == len(wave)


def test_retired_files_leave_others(spark, tmp_path):
    root, spent = tmp_path / "root", str(tmp_path / "spent")
    for key in ("a/in/1/x/f.csv", "a/in/1/x/other", "a/in/2/y/f.csv", "a/in/2/other"):
        (root / key).parent.mkdir(parents=True, exist_ok=True)
        (root / key).write_text("t")
    files = spark.createDataFrame([(k, spent) for k in ("a/in/1/x/f.csv", "a/in/2/y/f.csv", "a/in/3/z/f.csv")], "key string, spent string")
    sinks.retire_files(files, str(root))
    assert sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file()) == ["a/in/1/x/other", "a/in/2/other"]


def test_arrivals_make_few_tasks(spark, tmp_path):
    """Failed before: a stream over many small files wrote each micro-batch as a file for every few of them."""
    root, out = tmp_path / "lake", str(tmp_path / "out")
    arrivals = lake_streams.arrivals(spark, (root.mkdir(), str(root))[1])
    for i in range(600):
        path = root / f"bronze/cmo-{i % 40}/coa/incoming/{i}/bmr/f.csv"
        path.parent.mkdir(parents=True)
        path.write_text("x")
    parts, stage = [], lake_streams.stage

    def counted(df, name):
        parts.append(df.rdd.getNumPartitions())
        return stage(df, name)

    lots = spark.createDataFrame([], "batch_id string, lot_number string")
    lake_streams.stage = counted
    try:
        lake_streams.ingest_stream(spark, str(root), out, str(tmp_path / "state"), lots, F.current_timestamp(), files=arrivals).awaitTermination()
    finally:
        lake_streams.stage = stage
    assert parts and max(parts) <= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(f"{out}/receipts").select("batch_id").distinct().count() == 600
