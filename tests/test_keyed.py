"""Merging loads by key: one row a key, untouched files keep their names, failed loads leave no trace."""

from __future__ import annotations

import random

import pytest

from tenantlake.operators.cleanse import deduplicate
from tenantlake.sources import keyed
from tenantlake.sources.keyed import KeyedTable
from tests.conftest import rows

DDL = "cmo_id string, id string, day string, ts int, v int"


def frame(spark, data):
    return spark.createDataFrame(data, DDL)


def files(table):
    return {r.file for r in table.live().collect()}


def last(loads):
    """The last row of each key, by time and then by all columns, null as the least."""
    out = {}
    for load in loads:
        for r in load:
            k = (r[0], r[1])
            if k not in out or tuple((x is not None, x) for x in (r[3], r[2], r[4])) > tuple((x is not None, x) for x in (out[k][3], out[k][2], out[k][4])):
                out[k] = r
    return sorted(out.values(), key=lambda t: tuple(str(x) for x in t))


def test_a_key_delivered_on_two_days_is_one_row(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["id"], ["ts"], ["cmo_id", "day"], ["cmo_id"])
    first = [("cmo-1", "a", "d1", 1, 0), ("cmo-1", "b", "d2", 2, 1), ("cmo-2", "a", "d1", 1, 2), ("cmo-1", "c", "d3", 3, 3)]
    assert table.merge(frame(spark, first))[:3] == (1, 0, 0)
    names = files(table)
    second = [("cmo-1", "a", "d4", 4, 9), ("cmo-1", "n", "d4", 4, 8), ("cmo-1", "c", "d2", 2, 7)]  # the last one is older
    done = table.merge(frame(spark, second))
    assert rows(table.read().select("cmo_id", "id", "day", "ts", "v")) == last([first, second])
    stay = {f for f in names if "cmo_id=cmo-2" in f or "day=d2" in f}
    assert stay <= files(table) and done.rewritten == 2  # the files of a and c; b's and the other tenant's keep their names
    assert not {f for f in files(table) if f in names - stay}


@pytest.mark.parametrize("seed", [1, 2])
def test_many_loads_equal_the_last_of_all(spark, tmp_path, seed):
    chance = random.Random(seed)
    table = KeyedTable(spark, str(tmp_path), ["id"], ["ts"], ["cmo_id", "day"], ["cmo_id"])
    loads = []
    for n in range(4):
        loads.append([(f"cmo-{chance.randrange(3)}", chance.choice([None, *map(str, range(60))]), f"d{n}", chance.choice([None, *range(9)]), chance.randrange(99))
                      for _ in range(40)])
        table.merge(frame(spark, loads[-1]))
    assert rows(table.read().select("cmo_id", "id", "day", "ts", "v")) == last(loads)


def test_filters_never_miss_and_seldom_hit_wrongly(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["id"], ["ts"], ["day"])
    many = spark.range(20000).selectExpr("'c' as cmo_id", "string(id) as id", "concat('d', id % 40) as day", "1 as ts", "1 as v")
    table.merge(many)
    assert table.candidates(many.where("id = '777'").selectExpr("*")).count() >= 1
    every = table.candidates(many)
    assert every.count() == len(files(table))
    strangers = table.candidates(spark.createDataFrame([("c", "x-17", "d", 1, 1)], DDL)).count()
    assert strangers <= len(files(table)) // 4


def test_a_load_ranks_its_own_rows_only_and_asks_a_file_once(spark, tmp_path, monkeypatch):
    """Failed before: all rows of the files were ranked anew with the load's, and all keys were asked of every file."""
    ranked, asked = [], []
    once, hit = keyed.deduplicate, KeyedTable._hit
    monkeypatch.setattr(keyed, "deduplicate", lambda df, *a: ranked.append(df.count()) or once(df, *a))
    monkeypatch.setattr(KeyedTable, "_hit", lambda self, known, keys, sizes: asked.append(
        (known.select("file").distinct().count(), keys.count())) or hit(self, known, keys, sizes))
    table = KeyedTable(spark, str(tmp_path), ["id"], ["ts"], ["day"])
    many = spark.range(4000).selectExpr("'c' as cmo_id", "string(id) as id", "concat('d', id % 4) as day", "1 as ts", "1 as v")
    table.merge(many)
    live = len(files(table))
    table.merge(many.where("id % 2 = 0").selectExpr("cmo_id", "id", "day", "int(id % 3) as ts", "2 as v"))
    assert ranked == [4000, 2000]
    assert asked[0][0] == live and asked[0][1] < 100 and asked[1] == (0, 2000) or asked[1][0] < live
    want = [(str(i), 1 if i % 2 or i % 3 == 0 else i % 3, 1 if i % 2 or i % 3 == 0 else 2) for i in range(4000)]
    assert rows(table.read().select("id", "ts", "v")) == sorted(want)


def test_ties_nulls_and_maps_are_decided_as_by_ranking(spark, tmp_path):
    ddl = "id string, ts int, m map<string,int>, d double"
    loads = [[(None, 1, {"a": 1}, 1.0), ("a", None, {"a": 1}, None), ("b", 2, {"a": 1}, float("nan")), ("c", 2, None, 1.0), ("e", 1, None, None)],
             [(None, 1, {"a": 2}, 0.0), ("a", None, {"a": 1}, 0.5), ("b", 2, {"a": 1}, 9.0), ("c", 2, {"z": 0}, None), ("f", 1, None, None)]]
    table = KeyedTable(spark, str(tmp_path), ["id"], ["ts"])
    for load in loads:
        table.merge(spark.createDataFrame(load, ddl).coalesce(1))
    want = deduplicate(spark.createDataFrame(loads[0] + loads[1], ddl), ["id"], ["ts"])
    assert [str(r) for r in rows(table.read())] == [str(r) for r in rows(want)]


def test_a_failed_load_is_written_over(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), ["id"], ["ts"])
    table.merge(frame(spark, [("c", "a", "d", 1, 1)]))
    frame(spark, [("c", "ghost", "d", 1, 1)]).write.parquet(f"{tmp_path}/data/load=2")  # no list of files was committed
    assert [r.id for r in table.read().collect()] == ["a"]
    table.merge(frame(spark, [("c", "b", "d", 1, 1)]))
    assert rows(table.read().select("id")) == [("a",), ("b",)]
    table.merge(frame(spark, []))
    assert rows(table.read().select("id")) == [("a",), ("b",)]


def test_empty_table_and_wrong_scope(spark, tmp_path):
    with pytest.raises(ValueError, match="empty"):
        KeyedTable(spark, str(tmp_path), ["id"], ["ts"]).read()
    with pytest.raises(ValueError, match="levels"):
        KeyedTable(spark, str(tmp_path), ["id"], ["ts"], ["day"], ["cmo_id"])
