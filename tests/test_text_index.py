"""Searches by postings against a scan of all rows, and the parts that they open."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenantlake.functions import scalars as S
from tenantlake.operators.filters import text_search
from tenantlake.sources.text_index import GRAMS, TextIndex, tokens, trigrams
from tests.conftest import rows

DDL = "id int, name string, note string"
TERMS = ["Lot", "LOT 7", "cmo-1", "ünï", "zz", "", "😀😀😀", "absent everywhere", "a'b\\c%_", "x" * 500]


def some(n, seed):
    rng = random.Random(seed)
    words = ["lot 7", "LOT 77", "cmo-1", "cmo-11", "Ünï çödé", "zz", "😀😀😀😀", "a'b\\c%_", "", "plain", "cmo-1.", "(cmo-1)", "x" * 700]
    pick = lambda: rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 5)))])
    return [(rng.choice([None, i]), pick(), pick()) for i in range(n)]


def test_words_of_texts(spark):
    df = spark.createDataFrame([("abcab",), ("AB",), (None,), ("",), ("a😀Éb",)], "t string")
    assert [sorted(r[0]) for r in df.select(trigrams(F.col("t"))).collect()] == [["abc", "bca", "cab"], [], [], [], ["a😀é", "😀éb"]]
    got = spark.createDataFrame([("cmo-7,cmo-7 \"cmo-70\"",), (None,)], "t string").select(tokens(F.col("t"))).collect()
    assert [r[0] for r in got] == [["cmo-7", "cmo-70"], []]
    assert len(TextIndex.words_of("".join(map(chr, range(200, 900))))) <= GRAMS and TextIndex.words_of("ab") == []


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    index = TextIndex(spark, str(tmp_path_factory.mktemp("text") / "rows"), ["name", "note"],
                      [lambda names: F.to_json(F.struct(*names)), lambda names: F.concat_ws("\n", "name", "note")], buckets=4)
    loads = [some(150, 1), some(60, 2), []]
    loads[1] += loads[1][:5]
    index.add(1, spark.createDataFrame(some(40, 9), DDL))
    for n, load in enumerate(loads):
        index.add(n, spark.createDataFrame(load, DDL), part_rows=20)  # load 1 a second time: it is replaced
    return index, spark.createDataFrame(sum(loads, []), DDL)


def test_searches_equal_a_scan(loaded):
    index, whole = loaded
    assert index.loads() == [0, 1, 2] and rows(index.read()) == rows(whole)
    for term in TERMS:
        assert rows(index.search(term)) == rows(text_search(whole, term, ["name", "note"])), term


def test_whole_tokens_equal_a_scan(loaded):
    index, whole = loaded
    for token in ("cmo-1", "cmo-11", "cmo", "plain", "a'b"):
        either = S.record_has_token(whole.columns, token) | S.has_token(F.concat_ws("\n", "name", "note"), token)
        assert rows(index.with_token(token)) == rows(whole.where(either)), token


def test_a_search_opens_the_parts_that_can_match(spark, tmp_path):
    table = [(i, "common text", f"item {i:04d}") for i in range(200)]
    index = TextIndex(spark, f"{tmp_path}/rows", ["name", "note"], buckets=8)
    index.add(0, spark.createDataFrame(table, DDL), part_rows=10)
    assert len(index.opened(index.words_of("common"))) == 20
    words = index.words_of("item 0123")
    read = index.search("ITEM 0123").inputFiles()
    assert len(index.opened(words)) == 1 and len([f for f in read if "/part=" in f]) == 1
    assert len({f.rsplit("/", 2)[1] for f in read if "/bucket=" in f}) < 8
    assert [r.id for r in index.search("ITEM 0123").collect()] == [123]
    assert index.opened(["gnot"]) == [] and index.search("nothing").count() == 0


def test_records_are_looked_at_in_the_rows_of_the_postings_only(spark, tmp_path):
    """Failed before: the look at the records ran on every row of the opened parts, again for each report over them."""
    table = [(i, "cmo-1" if i % 50 == 0 else "cmo-2", f"item {i}") for i in range(200)]
    index = TextIndex(spark, f"{tmp_path}/rows", records=[lambda names: F.to_json(F.struct(*names))])
    index.add(0, spark.createDataFrame(table, DDL))
    found = index.with_token("cmo-1")
    assert sorted(r.id for r in found.collect()) == [0, 50, 100, 150]
    read = found.inputFiles()
    assert read and not [f for f in read if "/part=" in f] and spark.read.parquet(*read).count() == 4


def test_odd_tables(spark, tmp_path):
    index = TextIndex(spark, f"{tmp_path}/none", ["name"])
    with pytest.raises(ValueError):
        index.add(0, spark.createDataFrame([], "part int, name string"))
    with pytest.raises(ValueError):
        index.with_token("cmo-1")
    index.add(0, spark.createDataFrame([], DDL))
    assert index.search("anything").count() == 0 and index.read().columns == ["id", "name", "note"]
