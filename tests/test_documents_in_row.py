"""Documents resolved in their rows against the windows over all their blocks, on odd block graphs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tenantlake.operators import documents
from tenantlake.sources.readers import OCR_BLOCK
from tests.conftest import rows

DDL = f"doc_id string, cmo_id string, data_domain string, file_key string, blocks array<{OCR_BLOCK.simpleString()}>"


def _graph(rng):
    """Blocks whose ids repeat, are null or aren't there, of all types, with any links."""
    ids = [None, "a", "b", "c", "d", "e", "gone"]
    pick = lambda *x: rng.choice(x)

    def block():
        links = [(pick("CHILD", "CHILD", "CHILD", "VALUE", "OTHER", None), pick(None, [rng.choice(ids) for _ in range(rng.randint(0, 5))],
                  [rng.choice(ids) for _ in range(rng.randint(0, 5))])) for _ in range(rng.randint(0, 3))]
        return (rng.choice(ids), pick("WORD", "WORD", "CELL", "TABLE", "KEY_VALUE_SET", "KEY_VALUE_SET", "LINE", None), pick(None, "", "x", "y z"),
                pick(None, 90.0), pick(None, 1, 2), pick(None, 1, 2, 3), pick(None, ["KEY"], ["KEY"], ["VALUE"], []), pick(None, links, links, links))

    return pick(None, [], *[[block() for _ in range(rng.randint(4, 16))] for _ in range(9)])


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    table = [(f"d{i}", "cmo-a", "coa", "x/incoming/b/coa/f.pdf", _graph(rng)) for i in range(400)]
    table += [(None, "cmo-a", "coa", "f.png", _graph(rng)) for _ in range(3)] + [("twice", "cmo-b", "coa", "f.png", _graph(rng)) for _ in range(2)]
    return spark.createDataFrame(table, DDL)


@pytest.mark.parametrize("made", ["block_text", "forms", "cells", "table_rows", "table_records", "matrices", "record_tables"])
def test_rows_equal_windows(docs, made):
    made = getattr(documents, made)
    text = lambda df: rows(df.select(*[F.to_json(F.col(c)) if t.startswith("map") else F.col(c).cast("string") for c, t in df.dtypes]))
    want = text(made(documents.stage_blocks(docs)))
    assert text(made(docs)) == want and len(want) > 5


def test_process_documents_of_either_way(docs, monkeypatch):
    def done():
        df = documents.process_documents(docs, "lake", F.current_timestamp())
        return rows(df.select("doc_id", "cmo_id", F.array_sort(F.map_entries("forms")), "tables", "confidence", "block_count", "lines"))
    either = done()
    monkeypatch.setattr(documents, "IN_ROW", -1)
    assert either == done() and len(either) == 405


def test_documents_of_many_blocks_are_set_apart(spark, docs, monkeypatch):
    monkeypatch.setattr(documents, "IN_ROW", 12)
    easy, others = documents.dealt(docs)
    assert easy.count() > 20 and others.where("doc_id like 'd%'").count() > 20 and easy.count() + others.count() == 405
    assert rows(documents.cells(docs)) == rows(documents.cells(documents.stage_blocks(docs)))
    assert documents.dealt(docs.where("doc_id = 'd1'").withColumn("blocks", F.lit(None).cast(docs.schema["blocks"].dataType)))[1] is None


def test_documents_in_rows_need_no_exchange(spark, docs, tmp_path):
    """Failed before: every block of every document was exchanged and sorted twice."""
    docs.where("doc_id like 'd%'").write.parquet(f"{tmp_path}/docs")
    kept = spark.read.parquet(f"{tmp_path}/docs")
    for made in (documents.block_text(kept), documents.forms(kept), documents.table_rows(kept), documents.table_records(kept),
                 documents.process_documents(kept, "lake", F.current_timestamp())):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_stream_of_documents_keeps_its_responses_compressed(spark, tmp_path, monkeypatch):
    """Failed before: the responses were written as plain JSON, and staged as a table beside it."""
    from tenantlake.plans import streams as plans

    spark.createDataFrame([(i, i % 50, "O", "1-URGENT") for i in range(1, 41)], "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(
        f"{tmp_path}/orders.parquet")
    paths = iter(range(10))
    monkeypatch.setattr(plans, "scratch_path", lambda spark, name: f"{tmp_path}/kept/{next(paths)}")
    got = rows(plans.stream_documents(spark, str(tmp_path)))
    assert [r[0] for r in sorted(got)] == list(range(2, 41, 2)) and all(r[3] == str(r[0]) for r in got)
    files = [p.name for p in (tmp_path / "kept").glob("*/ocr/part-*")]
    assert files and all(f.endswith(".json.gz") for f in files)
