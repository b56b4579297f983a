"""Exact de-duplication against a plain loop, over runs, colliding digests and dirty rows."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tenantlake.llm import exact_dedup
from tenantlake.session import scratch_path
from tests.llm.data import DIRTY, dirty, empty


def brute(rows):
    """(doc_id, keep_id, group_size, text_sha256), and how many of each group are kept."""
    groups = defaultdict(list)
    lower = str.maketrans(exact_dedup.UPPER, exact_dedup.UPPER.lower())
    for doc_id, text, *_ in rows:
        groups[(text or "").translate(lower)].append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def found(df):
    rows = df.collect()
    keepers = defaultdict(list)
    for r in rows:
        keepers[r.text_sha256].append((r.kept, r.doc_id, r.keep_id))
    for group in keepers.values():
        assert [i for kept, i, _ in group if kept] == [group[0][2]]  # one row of each group stays, the one it says
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str)


def test_dirty_rows(spark):
    assert found(exact_dedup.exact_duplicates_of(dirty(spark))) == brute(DIRTY)
    assert exact_dedup.exact_duplicates_of(empty(spark)).count() == 0


def test_only_ascii_letters_are_folded(spark):
    rows = [(1, "ÀB", None), (2, "àb", None), (3, "Àb", None), (4, "İX ẞ", None), (5, "İx ẞ", None)]
    assert found(exact_dedup.exact_duplicates_of(dirty(spark, rows))) == brute(rows)


def write(spark, path, rows):
    dirty(spark, rows).select("doc_id", "text").coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda text: F.encode((F.length(text) % 3).cast("string"), "UTF-8")])
def test_state_is_kept_over_batches_and_runs(spark, digest):
    """Files one at a time and in two runs; a digest of three values, whose texts are told apart in full."""
    path, state = scratch_path(spark, "exact-in"), scratch_path(spark, "exact-state")
    rows = [(i, f"text {i % 7}" * (1 + i % 4) if i % 5 else "Copy", None) for i in range(60)]
    for k in range(0, 40, 10):
        write(spark, path, rows[k:k + 10])
    first = exact_dedup.ExactDedup(spark, path, state, digest, files_per_batch=1).advance()

    def groups(members):
        ids = {r.doc_id: (r.keep.doc_id, r.rows, r.kept) for r in members.collect()}
        return sorted((i, keep, n) for i, (keep, n, kept) in ids.items() if kept == (i == keep))

    assert groups(first.members()) == sorted(r[:3] for r in brute(rows[:40]))
    write(spark, path, rows[40:])
    again = exact_dedup.ExactDedup(spark, path, state, digest, files_per_batch=1).advance()
    assert again.log().count() == 60
    assert groups(again.members()) == sorted(r[:3] for r in brute(rows))
    batches = spark.read.format("state-metadata").load(f"{state}/keys").first()
    assert batches.maxBatchId >= 4


def test_lost_content_is_reported(spark):
    path, state = scratch_path(spark, "exact-in"), scratch_path(spark, "exact-state")
    write(spark, path, [(1, "same", None)])
    write(spark, path, [(2, "same", None)])
    run = exact_dedup.ExactDedup(spark, path, state).advance()
    spark.createDataFrame([(9, "other")], "doc_id long, text string").write.mode("overwrite").parquet(path)
    with pytest.raises(RuntimeError, match="locators"):
        run.members()


def test_no_python_on_the_executors(spark):
    path, state = scratch_path(spark, "exact-in"), scratch_path(spark, "exact-state")
    write(spark, path, [(1, "same", None), (2, "Same", None)])
    run = exact_dedup.ExactDedup(spark, path, state).advance()
    for df in (exact_dedup.deduplicated(run.members()), run._compared(run.keys())):
        plan = df._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
