"""The newest row of every key, from a base and deltas: against a plain dict, over replays and folding."""

from __future__ import annotations

import random
from pathlib import Path

import pytest

from tenantlake.streaming.latest import LatestRows
from tests.conftest import rows

DDL = "part string, id int, n int"


def test_newest_rows_of_many_batches(spark, tmp_path):
    rng, state = random.Random(3), {}
    log = LatestRows(spark, f"{tmp_path}/rows", ["part", "id"], fold_every=3)
    with pytest.raises(ValueError):
        log.read()
    for batch_id in range(11):
        batch = {(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None])): rng.choice([batch_id, None]) for _ in range(4)}
        if batch_id == 7:
            batch = {}
        got = spark.createDataFrame([(*k, v) for k, v in batch.items()], DDL)
        for _ in range(1 + batch_id % 2):  # every other batch is replayed
            log.put(got, batch_id)
        state |= batch
        assert rows(log.read()) == sorted(((*k, v) for k, v in state.items()), key=lambda t: tuple(map(str, t)))


def test_what_is_read_doesnt_grow_with_the_batches(spark, tmp_path):
    log = LatestRows(spark, f"{tmp_path}/rows", ["part", "id"], fold_every=4)
    sizes, kept = [], []
    for batch_id in range(24):
        log.put(spark.createDataFrame([("a", i, batch_id) for i in range(20)], DDL), batch_id)
        sizes.append(len(log._parts()))
        kept.append(len(list(Path(f"{tmp_path}/rows").iterdir())))
    assert max(sizes) <= 4 and max(kept[8:]) <= 2 * 4 + 2
    assert rows(log.read()) == sorted((("a", i, 23) for i in range(20)), key=lambda t: tuple(map(str, t)))


def test_a_failed_fold_is_not_read(spark, tmp_path):
    log = LatestRows(spark, f"{tmp_path}/rows", ["part", "id"], fold_every=2)
    log.put(spark.createDataFrame([("a", 1, 1)], DDL), 0)
    log.put(spark.createDataFrame([("a", 1, 2)], DDL), 1)
    Path(f"{tmp_path}/rows/base-1/_SUCCESS").unlink()  # as if the fold had died; the deltas are still there
    assert log._parts() == [("delta", 0), ("delta", 1)] and rows(log.read()) == [("a", 1, 2)]
    log.put(spark.createDataFrame([("a", 1, 2)], DDL), 1)
    assert log._parts() == [("base", 1)] and rows(log.read()) == [("a", 1, 2)]
