"""Rank-one updates and whitening against numpy's own eigendecomposition."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pytest

from tenantlake.llm import whitening
from tenantlake.llm.whitening import Spectrum

CHANCE = np.random.default_rng(5)


def of(x):
    s = Spectrum.of_nothing(x.shape[1])
    for row in x:
        s.add(row)
    return s


def near(s, x):
    centred = x - x.mean(0)
    scatter = centred.T @ centred
    size = max(np.abs(scatter).max(), 1.0)
    assert s.n == len(x) and np.allclose(s.mean, x.mean(0), rtol=1e-12)
    assert np.abs((s.vectors * s.values) @ s.vectors.T - scatter).max() < 1e-10 * size
    assert np.abs(s.vectors.T @ s.vectors - np.eye(x.shape[1])).max() < 1e-11
    assert np.allclose(s.values, np.linalg.eigvalsh(scatter), atol=1e-10 * size)


HARD = {
    "random": CHANCE.normal(size=(300, 12)) * 100 + 100000,
    "repeated": np.repeat(np.floor(CHANCE.normal(size=(4, 9)) * 100), 30, 0) + 100000,
    "fewer rows than dimensions": np.floor(CHANCE.normal(size=(5, 20)) * 100) + 100000,
    "rank two": np.floor(CHANCE.normal(size=(80, 2)) * 9) @ CHANCE.integers(-9, 9, (2, 10)) + 100000,
    "equal eigenvalues": np.vstack((np.eye(8), -np.eye(8))) * 512 + 100000,
    "one direction": np.outer(np.arange(50.0), np.eye(6)[2]),
    "one dimension": CHANCE.normal(size=(40, 1)),
    "one row": np.ones((1, 4)),
    "scales": CHANCE.normal(size=(200, 8)) * 10.0 ** np.arange(-4, 4),
}


@pytest.mark.parametrize("kind", HARD)
def test_spectrum_of_rows_and_of_parts(kind):
    x = HARD[kind]
    near(of(x), x)
    parts = [p for p in np.array_split(x, 5) if len(p)]
    near(reduce(Spectrum.combine, map(of, parts)), x)


def test_secular_roots_between_poles():
    for k in (1, 2, 3, 17, 64):
        d = np.sort(CHANCE.normal(size=k)) * 50
        z = CHANCE.normal(size=k)
        values, _ = whitening.rank_one(d, np.eye(k), z)
        assert np.allclose(values, np.linalg.eigvalsh(np.diag(d) + np.outer(z, z)), rtol=1e-12, atol=1e-11)
        assert np.all(values >= d - 1e-12) and np.all(values[:-1] <= d[1:] + 1e-12)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as n", "2 as component", "3 as c", "4 as place")


def brute(vectors, k):
    x = np.array([[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors])
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    cov = centred.T @ centred / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    return ((n * x - sums) ** 2).sum(1), centred @ vecs / np.sqrt(values), values / np.trace(cov)


def check(spark, rows, parts=7, **more):
    got = whitening.whiten(frame(spark, rows).repartition(parts), **more).collect()
    good = [(i, [np.float32(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    k = min(8, len(good[0][1]))
    deviation, whitened, explained = brute([v for _, v in good], k)
    assert len(got) == len(good) * k
    by = {(r.vec_id, r.component): r for r in got}
    w = np.array([[by[i, j + 1].whitened for j in range(k)] for i, _ in good])
    sign = np.sign((w * whitened).sum(0))
    assert np.abs(w - whitened * sign).max() < 1e-8
    assert {by[i, 1].deviation for i, _ in good} == set(deviation.tolist())
    assert all(by[i, 1].deviation == d for (i, _), d in zip(good, deviation.tolist()))
    assert np.allclose([by[good[0][0], j + 1].explained for j in range(k)], explained, rtol=1e-10)
    assert {r.n for r in got} == {len(good)} and max(r.identity_error for r in got) < 1e-10
    return got


def test_whitening_equals_numpy(spark):
    x = CHANCE.normal(size=(400, 16)) @ CHANCE.normal(size=(16, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [None] + [0.0] * 15), (902, [float("nan")] * 16), (903, [float("inf")] * 16), (904, []), (905, [1.0, 2.0])]
    check(spark, [r for r in rows if r[0] != 905])
    assert whitening.whiten(frame(spark, rows)).where("vec_id >= 900").count() == 0
    check(spark, rows[:60], parts=40)  # tasks with a row or two, combined over two levels


def test_incomplete_basis_is_refined(spark):
    x = CHANCE.normal(size=(300, 24)) * 0.6 ** np.arange(24)
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)], basis=12)


def test_fewer_dimensions_and_repeated_rows(spark):
    x = np.repeat(CHANCE.normal(size=(30, 3)), 4, 0)
    check(spark, [(i, v.tolist()) for i, v in enumerate(x)])


def test_no_variance_and_no_rows(spark):
    got = whitening.whiten(frame(spark, [(None, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert sorted(r.component for r in got) == [1, 1, 2, 2]
    assert all((r.whitened, r.explained, r.deviation, r.identity_error) == (0.0, 0.0, 0, None) for r in got)
    flat = whitening.whiten(frame(spark, [(1, [0.0, 1.0]), (2, [4.0, 1.0])])).collect()
    assert sorted((r.vec_id, r.component, round(abs(r.whitened), 9)) for r in flat) == [(1, 1, 1.0), (1, 2, 0.0), (2, 1, 1.0), (2, 2, 0.0)]
    assert whitening.whiten(frame(spark, [(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0])]).where("false")).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    got = whitening.whiten(frame(spark, [(1, [3e6, 0.0]), (2, [0.0, 1.0])])).where("component = 1").collect()
    assert all(r.deviation is None and abs(abs(r.whitened) - 1) < 1e-9 for r in got)
