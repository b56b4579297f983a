"""Range joins against a plain double loop."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tenantlake.operators.ranges import range_join
from tests.conftest import rows

POINTS, SPANS = "k string, at long, p int", "k string, low long, high long, s int"


def brute(points, spans, keyed):
    found = [(k, a, p, lo, hi, s) if keyed else (k, a, p, j, lo, hi, s) for k, a, p in points for j, lo, hi, s in spans
             if None not in (a, lo, hi) and lo <= a <= hi and (not keyed or (k is not None and k == j))]
    return sorted(found, key=lambda t: tuple(map(str, t)))


def joined(spark, points, spans, keyed, **more):
    left, right = spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS)
    if not keyed:
        right = right.withColumnRenamed("k", "j")
    return range_join(left, right, "at", "low", "high", ["k"] if keyed else [], **more)


def some(rng, n, far):
    ends = [None, -far, far, 0, *[rng.randint(-far, far) for _ in range(20)]]
    points = [(rng.choice(["a", "b", None]), rng.choice(ends), i % 7) for i in range(n)]
    spans = [(rng.choice(["a", "b", None]), lo, rng.choice([lo, None if lo is None else lo + rng.choice([0, 1, 5, far // 3])]), i % 5)
             for i in range(n) for lo in [rng.choice(ends)]]
    return points, spans + [("a", far, -far, 9)]


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("far", [10, 10 ** 6, 2 ** 62])
def test_equals_a_double_loop(spark, keyed, far):
    points, spans = some(random.Random(far), 60, far)
    spans = [s for s in spans if s[2] is None or s[2] < 2 ** 63]
    assert rows(joined(spark, points, spans, keyed)) == brute(points, spans, keyed)


@pytest.mark.parametrize("keyed", [False, True])
def test_crowded_cells_are_dealt_without_losing_or_repeating_pairs(spark, keyed):
    rng = random.Random(5)
    points, spans = some(rng, 50, 1000)
    points += [("a", 500, i) for i in range(40)]  # a hot value, repeated rows among them
    points += points[-10:]
    spans += [("a", 490, 510 + i % 3, i % 4) for i in range(30)]
    assert rows(joined(spark, points, spans, keyed, crowded=7)) == brute(points, spans, keyed)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-40, 40), st.integers(0, 3)), min_size=1, max_size=20),
       st.lists(st.tuples(st.sampled_from("ab"), st.integers(-40, 40), st.integers(-5, 60), st.integers(0, 3)), min_size=1, max_size=20))
def test_any_rows(spark, points, spans):
    spans = [(k, lo, lo + n, s) for k, lo, n, s in spans]
    assert rows(joined(spark, points, spans, True, crowded=5)) == brute(points, spans, True)


def test_empty_sides(spark):
    assert joined(spark, [], [("a", 1, 2, 3)], False).count() == 0
    assert joined(spark, [("a", 1, 2)], [], False).columns == ["k", "at", "p", "j", "low", "high", "s"]


def test_times_dates_and_fractions(spark):
    day = dt.date(2024, 1, 1)
    dates = spark.createDataFrame([(day + dt.timedelta(i),) for i in range(40)], "at date")
    spans = spark.createDataFrame([(day, day + dt.timedelta(10)), (day + dt.timedelta(39), day + dt.timedelta(99))], "low date, high date")
    assert range_join(dates, spans, "at", "low", "high").count() == 12
    times = dates.selectExpr("cast(at as timestamp) + interval 1 microsecond as at")
    assert range_join(times, spans.selectExpr("cast(low as timestamp) as low", "cast(high as timestamp) as high"), "at", "low", "high").count() == 11
    part = spark.createDataFrame([(i / 100,) for i in range(100)] + [(float("nan"),), (float("inf"),)], "at double")
    band = spark.createDataFrame([(0.1, 0.2), (0.195, 0.3), (0.5, float("inf"))], "low double, high double")
    assert range_join(part, band, "at", "low", "high").count() == range_join(part, band, "at", "low", "high", scale=1000).count() == 11 + 11 + 51
    with pytest.raises(TypeError):
        range_join(dates, band, "at", "low", "high")
    with pytest.raises(ValueError):
        range_join(dates.withColumnRenamed("at", "low"), spans, "low", "low", "high")


def test_no_row_meets_every_row(spark):
    points, spans = some(random.Random(1), 30, 1000)
    plan = joined(spark, points, spans, False)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Join" in plan
