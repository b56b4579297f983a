"""Every registered query against its SQL in DuckDB, on the smallest shared tables."""

from __future__ import annotations

import os

import pytest

from tenantlake.plans import REGISTRY

SF = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


@pytest.fixture(scope="module")
def con():
    from tools.check_oracle import duck

    return duck(SF)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_matches_sql(spark, con, name):
    from tools.check_oracle import compare

    entry = REGISTRY[name]
    df = entry.fn(spark, SF)
    if entry.sql is None:
        assert df.columns
        return
    assert [p for p in compare(df, con, entry.sql) if not p.startswith("no rows")] == []


def test_every_query_is_named_for_what_it_does():
    assert all(name == name.lower() and "pipeline" != name for name in REGISTRY)
    assert all(entry.covers for entry in REGISTRY.values())
