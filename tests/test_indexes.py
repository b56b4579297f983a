"""Pages from an order index against a sorted list, and listings and their changes against what was done to the files."""

from __future__ import annotations

import os
import random

import pytest

from tenantlake.sources.order_index import OrderIndex
from tenantlake.sources.snapshots import ListingSnapshots, differences, list_tree
from tests.conftest import rows

DDL = "price double, id int, name string"


def in_order(table):
    """Falling price with nulls last, then id and name with nulls first."""
    none_first = lambda v: (v is not None, v if v is not None else 0)
    return sorted(table, key=lambda r: (r[0] is None, -(r[0] or 0), none_first(r[1]), (r[2] is not None, r[2] or "")))


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    rng = random.Random(2)
    table = [(rng.choice([None, 1.5, 2.0, 2.0, 2.0, float(i)]), rng.choice([None, i % 9]), rng.choice(["x", None, str(i)])) for i in range(120)]
    table += table[:5]
    index = OrderIndex(spark, str(tmp_path_factory.mktemp("index") / "by-price"), ["-price", "id"])
    index.build(spark.createDataFrame(table, DDL), range_rows=20)
    return index, in_order(table)


def test_pages_are_those_of_the_sorted_table(laid):
    index, want = laid
    assert index.total() == 125 and index.ranges().count() > 3
    for page in (1, 3, 8, 13, 14):
        assert [tuple(r) for r in index.page(page, 10).collect()] == want[(page - 1) * 10:page * 10]
    with pytest.raises(ValueError):
        index.page(0, 10)


def test_a_page_opens_its_ranges_only(laid):
    index, _ = laid
    assert len(index.opened(1, 10)) == 1 and all(len(index.opened(p, 10)) <= 2 for p in (3, 8, 13))
    assert len(index.page(13, 10).inputFiles()) <= 2


def test_the_page_after_a_row(laid):
    index, want = laid
    for at in (0, 20, 67, 110, 124):
        row = dict(zip(("price", "id", "name"), want[at]))
        last = max(i for i, r in enumerate(want) if r == want[at])  # equal rows are passed together
        assert [tuple(r) for r in index.after(row, 7).collect()] == want[last + 1:last + 8]


def test_an_empty_table_has_no_pages(spark, tmp_path):
    index = OrderIndex(spark, f"{tmp_path}/none", ["-price"])
    index.build(spark.createDataFrame([], DDL))
    assert index.total() == 0 and index.page(1, 10).collect() == [] and index.page(1, 10).columns == ["price", "id", "name"]
    assert index.after({"price": None, "id": 1, "name": "x"}, 3).collect() == []


def test_changes_between_two_listings_of_a_tree(spark, tmp_path):
    root = tmp_path / "lake"
    for i in range(12):
        folder = root / f"cmo-{i % 3}" / "deep" / "er" / str(i % 2)
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"f {i}=.csv").write_text("x" * i)
    (root / "top.csv").write_text("t")
    kept = ListingSnapshots(spark, f"{tmp_path}/listings")
    assert kept.take(list_tree(spark, str(root))) == 1
    known = {os.path.relpath(p, root): s for p, s in ((r.path.removeprefix("file://"), r.size) for r in kept.read().collect())}
    assert known == {os.path.relpath(f"{d}/{f}", root): os.path.getsize(f"{d}/{f}") for d, _, fs in os.walk(root) for f in fs}
    one = root / "cmo-1" / "deep" / "er" / "1" / "f 1=.csv"
    one.write_text("longer")
    (root / "top.csv").unlink()
    (root / "cmo-2" / "new.csv").write_text("")
    kept.take(list_tree(spark, str(root), depth=0))
    assert sorted((r.path.rsplit("/", 1)[1], r.change, r.size, r.size_before) for r in kept.since(1).collect()) == [
        ("f 1=.csv", "changed", 6, 1), ("new.csv", "added", 0, None), ("top.csv", "removed", None, 1)]
    assert kept.since(2).count() == 0 and differences(kept.read(0), kept.read(1)).count() == 13


def test_odd_listings(spark):
    ddl = "path string, size long, modified timestamp"
    two = spark.createDataFrame([("a", 1, None), ("a", 1, None), (None, 3, None), ("b", None, None)], ddl)
    assert rows(differences(two, two)) == []
    assert rows(differences(two.where("false"), two).select("path", "change", "size")) == [("a", "added", 1), ("b", "added", None)]
