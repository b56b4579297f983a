"""The filter audit against plain loops over all orders, and the matrix against counted words."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

import pytest

from tenantlake.llm import filter_audit
from tests.llm.data import DIRTY, dirty, empty

WORDS = " ".join(f"w{i}" for i in range(120))
ROWS = [
    *DIRTY, (20, WORDS, "en"), (21, WORDS, "fr"), (21, WORDS, "fr"), (22, WORDS + " #", "en"), (23, "LOUD " * 120, "en"),
    (24, "É" * 30 + "ABC", ""), (25, "A" + "é" * 9, "fr"), (26, "AB" + "é" * 8, "fr"), (27, None, None), (28, "w0 " * 99 + "w1", "en"),
    (29, "W0 w0\x0bw1\x1cw2 w3 w4", "en"), (30, "x" * 300_000, "de"),
]
LABELS = [(20, 1, 0), (21, 0, 1), (21, 1, None), (23, 1, 1), (None, 1, 1), (2, None, 1), (99, 1, 1)]


def fails(rows):
    """(doc_id, part, failed filters) of every row."""
    out = []
    for doc_id, text, lang in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        twin = doc_id is not None and any(i is not None and i < doc_id and (u or "") == t for i, u, _ in rows)
        flags = (len(words) < 100, 100 * len(set(words)) < 80 * len(words),
                 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search("[#$%&*|]", t)), twin)
        out.append((doc_id, lang or "", "".join(f for f, bad in zip("ABCDE", flags) if bad)))
    return out


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    rows = fails(rows)
    out = {}
    for part in {p for _, p, _ in rows}:
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[1] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [r for r in left if f in r[2]]
                left = [r for r in left if f not in r[2]]
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [
                    len(left), len(removed), sum(f in r[2] for r in gone),
                    sum(r[1] == part and r[2] == f for r in rows),
                    sum(r[0] in good for r in removed if r[0] is not None),
                    sum(r[0] in toxic for r in removed if r[0] is not None)]
                gone += removed
        for (p, order, step), counts in out.items():
            if p == part:
                counts.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_failures_of_dirty_rows(spark):
    got = sorted(((r.doc_id, r.part, "".join(f for f in "ABCDE" if r[f])) for r in
                  filter_audit.failures(dirty(spark, ROWS), 5000).collect()), key=str)
    assert got == sorted(fails(ROWS), key=str)


@pytest.mark.parametrize("labels", [LABELS, []])
def test_audit_equals_all_orders_one_by_one(spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(filter_audit.failures(dirty(spark, ROWS)), known).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(ROWS, labels) and len(got) == 600 * 4


def test_empty_table(spark):
    assert filter_audit.audit(filter_audit.failures(empty(spark)), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_matrix_is_one_dictionary_in_shards(spark):
    """Shards of a few hundred bytes: columns are numbered over all of them without gaps, and say each document's words."""
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(i)), "en") for i in range(60)]
    local, known = filter_audit.document_terms(dirty(spark, rows).repartition(3), 300)
    word = {r.id: r.word for r in known.where("word is not null").collect()}
    assert sorted(word) == list(range(len(word))) and sorted(word.values()) == sorted({w for _, t, _ in rows for w in t.split()})
    shards = filter_audit.matrix(local, known).collect()
    assert len(shards) > 10 and len({s.shard for s in shards}) == len(shards)
    bags = {}
    for s in shards:
        for d, a, b in zip(s.docs, s.starts, s.starts[1:]):
            bags.setdefault(d.doc_id, Counter()).update({word[c]: n for c, n in zip(s.columns[a:b], s.counts[a:b])})
    assert bags == {i: Counter(t.split()) for i, t, _ in rows}
    assert {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.row_totals(local, known).collect()} == {
        i: (sum(b.values()), len(b)) for i, b in bags.items()}


def test_texts_longer_than_a_shard_are_cut_and_counted_once(spark):
    rows = [(i, " ".join(f"w{(i * k) % 37}" for k in range(40 * i)) + " " * i, "en") for i in range(12)] + [(50, "y" * 5000, "en")]
    got = {r.doc_id: (r.n_words, r.n_distinct) for r in filter_audit.failures(dirty(spark, rows), 200).collect()}
    assert got == {i: (len(t.split()), len(set(t.split()))) for i, t, _ in rows}
