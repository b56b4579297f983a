"""Operators that relate documents to each other, and the pipeline, against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tenantlake.llm import components, decontaminate, fingerprints, lm, packing, simhash, tokens
from tenantlake.llm.common import ship, table
from tests.llm.data import DIRTY, SF, dirty, empty

needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables are not here")


@pytest.fixture(autouse=True)
def code(spark):
    ship(spark)


class Sets:
    def __init__(self):
        self.parent = {}

    def find(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            x = self.parent[x]
        return x

    def unite(self, a, b):
        a, b = self.find(a), self.find(b)
        self.parent[max(a, b)] = min(a, b)


# components

def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(8, 40)]
    odd = [(3, 3), (None, 5), (1, 2), (2, 1), (1, 2)]
    links = spark.createDataFrame(chain + star + odd, "a long, b long")
    got = {r.node: r.component for r in components.components(links).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(7, 40)}, 1: 1, 2: 1}
    assert components.components(links.where("false")).count() == 0


# near duplicates

def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i:i + 3]), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(rows):
    sets, prints = Sets(), [(i, brute_print(t)) for i, t in rows]
    for i, f in prints:
        sets.find(i)
    for k, (i, f) in enumerate(prints):
        for j, g in prints[:k]:
            if (f ^ g).bit_count() <= 3:
                sets.unite(i, j)
    return {(i, f"{f:016x}", sets.find(i)) for i, f in prints}


@needs_tables
def test_near_duplicates_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, (k, t, _) in enumerate(DIRTY) if k is not None]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.near_duplicates(docs).collect()} == brute_groups(rows)


def test_fingerprints_up_to_three_bits_apart_meet(spark):
    chance = random.Random(4)
    fps = [chance.getrandbits(64) for _ in range(40)]
    near = [f ^ sum(1 << b for b in chance.sample(range(64), d)) for f in fps for d in (1, 2, 3, 4)]
    signed = [x - (1 << 64) if x >> 63 else x for x in {*fps, *near}]
    links = simhash._meetings(simhash._variants(spark.createDataFrame([(x,) for x in signed], "fp long")))
    sets = Sets()
    for r in links.collect():
        assert ((r.a ^ r.b) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 3
        sets.unite(r.a, r.b)
    want = Sets()
    for i, x in enumerate(signed):
        for y in signed[:i]:
            if ((x ^ y) & 0xFFFFFFFFFFFFFFFF).bit_count() <= 3:
                want.unite(x, y)
    assert all(sets.find(x) == want.find(x) for x in signed)


def test_large_groups_connect_as_pairwise_comparison_does():
    chance = random.Random(9)
    key, block = chance.getrandbits(64) & ~(0xFFFF << 16), 1
    fps = set()
    while len(fps) < simhash.DIRECT + 300:
        outside = [b for b in range(64) if not 16 <= b < 32]
        flip = 0 if chance.random() < 0.4 else 1 << chance.choice(outside)
        fps.add((key ^ flip) | (chance.getrandbits(16) & chance.getrandbits(16) & chance.getrandbits(16)) << 16)
    fps = np.array(sorted(fps), np.uint64)
    got, want = Sets(), Sets()
    for i, j in simhash.group_links(fps, key, block):
        assert int(fps[i] ^ fps[j]).bit_count() <= 3
        got.unite(i, j)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= 3).tolist():
            # two with the same flipped bit meet under the key that is flipped so, not here
            same, plain = (int(f) & ~(0xFFFF << 16) for f in (fps[i] ^ fps[j], fps[i] ^ np.uint64(key)))
            if same or not plain:
                want.unite(i, j)
    assert all(got.find(i) == want.find(i) for i in range(len(fps)))


def test_near_duplicates_of_odd_tables(spark):
    docs = dirty(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(DIRTY)
    groups = {r.doc_id: r.component_id for r in got}
    assert groups[1] == groups[5] == groups[6] == 1 and groups[2] == groups[3] == groups[4] == 2 and groups[7] == groups[8]
    assert simhash.near_duplicates(empty(spark)).count() == 0
    same = dirty(spark, [(4, "one equal text of some words", "en")] * 3 + [(None, "one equal text of some words", "de"), (9, "One equal text of some words", "fr")])
    assert [r.doc_id for r in simhash.keep_one(same).collect()] == [4]
    assert simhash.keep_one(dirty(spark, [(None, "no id here", "en")] * 2)).count() == 1
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 7, 9, 11, 12]


# packing

def check_packing(pieces, texts, capacity):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokens.public_path(tokens.WORD_BPE))
    want = Counter()
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s:s + capacity]
            want[(i, k, s, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == want
    bins = {}
    for r in pieces:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(r.length for r in pieces) // capacity)


@needs_tables
def test_packing_is_whole_and_tight(spark):
    docs = table(spark, SF, "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    bins, least = check_packing(packing.pack(docs).collect(), texts, 2048)
    assert bins <= least + 1
    bins, least = check_packing(packing.pack(docs, capacity=512, shard_size=100).collect(), texts, 512)
    assert bins <= 1.03 * least + 1


def test_packing_of_odd_tables(spark):
    check_packing(packing.pack(dirty(spark)).collect(), [(i, t) for i, t, _ in DIRTY], 2048)
    assert packing.pack(empty(spark)).count() == 0


def test_crossover_keeps_every_piece_once():
    chance = random.Random(2)
    lengths = [chance.randint(1, 90) for _ in range(300)]
    orders = [chance.sample(range(300), 300) for _ in range(2)]
    a, b = (packing.best_fit(lengths, o, 100) for o in orders)
    child = packing.crossover(a, b, lengths, 100, chance)
    assert sorted(i for x in child for i in x) == list(range(300))
    assert all(sum(lengths[i] for i in x) <= 100 for x in child)
    evolved = packing.evolve(lengths, 100, 1)
    assert len(evolved) <= min(len(a), len(b)) and len(evolved) >= -(-sum(lengths) // 100)


# fingerprints

def test_window_ranks_against_counts():
    data = np.frombuffer(("the quick brown fox " * 9 + "a" * 90 + "é日本語" * 20).encode(), np.uint8)
    w = fingerprints.WINDOW
    ranks = fingerprints.window_ranks(data)
    assert ranks.tolist() == [fingerprints._SUM[np.bincount(data[i:i + w])].sum() for i in range(len(data) - w + 1)]


@needs_tables
def test_fingerprints_against_one_text_at_a_time(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, (k, t, _) in enumerate(DIRTY) if k is not None and len(t or "") < 200]
    got = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), 50_000).collect()}
    rows = sorted((i, t or "") for i, t in rows)
    assert len(got) == len(rows)

    def alone(t):
        raw = t.encode()
        return fingerprints._digests([raw], [fingerprints.window_ranks(np.frombuffer(raw, np.uint8))])[0]

    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        changed = fingerprints.edited(text, after)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest() and got[i].n_chars == len(text)
        a, b = alone(text), alone(changed)
        assert got[i].fingerprint == fingerprints.encoded(a) and got[i].edited_fingerprint == fingerprints.encoded(b)
        assert got[i].near_edited == fingerprints.likeness(a, b) and got[i].near_next == fingerprints.likeness(a, alone(after))
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    long = [r for r in got.values() if r.n_chars > 600]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


def test_fingerprints_don_t_hang_on_the_ranges(spark, monkeypatch):
    """Ids beyond what a double holds exactly, repeated ids, and cuts made in two steps give what one range gives."""
    rng = random.Random(8)
    base = (1 << 62) + 1
    rows = [(rng.choice([None, base + i // 2, i, -i]), " ".join(rng.choices("abcdefgh", k=rng.randint(0, 200)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    by_id = lambda got: sorted((tuple(r) for r in got.collect()), key=str)
    whole = by_id(fingerprints.fingerprints(docs, 1 << 30))
    assert len(whole) == 300 and len(fingerprints._range_starts(docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63)))), 3000)) > 5
    assert by_id(fingerprints.fingerprints(docs, 3000)) == whole
    monkeypatch.setattr(fingerprints, "MOST_CUTS", 3)
    monkeypatch.setattr(fingerprints, "MOST_PARTITIONS", 4)
    assert len(fingerprints._range_starts(docs.withColumn("place", F.coalesce("doc_id", F.lit(-(1 << 63)))), 3000)) > 5
    assert by_id(fingerprints.fingerprints(docs, 3000)) == whole


def test_fingerprints_of_odd_tables(spark):
    got = fingerprints.fingerprints(dirty(spark)).collect()
    assert len(got) == len(DIRTY)
    same = {r.doc_id: r.fingerprint for r in got}
    assert same[1] == same[5] != same[6] and same[2] == same[3] == ""
    one = fingerprints.fingerprints(dirty(spark).where("doc_id = 1")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(empty(spark)).count() == 0


# language-model scores

def brute_tree(train, depth):
    """Context-tree weighting by recursion over counts kept for every context."""
    counts = {}
    for text in train:
        data = b"\n" * depth + text
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = data[i] >> k & 1
                    counts.setdefault((data[i - d:i], node), [0, 0])[bit] += 1
                    node = node << 1 | bit

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi) if a + b else 0.0

    weighted = {}
    for d in range(depth, -1, -1):
        for (context, node), (a, b) in counts.items():
            if len(context) == d:
                pe = kt(a, b)
                if d == depth:
                    weighted[context, node] = pe
                else:
                    below = sum(weighted.get((bytes([x]) + context, node), 0.0) for x in range(256))
                    weighted[context, node] = math.log(.5) + max(pe, below) + math.log(1 + math.exp(-abs(pe - below)))

    def p_one(history, node, d=0):
        context = history[len(history) - d:]
        a, b = counts.get((context, node), (0, 0))
        if d == depth:
            return (b + .5) / (a + b + 1)
        stop = math.exp(math.log(.5) + kt(a, b) - weighted.get((context, node), 0.0)) if a + b else 0.5
        return stop * (b + .5) / (a + b + 1) + (1 - stop) * p_one(history, node, d + 1)

    def score(text):
        data, total = b"\n" * depth + text, 0.0
        for i in range(depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                p = p_one(data[i - depth:i], node)
                total += math.log10(p if bit else 1 - p)
                node = node << 1 | bit
        return total
    return score


def test_scores_against_a_recursive_tree(spark):
    rows = [(i, t) for i, t, _ in DIRTY if len(t or "") < 200] + [(i, "the cat and the dog " * (i % 4)) for i in range(100, 130)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = lm.score_documents(docs, depth=2, word_rows=7, gram_rows=50).collect()  # several slices
    assert len(got) == len(rows)

    def out(i):
        return (zlib.crc32(str(i).encode()) if i is not None else 0) % 10 == 0

    def words(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))

    count = Counter(w for i, t in rows if not out(i) for w in [*words(t), b"\n"])
    n, v = sum(count.values()), len(count)
    score = brute_tree([b" ".join(words(t)) + b"\n" for i, t in rows if not out(i)], 2)
    want = sorted((str(i), out(i), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), b"\n"]), n,
                   round(sum(math.log10((count[w] + .1) / (n + .1 * (v + 1))) for w in [*words(t), b"\n"]), 6),
                   round(score(b" ".join(words(t)) + b"\n"), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
                  for r in got) == want


@needs_tables
def test_scores_beat_the_base_on_held_out_text(spark):
    got = lm.score_documents(table(spark, "/root/testdata/sf0.01", "documents")).where("held_out").agg(
        F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_of_odd_tables(spark):
    assert lm.score_documents(empty(spark)).count() == 0


@needs_tables
def test_scores_are_the_rows_own_behind_a_shuffle(spark):
    """An input whose partitions adaptive execution merges, differently with and without the texts."""
    docs = table(spark, SF, "documents")
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "20k")
    try:
        dealt = docs.groupBy("doc_id").agg(F.first("text").alias("text"))
        got, want = ({r.doc_id: (r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 6))
                      for r in lm.score_documents(d).collect()} for d in (dealt, docs))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert got == want and len(got) == docs.count()


def test_scores_of_held_out_rows_only(spark):
    held = dirty(spark, [(i, "a b", "en") for i in range(60) if zlib.crc32(str(i).encode()) % 10 == 0])
    for r in lm.score_documents(held).collect():
        assert r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9
        assert abs(r.score - 4 * 8 * math.log10(0.5)) < 1e-9 and abs(r.bits_per_byte - 8) < 1e-9


# decontamination

def test_leaks_within_the_allowed_edits_are_found():
    chance = random.Random(1)
    vocabulary = [f"w{i}" for i in range(2000)]
    items = [" ".join(chance.choices(vocabulary, k=chance.randint(1, 60))) for _ in range(80)]
    known = decontaminate.Items(list(range(80)), items)
    hit = 0
    for k, item in enumerate(items):
        words = item.split()
        for _ in range(decontaminate.allowed(len(words))):
            words[chance.randrange(len(words))] = chance.choice(vocabulary)
        text = " ".join([*chance.choices(vocabulary, k=30), *words, *chance.choices(vocabulary, k=30)])
        hit += any(i == k for _, i, *_ in known.find([text]))
    assert hit >= 0.95 * len(items)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


@needs_tables
def test_leaks_against_all_windows(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r.doc_id, r.item_id): r.distance for r in decontaminate.leaks(docs, items, item_rows=15).collect()}

    def words(t):
        return re.findall(r"[^\W_]+", t.lower())

    want = {}
    bench = [(r.item_id, words(r.text)) for r in items.collect()]
    for r in docs.collect():
        text = words(r.text)
        for k, item in bench:
            n, edits, bag = len(item), decontaminate.allowed(len(item)), Counter(item)
            for s in range(len(text)):
                window = text[s:s + n]
                if sum((Counter(window) & bag).values()) >= n - edits:
                    d = brute_distance(item, window)
                    if d <= edits:
                        want[r.doc_id, k] = min(d, want.get((r.doc_id, k), d))
    assert want and got == want


def test_leaks_of_odd_tables(spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, None), (3, ""), (None, "x"), (4, "?!"), (5, "the cat sat on the mat")],
                                  "item_id long, text string")
    docs = dirty(spark)
    got = decontaminate.leaks(docs, items).collect()
    x = [r[0] for r in DIRTY if "x" in re.findall("[a-z0-9]+", (r[1] or "").lower())]  # hold the item without an id
    assert sorted(((r.doc_id, r.item_id, r.distance) for r in got), key=str) == sorted(
        [(i, k, 0) for i in (1, 5, 6) for k in (1, 5)] + [(i, None, 0) for i in x], key=str)
    assert decontaminate.clean(docs, items).columns == docs.columns
    assert decontaminate.clean(docs, items).count() == len(DIRTY) - 3 - len(x)
    assert decontaminate.clean(docs, items.where("false")).count() == len(DIRTY)
    assert decontaminate.leaks(empty(spark), items).count() == 0


# queries and pipeline

@needs_tables
def test_pipeline_stages_against_brute_force(spark):
    import corpus_pipeline
    from tenantlake.llm import language, quality

    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = corpus_pipeline.keep_quality(spark, docs, SF)
    model = quality.fit(docs, table(spark, SF, "labels"))
    rows = docs.collect()
    want = [r.doc_id for r in rows if model.tails(np.array([model.score(r.text)]))[0, -1] >= 0.5]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and kept.columns == columns
    kept = corpus_pipeline.keep_language(spark, docs, SF)
    scores = {r.doc_id: r.score for r in language.identify(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in scores.items() if s >= 0.2) and kept.columns == columns
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    want = {i for i, _, c in brute_groups([(r.doc_id, r.text) for r in rows]) if i == c}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == columns
    kept = corpus_pipeline.drop_benchmark_leaks(spark, docs, SF)
    leaked = {r.doc_id for r in decontaminate.leaks(docs, table(spark, SF, "benchmark")).collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows} - leaked and kept.columns == columns


@needs_tables
def test_pipeline_runs_whole(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_dedup", "decontamination", "packing"]
    got = corpus_pipeline.run(spark, SF)
    assert 0 < got.select("doc_id").distinct().count() < table(spark, SF, "documents").count()


def test_every_operator_has_a_query():
    from tenantlake.llm.queries import QUERIES

    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))
