"""Language-model scores by context-tree weighting over bytes.

Each byte is coded as eight binary decisions. A node of the context tree is a context of 0 to ``depth`` preceding
bytes together with the decisions made so far; it holds the zeros and ones seen there in training, whose
Krichevsky-Trofimov probability is weighted one half against the product of its children's weighted probabilities.
Counts, weights and predictions are grouped sums and joins on the node keys, level by level. The frozen tree gives
every byte a probability; their logarithms add up to the text's score, and to its code length per byte.

The text that is coded is the token sequence: words after lower-casing A-Z, one space between them, and a newline
(never part of a word) as the end, so its probability covers what the unigram base score covers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.llm.common import HashIndex, as_bytes, chunks, crc_bucket, doc_texts
from tenantlake.session import stage

DEPTH = 5
#: Rows of a table that one broadcast holds; a larger table is scored slice by slice and the slices' sums added.
WORD_ROWS = 4 << 20
GRAM_ROWS = 4 << 20
#: Distinct entries that a counting task holds before it passes them on.
HELD_WORDS = 200_000
HELD_GRAMS = 3 << 19
END = b"\n"


def _token_lists(texts: list[bytes]) -> list[list[bytes]]:
    return [t.lower().split() for t in texts]


def _grams(words: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each coded byte with the ``depth`` bytes before it as one integer, and the number of coded bytes per text."""
    pad = END * depth
    joined = [pad + b" ".join(w) + END for w in words]
    sizes = np.fromiter(map(len, joined), np.int64, len(joined)) - depth
    data = np.frombuffer(b"".join(joined), np.uint8)
    key = np.zeros(len(data) - depth, np.uint64)
    for i in range(depth + 1):
        key <<= np.uint64(8)
        key |= data[i:len(data) - depth + i]
    coded = np.ones(len(key), bool)
    edge = np.cumsum(sizes[:-1] + depth)  # first byte of the next text's padding, as an offset into key
    for i in range(depth):
        coded[edge - depth + i] = False
    return key[coded], sizes


def _counts(docs: DataFrame, held_out: Column, depth: int) -> DataFrame:
    """(kind, key, n): training counts of words (kind 0) and of coded bytes with context (kind 1, all texts)."""
    def emit(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64))],
            names=["kind", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        grams: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, where = np.unique(np.concatenate([g for g, _ in grams]), return_inverse=True)
            return keys, np.bincount(where, np.concatenate([n for _, n in grams]), len(keys))

        def flush() -> Iterator[pa.RecordBatch]:
            if words:
                key = np.fromiter(map(xxhash.xxh64_intdigest, words.keys()), np.uint64, len(words))
                yield emit(0, key, np.fromiter(words.values(), np.int64, len(words)))
                words.clear()

        for batch in batches:
            texts, train = as_bytes(batch.column(0)), [not x for x in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                tokens = _token_lists(texts[lo:hi])
                for w, t in zip(tokens, train[lo:hi]):
                    if t:
                        words.update(w)
                        words[b""] += 1  # the end
                if len(words) > HELD_WORDS:
                    yield from flush()
                for t in (True, False):
                    some = [w for w, x in zip(tokens, train[lo:hi]) if x == t]
                    if some:
                        key, n = np.unique(_grams(some, depth)[0], return_counts=True)
                        grams.append((key, n if t else np.zeros(len(n), np.int64)))
                        held += len(key)
                if held > HELD_GRAMS:
                    grams[:] = [merged()]
                    if len(grams[0][0]) > HELD_GRAMS // 2:
                        yield emit(1, *grams.pop())
                    held = sum(len(g) for g, _ in grams)
        yield from flush()
        if grams:
            yield emit(1, *merged())

    rows = docs.select("text", held_out.alias("held_out")).mapInArrow(run, "kind int, key long, n long")
    return rows.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _log_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight, for x > 0."""
    y = x + 8.0
    product = x
    for i in range(1, 8):
        product = product * (x + float(i))
    return ((y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12.0 * y) - 1 / (360.0 * y * y * y)
            + 1 / (1260.0 * y * y * y * y * y) - F.log(product))


def _log_kt(zeros: Column, ones: Column) -> Column:
    """Logarithm of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return F.when((zeros + ones) == 0, 0.0).otherwise(
        _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - math.log(math.pi))


def _decisions(grams: DataFrame, *more: str) -> DataFrame:
    """(node, bit): the eight decisions of each gram's last byte; node = context, then decisions after a leading 1."""
    at = F.explode(F.array(*map(F.lit, range(8)))).alias("at")
    byte = F.col("key").bitwiseAND(255)
    return grams.select("key", *more, at).select(
        "key", *more,
        F.shiftleft(F.shiftright("key", 8), 8).bitwiseOR(
            F.expr("shiftleft(1L, at) | shiftright(key & 255L, 8 - at)")).alias("node"),
        F.expr("cast(shiftright(key & 255L, 7 - at) & 1L as int)").alias("bit"))


def _parent(depth: int) -> Column:
    """The node with the oldest byte of its ``depth``-byte context left out."""
    return F.col("node").bitwiseAND((1 << (8 * depth)) - 1)


def gram_log_probabilities(grams: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, log10p): the tree's probability of each byte after its context, from training counts (key, n)."""
    leaf = _decisions(grams, "n").groupBy("node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"))
    leaf = leaf.withColumn("log_pe", _log_kt(F.col("zeros"), F.col("ones")))
    levels = [stage(leaf.select("node", "zeros", "ones", F.col("log_pe").alias("log_pw"), F.lit(1.0).alias("stop")), "tree")]
    for d in range(depth, 0, -1):
        up = levels[0].groupBy(_parent(d).alias("node")).agg(
            F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("log_pw").alias("below"))
        up = up.withColumn("log_pe", _log_kt(F.col("zeros"), F.col("ones")))
        top = F.greatest("log_pe", "below")
        up = up.withColumn("log_pw", top + F.log(F.exp(F.col("log_pe") - top) + F.exp(F.col("below") - top)) + math.log(0.5))
        levels.insert(0, stage(up.select("node", "zeros", "ones", "log_pw",
                                         F.exp(math.log(0.5) + F.col("log_pe") - F.col("log_pw")).alias("stop")), "tree"))
    kt = (F.col("ones") + 0.5) / (F.col("zeros") + F.col("ones") + 1.0)
    above = levels[0].select("node", (F.col("stop") * kt).alias("p"), (1 - F.col("stop")).alias("rest"))
    for d in range(1, depth + 1):
        here = levels[d].select(F.col("node").alias("own"), _parent(d).alias("node"), F.col("stop"), kt.alias("kt"))
        above = here.join(above, "node").select(
            F.col("own").alias("node"), (F.col("p") + F.col("rest") * F.col("stop") * F.col("kt")).alias("p"),
            (F.col("rest") * (1 - F.col("stop"))).alias("rest"))
    p = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return _decisions(grams).join(above.select("node", "p"), "node").groupBy("key").agg(
        F.sum(F.log10(F.greatest(p, F.lit(1e-300)))).alias("log10p"))


def _slices(df: DataFrame, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The table's two columns in parts of about ``rows`` rows, each sorted by its unsigned key."""
    n = max(1, math.ceil(df.count() / rows))
    for i in range(n):
        part = df.where(F.pmod(F.xxhash64("key"), F.lit(n)) == i).toArrow()
        key, value = part.column(0).to_numpy().view(np.uint64), part.column(1).to_numpy()
        del part
        order = np.argsort(key)
        key, value = key[order], value[order]
        del order
        yield key, value


def _partial(docs: DataFrame, words, grams, depth: int) -> DataFrame:
    """Sums over one slice of each table per row."""
    index: dict[str, HashIndex] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_keys, word_logs = words.value
        gram_keys, gram_logs = grams.value
        table = index.setdefault("grams", HashIndex(gram_keys))
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for lo, hi in chunks(texts):
                tokens = _token_lists(texts[lo:hi])
                sizes = np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1
                flat = [w for t in tokens for w in (*t, b"")]
                distinct = list(set(flat))
                hashes = np.fromiter(map(xxhash.xxh64_intdigest, distinct), np.uint64, len(distinct))
                known = np.zeros(len(hashes), bool)
                logs = np.zeros(len(hashes))
                if len(word_keys):
                    at = np.minimum(np.searchsorted(word_keys, hashes), len(word_keys) - 1)
                    known = word_keys[at] == hashes
                    logs[known] = word_logs[at[known]]
                number = dict(zip(distinct, range(len(distinct))))
                ids = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
                starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
                keys, coded = _grams(tokens, depth)
                at = table.find(keys)
                probs = np.where(at >= 0, gram_logs[at], 0.0) if len(gram_logs) else np.zeros(len(keys))
                edges = np.concatenate(([0], np.cumsum(coded)[:-1]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes), pa.array(coded),
                     pa.array(np.add.reduceat(known[ids].astype(np.int64), starts)),
                     pa.array(np.add.reduceat(logs[ids], starts)), pa.array(np.add.reduceat(probs, edges))],
                    names=["row", "n_tokens", "n_coded", "known", "logs", "score"])

    return docs.select("row", "text").mapInArrow(
        run, "row long, n_tokens long, n_coded long, known long, logs double, score double")


def score_documents(docs: DataFrame, modulus: int = 10, depth: int = DEPTH, word_rows: int = WORD_ROWS,
                    gram_rows: int = GRAM_ROWS) -> DataFrame:
    """Scores of every row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    The model learns from rows whose crc32(doc_id) isn't divisible by ``modulus``. A null text is empty: one token,
    the end. Repeated rows count as often as they occur. Without training rows the tree predicts every decision
    with one half. Words are counted by their 64-bit hash. Neither table has to fit: it is broadcast in slices of a
    fixed number of rows, and a row's sums over the slices are added.
    """
    spark: SparkSession = docs.sparkSession
    # numbered once: an input behind a shuffle may deal its rows out differently each time it is computed
    docs = stage(doc_texts(docs).withColumn("row", F.monotonically_increasing_id()), "texts")
    held_out = crc_bucket(F.col("doc_id"), modulus) == 0
    counts = stage(_counts(docs, held_out, depth), "counts")
    word_counts = counts.where("kind = 0")
    total = word_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = counts.where("kind = 1").select("key", "n")
    model = stage(gram_log_probabilities(grams, depth), "model")
    word_parts = _slices(word_counts.select("key", F.log10(F.col("n") + 0.1).alias("logs")), word_rows)
    gram_parts = _slices(model, gram_rows)
    none = (np.zeros(0, np.uint64), np.zeros(0))
    parts = []
    while True:
        w, g = next(word_parts, None), next(gram_parts, None)
        if w is None and g is None:
            break
        parts.append(_partial(docs, spark.sparkContext.broadcast(w or none), spark.sparkContext.broadcast(g or none), depth))
    sums = parts[0]
    for p in parts[1:]:
        sums = sums.union(p)
    sums = sums.groupBy("row").agg(F.max("n_tokens").alias("n_tokens"), F.max("n_coded").alias("n_coded"),
                                   F.sum("known").alias("n_known"), F.sum("logs").alias("logs"), F.sum("score").alias("score"))
    below = math.log10(total[0] + 0.1 * (total[1] + 1))
    base = F.col("logs") + (F.col("n_tokens") - F.col("n_known")) * math.log10(0.1) - F.col("n_tokens") * below
    return docs.select("row", "doc_id", held_out.alias("held_out")).join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total[0]).cast("long").alias("train_tokens"),
        base.alias("base_score"), "score",
        (-F.col("score") * math.log2(10) / F.col("n_coded")).alias("bits_per_byte"))
