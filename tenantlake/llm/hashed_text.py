"""Hashed text features for linear models, and the bounded sample of labelled rows they are fitted on.

A text's features are the words and the shapes of its white-space tokens (upper and lower case, digits, each other
character as it is), how often a token repeats the one before it, and how few distinct tokens it has. A feature's
number is a hash. Words count as present or not, shapes and repeats by their share of the tokens.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import as_text

DIMENSIONS = 1 << 18
#: Labelled rows that a model is fitted on, at most: those with the smallest hashes of their ids.
SAMPLE = 8_000
#: A feature is used if it occurs in this many rows of the sample and is so many deviations from chance.
LEAST_ROWS = 4
DEVIATIONS = 4.0
REMEMBERED = 100_000
_CORE = re.compile(r"\w+", re.UNICODE)
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
_LOWER = re.compile(r"[^\W\d_A-ZÀ-ÖØ-Þ]+")
_DIGITS = re.compile(r"\d+")
_SAME = re.compile(r"(.)\1+")

_numbers: dict[str, tuple[int, int]] = {}


def feature(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) & (DIMENSIONS - 1)


def _token(token: str) -> tuple[int, int]:
    got = _numbers.get(token)
    if got is None:
        core = "".join(_CORE.findall(token.lower()))
        shape = _SAME.sub(r"\1", _DIGITS.sub("0", _LOWER.sub("a", _UPPER.sub("A", token))))
        got = feature("word " + core), feature("shape " + shape[:8])
        if len(_numbers) >= REMEMBERED:
            _numbers.clear()
        _numbers[token] = got
    return got


def features(text: str, fading: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers and their values; none for a text without tokens.

    A word counts as one, or, if ``fading``, as less the more different words the text has.
    """
    tokens = text.split()
    if not tokens:
        return np.zeros(0, np.int64), np.zeros(0)
    bag = Counter(tokens)
    pairs = np.array([_token(t) for t in bag], np.int64)
    counts = np.fromiter(bag.values(), np.float64, len(bag))
    n = len(tokens)
    words = np.unique(pairs[:, 0])
    shapes, where = np.unique(pairs[:, 1], return_inverse=True)
    share = np.bincount(where, counts) / n
    repeats = sum(map(eq, tokens, tokens[1:])) / n
    number = np.concatenate((words, shapes, [feature("repeats"), feature("few distinct")]))
    word = 2 / np.sqrt(8 + len(words)) if fading else 1.0
    value = np.concatenate((np.full(len(words), word), 2 * np.sqrt(share), [2 * np.sqrt(repeats), np.sqrt(max(0.0, 1 - len(bag) / n))]))
    return number, value


def labelled_sample(docs: DataFrame, labels: DataFrame, columns: tuple[str, ...], rows: int, fading: bool) -> tuple:
    """Features (start, number, value) and labels of at most ``rows`` labelled documents, in the order of doc_id.

    Label rows with a null id or a null in any of ``columns`` don't count; several rows of one id count as their
    greatest values. Of several documents of one id the one with the least text counts, so there are never more.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in columns]).dropna()
    known = known.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in columns])
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(known), "doc_id")  # at most ``rows`` short rows
    joined = joined.groupBy("doc_id", *columns).agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [features(t, fading) for t in as_text(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([n.tolist() for n, _ in got], pa.list_(pa.int32())),
                 pa.array([v.tolist() for _, v in got], pa.list_(pa.float32())), *batch.columns[2:]],
                names=["doc_id", "number", "value", *columns])

    schema = "doc_id long, number array<int>, value array<float>, " + ", ".join(f"{c} int" for c in columns)
    table = joined.select("doc_id", "text", *columns).mapInArrow(run, schema).toArrow().sort_by("doc_id").combine_chunks()
    if not table.num_rows:
        return np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, len(columns)), np.int64), np.zeros(0, np.int64)
    number, value = table.column("number").combine_chunks(), table.column("value").combine_chunks()
    sizes = number.value_lengths().to_numpy(zero_copy_only=False)
    start = np.concatenate(([0], np.cumsum(sizes)))
    y = np.stack([table.column(c).to_numpy() for c in columns], 1).astype(np.int64)
    return (start, number.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64), y,
            table.column("doc_id").to_numpy())


def row_sums(start: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over each row's range, 0 for an empty row."""
    total = np.concatenate(([0.0], np.cumsum(values)))
    return total[start[1:]] - total[start[:-1]]


def telling(number: np.ndarray, value: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Mask over all features: those whose correlation with ``y`` over the rows isn't by chance.

    Most words of a sample occur in a few rows only and would be learned by heart.
    """
    spread = y - y.mean() if len(y) else np.zeros(0)
    together = np.bincount(number, value * spread[rows], DIMENSIONS)
    alone = np.bincount(number, value * value, DIMENSIONS) * (spread.var() if len(y) else 0.0)
    common = np.bincount(number, value > 0, DIMENSIONS) >= LEAST_ROWS
    return common & (np.abs(together) >= DEVIATIONS * np.sqrt(alone)) & (alone > 0)
