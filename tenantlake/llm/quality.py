"""Quality by ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed text features gives a document's score; ordered thresholds cut the score into
grades: P(grade <= k) = logistic(threshold k - score). The model gives the expected grade and the probability of
the selected grade or a better one. With two grades this is logistic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenantlake.llm.common import as_text
from tenantlake.llm.hashed_text import DIMENSIONS, SAMPLE, features, labelled_sample, row_sums, telling

STEPS = 150
RATE = 0.1
PENALTY = 1e-5
#: A document is kept if its probability of the best grade is at least this.
KEEP_AT = 0.5


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """Weights, ascending thresholds (one fewer than grades) and the grades in order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def score(self, text: str) -> float:
        number, value = features(text, True)
        return float((self.weights[number] * value).sum())

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every grade but the lowest, a column each."""
        return _logistic(scores[:, None] - self.thresholds[None, :])

    def expected(self, scores: np.ndarray) -> np.ndarray:
        return self.grades[0] + (self.tails(scores) * np.diff(self.grades)[None, :]).sum(1)


def fit_ordinal(start: np.ndarray, number: np.ndarray, value: np.ndarray, y: np.ndarray, steps: int = STEPS,
                rate: float = RATE, penalty: float = PENALTY) -> OrdinalModel:
    """Maximum likelihood by full-batch adaptive gradient steps; the same rows in the same order give the same model."""
    grades, rank = np.unique(y, return_inverse=True)
    k = len(grades) - 1
    weights = np.zeros(DIMENSIONS)
    if k < 1:  # one grade, or no rows: nothing to tell apart
        return OrdinalModel(weights, np.zeros(0), grades if len(grades) else np.zeros(1, np.int64))
    below = np.array([(rank < j).mean() for j in range(1, k + 1)])
    thresholds = np.log(below / (1 - below))
    rows = np.repeat(np.arange(len(y)), np.diff(start))
    value = value * telling(number, value, rows, rank)[number]
    squares, moved = np.full(DIMENSIONS, 1e-8), np.full(k, 1e-8)
    for _ in range(steps):
        at_most = np.concatenate((thresholds, [40.0]))
        at_least = np.concatenate(([-40.0], thresholds))
        score = row_sums(start, weights[number] * value)
        hi, lo = _logistic(at_most[rank] - score), _logistic(at_least[rank] - score)
        hi, lo = np.where(rank == k, 1.0, hi), np.where(rank == 0, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = (d_hi - d_lo) / len(y)  # of the mean negative log-likelihood
        gradient = np.bincount(number, value * d_score[rows], DIMENSIONS) + penalty * weights
        squares += gradient * gradient
        weights -= rate * gradient / np.sqrt(squares) * 2
        d_threshold = np.array([(d_lo[rank == j + 1].sum() - d_hi[rank == j].sum()) / len(y) for j in range(k)])
        moved += d_threshold * d_threshold
        thresholds = np.maximum.accumulate(thresholds - rate * d_threshold / np.sqrt(moved))
    return OrdinalModel(weights, thresholds, grades)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", rows: int = SAMPLE) -> OrdinalModel:
    """The model of a bounded sample of rated documents."""
    start, number, value, y, _ = labelled_sample(docs, labels, (grade,), rows, True)
    return fit_ordinal(start, number, value, y[:, 0])


def rated(text: Column, model: OrdinalModel, at_least: int | None = None) -> Column:
    """struct(expected_grade, p_tail) of a text column: p_tail is the probability of grade ``at_least`` or better."""
    wanted = model.grades[-1] if at_least is None else at_least
    column = int(np.searchsorted(model.grades, wanted)) - 1

    @F.arrow_udf("expected_grade double, p_tail double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            scores = np.array([model.score(t) for t in as_text(batch)], np.float64)
            tails = np.ones(len(scores)) if column < 0 else model.tails(scores)[:, min(column, len(model.thresholds) - 1)]
            yield pa.StructArray.from_arrays([pa.array(model.expected(scores)), pa.array(tails)],
                                             names=["expected_grade", "p_tail"])

    return run(text.cast("string"))


def rate_documents(docs: DataFrame, labels: DataFrame, grade: str = "quality", rows: int = SAMPLE,
                   keep_at: float = KEEP_AT) -> DataFrame:
    """doc_id, expected_grade, p_tail (of the best grade), keep of every row.

    Null and empty texts have no features and get what the thresholds alone say. Labels with nulls aren't used;
    without rated documents, or with one grade only, everything is kept with a tail probability of 1.
    """
    model = fit(docs, labels, grade, rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), rated(F.col("text"), model).alias("r")).select(
        "doc_id", "r.expected_grade", "r.p_tail", (F.col("r.p_tail") >= keep_at).alias("keep"))
