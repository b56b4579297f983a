"""Toxicity categories by a classifier chain.

Categories are predicted one after the other by linear models over hashed text features; each later model also
sees the probabilities of the earlier categories. For training, those come from out-of-fold predictions, so a later
model learns from probabilities as uncertain as it will meet.
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

FOLDS = 4
STEPS = 200
RATE = 0.3
PENALTY = 1e-5
TOXIC_AT = 0.5


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Link:
    weights: np.ndarray
    earlier: np.ndarray
    bias: float


def _fit_link(start, number, value, earlier: np.ndarray, y: np.ndarray) -> Link:
    """Logistic regression by full-batch adaptive gradient steps."""
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3) if len(y) else 0.0
    weights, chain, bias = np.zeros(DIMENSIONS), np.zeros(earlier.shape[1]), float(np.log(rate / (1 - rate))) if len(y) else -40.0
    if not len(y) or y.min() == y.max():
        return Link(weights, chain, bias)
    rows = np.repeat(np.arange(len(y)), np.diff(start))
    value = value * telling(number, value, rows, y)[number]
    squares, chain_squares, bias_square = np.full(DIMENSIONS, 1e-8), np.full(len(chain), 1e-8), 1e-8
    for _ in range(STEPS):
        gap = (_logistic(row_sums(start, weights[number] * value) + earlier @ chain + bias) - y) / len(y)
        g = np.bincount(number, value * gap[rows], DIMENSIONS) + PENALTY * weights
        squares += g * g
        weights -= RATE * g / np.sqrt(squares)
        g = earlier.T @ gap + PENALTY * chain
        chain_squares += g * g
        chain -= RATE * g / np.sqrt(chain_squares)
        g = gap.sum()
        bias_square += g * g
        bias -= RATE * g / np.sqrt(bias_square)
    return Link(weights, chain, float(bias))


def _rows(start, number, value, which: np.ndarray):
    """The features of some rows."""
    sizes = np.diff(start)
    mask = np.repeat(which, sizes)
    return np.concatenate(([0], np.cumsum(sizes[which]))), number[mask], value[mask]


def fit_chain(start, number, value, y: np.ndarray, doc_ids: np.ndarray, folds: int = FOLDS) -> list[Link]:
    """One link a column of ``y``, in order; a document's fold follows from its id."""
    fold = (doc_ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(folds)
    earlier = np.zeros((len(y), 0))
    links = []
    for c in range(y.shape[1]):
        links.append(_fit_link(start, number, value, earlier, y[:, c]))
        if c + 1 < y.shape[1]:
            unseen = np.zeros(len(y))
            for f in range(folds):
                out = fold == f
                link = _fit_link(*_rows(start, number, value, ~out), earlier[~out], y[~out, c])
                s, n, v = _rows(start, number, value, out)
                unseen[out] = _logistic(row_sums(s, link.weights[n] * v) + earlier[out] @ link.earlier + link.bias)
            earlier = np.column_stack((earlier, unseen))
    return links


def chained(text: Column, links: list[Link], categories: tuple[str, ...]) -> Column:
    """struct of a probability for each category."""
    @F.arrow_udf(", ".join(f"{c} double" for c in categories))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = as_text(batch)
            out = np.zeros((len(texts), len(links)))
            for i, t in enumerate(texts):
                number, value = features(t, False)
                for c, link in enumerate(links):
                    out[i, c] = _logistic((link.weights[number] * value).sum() + out[i, :c] @ link.earlier + link.bias)
            yield pa.StructArray.from_arrays([pa.array(out[:, c]) for c in range(len(links))], names=list(categories))

    return run(text.cast("string"))


def score_toxicity(docs: DataFrame, labels: DataFrame, categories: tuple[str, ...] = ("low_quality", "toxic"),
                   rows: int = SAMPLE) -> DataFrame:
    """doc_id, p_<category> of each category in the chain's order, and ``toxic`` (the last one, cut at one half).

    ``labels`` holds doc_id and a 0/1 column for each category. Null and empty texts get what the biases say.
    Without labelled documents nothing is toxic. Repeated rows are each scored.
    """
    start, number, value, y, doc_ids = labelled_sample(docs, labels, categories, rows, False)
    links = fit_chain(start, number, value, y, doc_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), chained(F.col("text"), links, categories).alias("p")).select(
        "doc_id", *[F.col(f"p.{c}").alias(f"p_{c}") for c in categories],
        (F.col(f"p.{categories[-1]}") >= TOXIC_AT).alias("toxic"))
