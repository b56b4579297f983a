"""The corpus pipeline: documents are rated, identified, de-duplicated, decontaminated and packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written to the shared folder and read
again as the next stage's documents. The first four return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenantlake.llm import decontaminate, language, packing, quality, simhash
from tenantlake.llm.common import ship, table
from tenantlake.session import stage

#: A document whose language profile is farther than this from every learned language is rejected.
LEAST_LANGUAGE_SCORE = 0.2


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the best grade is at least one half, by a model of the labelled ones."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality.rated(F.col("text"), model)["p_tail"] >= quality.KEEP_AT)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; letterless texts and unlike any go."""
    ship(spark)
    model = language.fit(docs.where(~language.held_out(F.col("doc_id"))))
    return docs.where(language.predicted(F.col("text"), model)["score"] >= LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near duplicates."""
    ship(spark)
    return simhash.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces with their places in sequences."""
    ship(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Hashed models, tokenizers and packing can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to the documents of a folder of tables."""
    docs = table(spark, sf_dir, "documents")
    for name, fn in STAGES:
        docs = stage(fn(spark, docs, sf_dir), name)
    return docs
