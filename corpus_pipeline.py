"""A training-data pipeline over documents: every stage works on all that the one before kept.

Quality and language filters drop documents, near copies keep one document of a group, personal
data is replaced in the texts, and what is left is packed into windows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freshet.durable import scratch
from freshet.llm import language, ngram_join, packing, personal_data, quality
from freshet.llm.common import remainder, table, unused

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A document whose best language holds less than this share is undecided between all languages.
LEAST_LANGUAGE_SHARE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, learnt as in its own query."""
    labels = table(spark, sf_dir, "labels").where(remainder("doc_id", 5) != 0)
    machine = quality.fit(docs, labels, metadata=("n_chars",))
    return docs.where(quality.quality_score(machine, F.col("text")) >= quality.THRESHOLD)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without a letter and undecided ones go."""
    parser = language.fit(docs.where(remainder("doc_id", 4) != 2))
    name = unused(docs, "_found")
    found = docs.withColumn(name, language.language(parser, F.col("text")))
    return found.where((F.col(name)["lang"] != "und") & (F.col(name)["score"] >= LEAST_LANGUAGE_SHARE)).drop(name)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of the smallest id."""
    return ngram_join.representatives(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text."""
    found = personal_data.redacted(docs, personal_data.fit(docs))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 tokens."""
    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality_stage),
    ("language identification", language_stage),
    ("n-gram Jaccard join", near_copy_stage),
    ("personal data", personal_data_stage),
    ("packing", packing_stage),
]

# Learnt models, automata and dynamic programming are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = scratch(spark, "stage")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
