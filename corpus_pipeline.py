"""A training-corpus pipeline: five operators of ``bankspark.llm`` over the ``documents`` table.

Every stage is a function (spark, docs, sf_dir) -> DataFrame. ``run`` writes each stage's result as
Parquet into the shared folder and reads it back as the next one's documents, so a lost executor
never costs more than the stage at work.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bankspark.llm import decontaminate, jaccard_join, mixing, quality, sharding
from bankspark.llm.shared import stage, table

#: Documents under this score of being good are rejected.
QUALITY_LIMIT = 0.3
SHARD_BYTES = 2 << 20


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose learned quality score is under the limit (labels of the label table)."""
    p = quality.Params()
    labels = table(spark, sf_dir, "labels")
    model = quality.train(quality.labelled_sample(docs, labels, "quality", F.lit(True), p), p)
    name = "score"
    while name in {c.lower() for c in docs.columns}:  # a column of its own named score stays what it is
        name = "_" + name
    scored = quality.score(docs, model, p, keep=tuple(docs.columns), name=name)
    return scored.where(F.col(name) >= QUALITY_LIMIT).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each component of near copies."""
    return jaccard_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their target weights."""
    return mixing.apply_mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every document to a shard under the byte limit."""
    return sharding.shard(docs, SHARD_BYTES)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mix_sources),
    ("sharding", shards),
]

#: A learned classifier is not one SQL statement; tests/llm/test_pipeline.py holds every stage against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
