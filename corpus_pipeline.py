"""The corpus pipeline: five stages over ``documents``, each one operator.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs,
sf_dir)`` and returns the documents it keeps (the last one also where they
go). ``run`` applies all of them, each on the written result of the one
before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casefeat.llm.common import settle
from casefeat.llm.decontaminate import clean
from casefeat.llm.mixing import mixed_rows
from casefeat.llm.quality import fit, score_of
from casefeat.llm.sharding import shard_rows
from casefeat.llm.ship import with_package
from casefeat.llm.simhash import keep_first

SCORE_LIMIT = 0.3
SHARDS = 8


@with_package
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the limit go. The model learns from the
    labelled rows among ``docs``, held-out ones excepted."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return docs.where(score_of(fit(docs, labels))("text") >= SCORE_LIMIT)


@with_package
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return keep_first(docs)


@with_package
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@with_package
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources take them."""
    return mixed_rows(docs)


@with_package
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with their shard and their slot in it."""
    return shard_rows(docs, SHARDS)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

# SQL can express neither the trained classifier nor the fingerprints, so the
# stages are held against brute force in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage keeps is written
    before the next one starts, and deleted once that one is written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs, path = settle(stage(spark, docs, sf_dir), f"stage-{name}", drop=path)
    return STAGES[-1][1](spark, docs, sf_dir)
