"""Corpus preparation as a chain of stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept.  Its result is written as Parquet and read again as the next stage's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fleetloom.llm import decontamination, jaccard_join, mixing, quality, sharding
from fleetloom.llm.queries import mix_levels, mix_weights, with_domain
from fleetloom.llm.shared import stored
from fleetloom.queries.registry import table

#: The classifier learns, so SQL cannot express the rows of :func:`run`.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among *docs*."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one(docs, size=5, num=80, den=100)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that one seeded pass takes for four fifths of the corpus's tokens.

    The derived domain gets a name that no column of *docs* has, so a column ``domain`` stays as it is.
    """
    name = "domain"
    while name in {column.lower() for column in docs.columns}:
        name = f"_{name}"
    mixed = mixing.keep_mixed(with_domain(docs, name), mix_levels(name), mix_weights(name), F.col("tokens") * 0.8)
    return mixed.select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.shard_documents(docs, sharding.layout(8), sharding.layout(9))


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
