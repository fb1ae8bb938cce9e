"""From documents to packed training sequences, a written table after each stage.

    run(spark, "/data/corpus")      # reads <folder>/documents.parquet and labels.parquet

Stages work on all rows that the one before kept, and all but the last return the columns of
documents. Tables between stages go to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grapevine.llm import near_dedup, quality_classifier, quality_rules
from grapevine.llm.queries import packed_pieces, quality_model, text_workspace

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return quality_classifier.accepted(docs, quality_model(docs, sf_dir))


def rule(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no fixed rule and are no outliers of their language and source."""
    return quality_rules.drop_rejected(docs, text_workspace(spark))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.drop_duplicates(docs, text_workspace(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences."""
    return packed_pieces(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", classify),
    ("quality_rules", rule),
    ("near_duplicates", deduplicate),
    ("packing", pack),
]

ORACLE_SQL = None  # the classifier is trained and the outliers are estimated step by step


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = text_workspace(spark)
    for name, stage in STAGES:
        docs = tables.keep(stage(spark, docs, sf_dir), name)
    return docs
