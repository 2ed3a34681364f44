"""A corpus pipeline from the training-data operators: filter, filter, deduplicate, pack."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrack.functions.shared import written
from loomtrack.llm import packing, quality, simhash, toxicity


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    train = F.coalesce(quality.fold("doc_id", 3) != 1, F.lit(True))
    return quality.keep_quality(docs, quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier rejects."""
    train = F.coalesce(quality.fold("doc_id", 5) != 0, F.lit(True))
    return toxicity.keep_clean(docs, toxicity.fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), train))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id."""
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences."""
    return packing.pack(docs)


STAGES = [("quality_filter", quality_filter), ("toxicity_filter", toxicity_filter), ("near_dedup", near_dedup), ("pack", pack)]
#: No stage has an SQL twin (models, fingerprints and tokens); the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
