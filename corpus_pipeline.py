"""The corpus pipeline: stages that each read what the one before kept, written and read again between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohesia.llm.decontaminate import removed
from cohesia.llm.lines import line_dedup
from cohesia.llm.mixing import mix
from cohesia.llm.simhash import near_dedup
from cohesia.llm.toxicity import reject_toxic
from cohesia.runtime import release, settled


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts."""
    return line_dedup(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of those that SimHash links, or a similarity of 0.8 between their sets of runs of five words."""
    return near_dedup(docs, similarity=0.8, similar_shingle=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows go from the texts."""
    return removed(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, with the number of the copy."""
    return mix(docs)


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_deduplication),
    ("simhash_near_dedup", near_deduplication),
    ("benchmark_decontamination", decontamination),
    ("mixing_sources", mixing),
]

#: SQL can't express the first stage, a trained classifier.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, from the whole table of documents. Each stage's table goes to the shared folder and is deleted when the next one is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, settled(spark, lambda: stage(spark, docs, sf_dir), name)  # noqa: B023
        release(before)
    return docs
