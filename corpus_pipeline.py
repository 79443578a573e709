"""The corpus pipeline: quality rules, near-duplicates, decontamination, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. ``run`` writes what a stage returns as Parquet in the shared folder and
reads it again as the next one's ``docs``, so a lost executor costs one stage.
All stages but the last return the columns of ``docs``; the last adds the
number of the repetition and its words.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lendscope.llm import decontamination, mixing, pii, quality_rules, simhash_dedup
from lendscope.llm.common import load_documents, scratch
from lendscope.sources.tables import load_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or are anomalies go. The forest is
    fitted on ``docs`` and the labels beside them."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, load_table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    return simhash_dedup.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.without_benchmark(docs, load_table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced in the texts."""
    return pii.redact(docs, pii.fit(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out, so that sources meet their targets."""
    return mixing.mix_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_good),
    ("simhash_near_dedup", one_of_each),
    ("benchmark_decontamination", without_benchmark),
    ("pii", redact),
    ("source_mixing", mix),
]

#: Forest, random field and fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the mixture of ``documents``."""
    docs = load_documents(spark, sf_dir)
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
