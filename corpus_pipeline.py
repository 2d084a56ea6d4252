"""Training-corpus pipeline over ``documents``: each stage works on all rows that its predecessor kept.

Toxic documents go, then exact copies, near copies and documents that contain benchmark items; the last stage weighs
what is left to the target mix. Each stage takes (spark, docs, sf_dir); ``run`` writes each stage's rows as
Parquet in the shared folder and reads them back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import decontaminate, exact_dedup, queries, simhash, toxicity
from tidemark.llm.common import written

#: Contract of the near-duplicate stage: words per shingle and largest bit distance.
SHINGLE_WORDS, MAX_BITS = 4, 4


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return toxicity.drop_toxic(docs, queries.toxic_labels(spark, sf_dir))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs, SHINGLE_WORDS, MAX_BITS)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return decontaminate.drop_leaks(docs, queries.table(spark, sf_dir, "benchmark"))


def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document that is left, with its rate towards the target mix."""
    return queries.mixed(spark, docs, sf_dir)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", weighed),
]

#: SQL can't express the toxicity model, the SimHash or the mixing stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs)
    return docs
