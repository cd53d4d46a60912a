"""From raw documents to packed training sequences, in five stages.

Every stage takes the documents that its predecessor kept and is written out before the
next one reads them, so a lost executor or a stopped run costs one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickscope.llm import line_dedup, near_dup, packing, pii, quality
from tickscope.llm.common import documents, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.good_documents(docs)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that ten documents and more share."""
    return line_dedup.documents_without_repeats(docs)


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8)."""
    return near_dup.one_of_each(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return pii.masked(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("near_dedup", near_deduplication),
    ("pii", personal_data),
    ("packing", sequence_packing),
]

# Tokenizing and the packing's linear program are beyond SQL. tests/llm/test_pipeline.py holds every
# stage and the whole run against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
