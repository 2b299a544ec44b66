"""The corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Defined results: all stages but the last return the columns of their documents, whatever others those have; null, empty and
very long texts, null and repeated ids and repeated rows pass as each operator's module says (a null or empty text is rejected
by the quality rules, so later stages see it only in input of their own); an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tsq.llm.common import read_documents, stage_table
from tsq.llm.decontam import drop_leaks
from tsq.llm.mixing import mix_sources
from tsq.llm.neardup import keep_one
from tsq.llm.pii import mask_text
from tsq.llm.quality import filter_quality


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that a rule rejects go."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: one document of each class of near duplicates stays."""
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: documents that leak a benchmark item go."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: personal data is replaced by its kind in brackets."""
    return mask_text(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: how many words the mix takes from each document, repeats counted."""
    return mix_sources(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("decontamination", decontaminate),
    ("personal data", mask_pii),
    ("mixing", mix),
]

#: SQL can express neither the signatures' classes nor the classifier; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is written to the shared folder and read again."""
    docs = read_documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
