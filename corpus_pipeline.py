"""The training-data pipeline: from raw documents to token ids in a binary format.

Stages, in order: quality rules, near-duplicates (one document of each class stays),
benchmark decontamination, mixing sources to target weights (documents may repeat), token
ids. Each stage gets what the one before it kept, written as Parquet and read again, so a
lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotweave.llm import bagminhash, decontaminate, mixing, quality, rans
from slotweave.llm.common import drop, scope, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bagminhash.dedup(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return rans.decode(*rans.encode(docs))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_ids", token_ids),
]

#: SQL has no minimum-covariance determinant, no signatures and no tokenizer; tests hold
#: every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = docs
        with scope(spark) as kept:  # what the stage stored on its way goes when its result is written
            docs = stored(stage(spark, before, sf_dir), name)
            kept.append(docs)
        drop(before)
    return docs
