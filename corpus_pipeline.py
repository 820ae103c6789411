"""From raw documents to packed training sequences: each stage works on all that its predecessor kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next stage. All but the last return the columns of documents.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from firmground.llm import decontam, exact_dedup, near_dedup, packing, toxicity
from firmground.llm.store import Workspace


def ordinary_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose spelling models call them toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.kept(docs, labels)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space, the longest with the smallest id stays."""
    return exact_dedup.kept(docs)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the smallest id stays."""
    return near_dedup.kept(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of full sequences, with their token ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", ordinary_documents),
    ("exact dedup", distinct_texts),
    ("near dedup", distinct_documents),
    ("benchmark decontamination", unseen_documents),
    ("packing", packed_sequences),
]

#: Scores, near-duplicate links and packing cannot be stated in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    work = Workspace(spark, "pipeline")
    for i, (_, stage) in enumerate(STAGES):
        docs = work.keep(stage(spark, docs, sf_dir), str(i))
    return docs
