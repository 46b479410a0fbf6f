"""A training-corpus pipeline: each stage takes all that the one before it kept, and writes what it keeps itself.

STAGES lists (name, function of (spark, docs, sf_dir)); run() applies them to the documents table with a written
table in the shared folder between stages. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import materialize
from graphloom.llm.exact_dedup import keep_exact
from graphloom.llm.minhash import keep_near
from graphloom.llm.mixing import mixed_documents
from graphloom.llm.packing import pack
from graphloom.llm.quality import clean_documents
from graphloom.llm.tokens import vocabulary_path

#: The near-duplicate stage's own threshold; op4's query has its contract's 85. 30 bands of 5 miss a pair at 0.8 with probability 7e-6.
NEAR_PERCENT = 80


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failing lines."""
    return clean_documents(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked at a similarity of 0.8 or more."""
    return keep_near(docs, percent=NEAR_PERCENT)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    return pack(docs, vocabulary_path())


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources), ("pack_sequences", pack_sequences)]

ORACLE_SQL = None  # signatures, tokens and packing have no SQL form; the stages are tested one by one


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
