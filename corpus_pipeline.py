"""Corpus pipeline: toxicity, near-dedup, PII, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Every stage is written as Parquet to
the shared folder and read back as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gradus.llm.common import materialise, table
from gradus.llm.minhash import keep_one
from gradus.llm.mixing import mix
from gradus.llm.packing import sequences
from gradus.llm.pii import redact_documents
from gradus.llm.toxicity import keep_clean


def stage_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one(docs)


def stage_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    return redact_documents(docs)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are emitted as often as their source's target asks."""
    return mix(docs)


def stage_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are packed into sequences."""
    return sequences(docs)


STAGES = [("toxicity", stage_toxicity), ("near_duplicates", stage_near_duplicates), ("pii", stage_pii), ("mixing", stage_mixing), ("packing", stage_packing)]

#: No stage before the mixing can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
