"""The corpus pipeline: toxicity, language, near duplicates, mixing, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir), where docs is what
the stage before kept, written as Parquet and read again, and returns a DataFrame with the
columns of documents (the last one: the packed pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import language_id, minhash_dedup, mixing, packing, toxicity
from graphloom.llm.common import table, written
from graphloom.llm.queries import tokenizer_path


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.5 or more."""
    return toxicity.clean(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in no learned language: without letters, or unlike all prototypes."""
    return language_id.recognised(docs, language_id.trained(docs))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: five words, similarity 0.8."""
    return minhash_dedup.deduplicated(docs, width=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes every document as often as the mix does: 0 to 3 times."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens."""
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("language", language_stage), ("near_duplicates", dedup_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: No SQL: learned models, a tokenizer and drawn copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
