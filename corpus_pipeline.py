"""From raw documents to tokens in five stages, each an operator of ``turnloom.llm``.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read
again before the next, and deleted after the next has read it.  All but the last return the columns
of ``docs``.

Null text counts as empty: it fails the quality rules, and where a stage is used alone an empty text
is equal to other empty texts, near to none, mixed with no words (never taken) and encoded to no ids.
A null doc_id is an id like others but never the one that stays beside a row with an id; a null
source is the last source.  Of rows that repeat an id and a text one stays; of equal texts the
largest id stays, of near ones the smallest.  A text of any length is read whole.  Empty tables give
empty tables.  Columns of any other name are carried along and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.bpe import bpe_stage
from turnloom.llm.exact import exact_dedup_stage
from turnloom.llm.mix import mix_stage
from turnloom.llm.near import near_dedup_stage
from turnloom.llm.quality import quality_stage
from turnloom.llm.store import materialize, release


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup_stage(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return near_dedup_stage(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mix_stage(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document taken."""
    return bpe_stage(docs)


STAGES = [("quality rules", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("byte-level BPE", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The quality stage decodes a trained CRF, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None
