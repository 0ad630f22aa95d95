"""From raw documents to packed sequences: language, near-duplicates, repeated passages, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of the documents. Edge cases are those of the operators: null
texts are empty and have no language, so they go first; null ids, sources and languages, repeated rows, empty tables
and extra columns pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyquill.llm.language import spoken
from skyquill.llm.mixing import mixed
from skyquill.llm.near_text import one_of_each
from skyquill.llm.packing import pack_documents
from skyquill.llm.storage import stored
from skyquill.llm.suffixes import without_repeats


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; texts in none go."""
    return spoken(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return one_of_each(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand in earlier ones."""
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' targets want them."""
    return mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences."""
    return pack_documents(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("mix", mix), ("pack", pack)]

#: Trained likelihoods, sketches and tokenizers have no SQL form; tests compare the stages with plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
