"""The corpus pipeline: rules, near-dedup, passage dedup, mixing and packing, one after the other.

Every stage works on all that its predecessor kept, and its result is written before the next begins;
what a stage wrote for itself, and its input, is deleted as soon as its result stands.

Defined results: a null text counts as empty, fails the quality rules and goes; very long texts are
judged, compared, cut, weighed and packed whole; rows of one id are one document to the near-dedup, which
keeps or drops them together; ties go to the least id, or to the row that stands first; repeated rows are
copies to the mix and are packed as such; an empty table gives an empty result; extra columns pass
through all stages but the last, which drops them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import mixing, near_dedup, packing, quality, suffix_dedup
from citeloom.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and the documents that fail the base rules or lose too much text."""
    return quality.kept_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five words a shingle, links from a similarity of 0.8 on."""
    return near_dedup.kept_documents(docs, n=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay where they stand first."""
    return suffix_dedup.cut_documents(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of each copy of a document: its token ids and their place in a sequence."""
    return packing.sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: Sketches, minimisers, rounding and tokenising are beyond SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
