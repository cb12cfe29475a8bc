"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import katz, matroska, mixing, near_dedup, packing, quality, sharding, suffix_dedup, token_counts, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _on_documents(query: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": _on_documents(near_dedup.query),
        "op2_packing": _on_documents(packing.query),
        "op3_quality": _on_documents(quality.query),
        "op4_katz": _on_documents(katz.query),
        "op5_sharding": _on_documents(sharding.query),
        "op6_token_counts": _on_documents(token_counts.query),
        "op7_toxicity": op7_toxicity,
        "op8_mixing": _on_documents(mixing.query),
        "op9_suffix_dedup": _on_documents(suffix_dedup.query),
        "op10_media": _on_documents(matroska.query),
    }


def oracle_sql() -> dict[str, str]:
    from citeloom.llm import oracles

    return oracles.SQL
