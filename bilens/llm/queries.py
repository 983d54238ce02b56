"""Registered queries of the corpus operators, and their SQL where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, conversations, interactions, lines, mixing, multi_index, quality, secret_scan, simhash, substring, suffix, urls


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_documents(spark, sf_dir))


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_documents(spark, sf_dir)).drop("kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rules(_documents(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_documents(spark, sf_dir))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return urls.filter_urls(pages, urls.ruled(pages))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_documents(spark, sf_dir))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_substring": op2_substring,
        "op3_lines": op3_lines,
        "op4_bpe": op4_bpe,
        "op5_suffix_array": op5_suffix_array,
        "op6_quality": op6_quality,
        "op7_secrets": op7_secrets,
        "op8_urls": op8_urls,
        "op9_neighbours": op9_neighbours,
        "op10_mixing": op10_mixing,
        "op11_conversations": op11_conversations,
        "op12_multi_index": op12_multi_index,
        "op13_interactions": op13_interactions,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring": substring.REPEATS_SQL,
        "op5_suffix_array": suffix.REPEATS_SQL,
        "op10_mixing": mixing.MIXTURE_SQL,
        "op11_conversations": conversations.REPAIR_SQL,
        "op12_multi_index": multi_index.LINKS_SQL,
        "op13_interactions": interactions.AUDIT_SQL,
    }
