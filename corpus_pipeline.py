"""A corpus pipeline of five stages over ``documents``.

Each stage takes all that its predecessor kept; all but the last return the columns of
``documents``. Rejected documents go in the first stage, repeated lines in the second,
all but one document of each near-duplicate group in the third; the fourth emits each
document as often as the mix of sources takes it, the last encodes the result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bilens.llm import bpe, lines, mixing, packed, quality, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SQL cannot state the tokenisers, edit similarity and hashes; a brute-force version is in the tests.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, each row by its own text and language, with an id or without."""
    kept = quality.rules(docs).filter("kept").select("text_hash1", "text_hash2").distinct()
    docs = docs.select(COLUMNS)
    return docs.select("*", *quality.text_hashes("text", "lang")).join(kept, ["text_hash1", "text_hash2"], "left_semi").select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that another occurrence stands for; documents left without a word go."""
    out = lines.dedup_lines(docs, keep=["lang", "source"])
    out = out.withColumn("n_chars", F.length("text").cast("bigint"))
    return out.filter((F.col("n_dropped") == 0) | F.col("text").rlike(mixing.WORD)).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    The document of smallest id stays, rows without an id last; of equal rows, one.
    """
    docs = docs.select(COLUMNS)
    keys = docs.select("*", *packed.row_keys("doc_id", "text"))
    kept = keys.join(simhash.representatives(docs), ["k1", "k2"], "left_semi")
    first = Window.partitionBy("k1", "k2").orderBy("lang", "source", "n_chars")
    return kept.withColumn("copy", F.row_number().over(first)).filter("copy = 1").select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to the target weights takes it."""
    return mixing.mix(docs).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each emitted document; the tokens' text must be the document's."""
    return bpe.encode_checked(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("BPE encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
