"""The corpus pipeline: stages over `documents`, each on what its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of documents. run() writes each stage's result as Parquet to
the shared folder and reads it back as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, lines, neardup, toxicity
from sluice.llm.store import materialize

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    return toxicity.clean(docs, toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that repeat in others; n_chars follows the text."""
    dropped = F.col("`#dropped`")
    kept = lines.with_bitmaps(docs, lines.keep_bitmaps(docs)).withColumn("text", F.when(dropped.isNull(), F.col("text")).otherwise(lines.kept_text(F.col("text"), dropped)))
    counted = kept.withColumn("n_chars", F.when(dropped.isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast("long")))
    return counted.select(*docs.columns)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.dedup(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark (by the contamination rule)."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, ids_sha256, decoded_sha256 of each document's text."""
    return bpe.encode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", keep_harmless),
    ("line_dedup", dedup_lines),
    ("minhash_near_dedup", dedup_near),
    ("decontamination", decontaminated),
    ("byte_bpe", tokenize),
]

#: The stages can't all be expressed in SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all STAGES."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
