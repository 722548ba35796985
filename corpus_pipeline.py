"""The corpus pipeline: STAGES in order, each over all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession

from affinityloom.llm import byte_bpe, decontaminate, jaccard_join, line_dedup
from affinityloom.llm.common import scratch_path
from affinityloom.llm.queries import toxicity_model


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled rows of the tables, doesn't reject."""
    scored = toxicity_model(spark, sf_dir).score(docs)
    return scored.where("score < 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one_per_group(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit) and decoded_sha256 of every document left."""
    return byte_bpe.encode_texts(
        docs, tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ["doc_id"], digest=False)


STAGES = [
    ("toxicity", toxicity), ("line_dedup", lines), ("jaccard_join", near_duplicates), ("decontamination", benchmark), ("byte_bpe", encode),
]

#: The classifier can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
