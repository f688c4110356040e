"""A corpus pipeline: language ID, near-duplicates, benchmark decontamination, then encoding.

Each stage takes all that the one before kept. The first three return the columns of documents. Rows are judged by
their own texts: of rows that are wholly alike one stays, and rows that share a doc_id or have none need not share a fate.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from subsidia.llm import decontaminate, language_id, minhash, piece_codec
from subsidia.llm.common import materialise


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that lie near a language's centroid."""
    train = docs.select(F.col("doc_id").alias("key"), "text", "lang").where("key is not null")
    return language_id.accepted(docs, language_id.fit(train))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the ids of each text, and the digest of what they decode to."""
    return piece_codec.piece_digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", known_language), ("near_duplicates", one_of_each), ("decontaminate", without_benchmark), ("encode", encoded)]
#: Nearest centroids and latent spaces have no SQL; tests/llm holds the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
