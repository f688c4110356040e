"""The registered queries of this subpackage, one per operator, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from . import asof_join, bit_slices, chat_tree, decontaminate, hnsw, katz, language_id, license_scan, minhash, piece_codec, runs, token_counts, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bit_slices.top_inner_products(table(spark, sf_dir, "embeddings"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_verdicts(table(spark, sf_dir, "pages"))


#: A conversation whose texts look like marks and escapes.
HARD = r"\### Assistant: </turn> ok"


def op5_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.createDataFrame([(-7, i, role, HARD) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_tree.read_back(*chat_tree.chat_tree(table(spark, sf_dir, "conversations").select(*hard.columns).unionByName(hard)))


def op6_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


def op8_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.katz_scores(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents")).drop("spans")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.nearest(table(spark, sf_dir, "embeddings"))


def op12_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof_join.click_orders(table(spark, sf_dir, "clicks"), table(spark, sf_dir, "sales"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.periodic_runs(runs.with_periods(table(spark, sf_dir, "documents"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_bit_slices, op3_decontaminate, op4_url_filter, op5_chat_tree, op6_piece_codec, op7_language_id, op8_katz, op9_license_scan, op10_token_counts, op11_hnsw, op12_asof, op13_runs)}


def oracle_sql() -> dict[str, str]:
    hard = "".join(f" UNION ALL SELECT -7, {i}, '{role}', '{HARD}'" for i, role in enumerate(("user", "assistant")))
    return {"op2_bit_slices": bit_slices.top_sql(), "op4_url_filter": url_filter.url_sql(), "op5_chat_tree": chat_tree.chat_sql(hard), "op12_asof": asof_join.click_sql()}
