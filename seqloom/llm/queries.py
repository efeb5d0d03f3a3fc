"""Queries of the operators in this folder, and DuckDB SQL where that can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import audio_media, ball_kmeans, bin_packing, chat_format, context_mixing, merkle_manifest, odd_minhash, quality, secret_ledger, source_mix, substring_dedup, template_leaks, token_store
from seqloom.llm._shared import kept_for, made, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.neighbour_pairs(_table(spark, sf_dir, "conversations"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(_table(spark, sf_dir, "documents"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_output(_table(spark, sf_dir, "documents"))


def op5_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_ledger.secret_report(_table(spark, sf_dir, "documents"))


def op6_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_leaks.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.score(_table(spark, sf_dir, "documents"))


def op8_audio_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(audio_media.store_media(_table(spark, sf_dir, "documents")), "media", "zstd")
    return audio_media.read_features(materialize(audio_media.media_features(media), "features", "uncompressed"))


def op9_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return odd_minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.mix(_table(spark, sf_dir, "documents"))


def op11_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_packing.packing(_table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.proofs(_table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.cluster(_table(spark, sf_dir, "embeddings"))


def _clean(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query``, which deletes the tables it wrote on the way, but for those that its result reads."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = made()
        return kept_for(query(spark, sf_dir), before)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_chat_pairs": op1_chat_pairs,
        "op2_quality": op2_quality,
        "op3_substring_dedup": op3_substring_dedup,
        "op4_token_store": op4_token_store,
        "op5_secret_ledger": op5_secret_ledger,
        "op6_template_leaks": op6_template_leaks,
        "op7_context_mixing": op7_context_mixing,
        "op8_audio_media": op8_audio_media,
        "op9_odd_minhash": op9_odd_minhash,
        "op10_source_mix": op10_source_mix,
        "op11_bin_completion": op11_bin_completion,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_ball_kmeans": op13_ball_kmeans,
    }
    return {name: _clean(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_pairs": chat_format.PAIRS_SQL,
        "op5_secret_ledger": secret_ledger.REPORT_SQL,
        "op9_odd_minhash": odd_minhash.EXACT_SQL,
        "op10_source_mix": source_mix.MIX_SQL,
        "op12_merkle_manifest": merkle_manifest.PROOFS_SQL,
        "op13_ball_kmeans": ball_kmeans.CLUSTER_SQL,
    }
