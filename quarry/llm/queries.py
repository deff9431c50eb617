"""One query for each operator, over whole tables, with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, ctw, decontaminate, langid, mixing, pii, prefix_trie, quality, secret_scan, simhash, sql, suffixes, token_counts, variants
from .common import scratch_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, width=1, radius=4)


def op2_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.preferences(chat.other_endings(table(spark, sf_dir, "conversations")))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"), threshold=400)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op10_ctw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_texts(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(table(spark, sf_dir, "documents"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with an empty store, so that every run does the whole work."""
    import public_tokenizers

    cache = f"{scratch_dir(spark)}/token-store-{uuid.uuid4().hex}"
    return token_counts.token_counts(table(spark, sf_dir, "documents"), token_counts.pieces(public_tokenizers.path("piece_bpe_32k.model")), cache)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_preferences": op2_preferences,
    "op3_langid": op3_langid,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_repeats": op7_repeats,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_ctw": op10_ctw,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_variants": op12_variants,
    "op13_token_counts": op13_token_counts,
}

ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
