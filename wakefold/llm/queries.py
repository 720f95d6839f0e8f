"""The registered queries of this subpackage, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wakefold.llm import (
    chat,
    decontaminate,
    lexical,
    near_dedup,
    packing,
    personal_data,
    quality_model,
    quality_rules,
    sharding,
    source_audit,
    suffix_dedup,
    token_store,
    url_filter,
)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.removed_bytes(_table(spark, folder, "documents"))


def op2_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"), words=4)


def op3_minimax_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.sharded(_table(spark, folder, "documents"))


def op4_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(_table(spark, folder, "documents"))


def op5_factorisation_machine(spark: SparkSession, folder: str) -> DataFrame:
    return quality_model.quality_scores(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op6_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.store_documents(_table(spark, folder, "documents"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(url_filter.RULES, "verdict string, host string, path string")
    return url_filter.judged(_table(spark, folder, "pages"), rules)


def op8_chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    rows = _table(spark, folder, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], rows.schema)
    return chat.formatted_digests(rows.union(added))


def op9_string_tiling(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.judged(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


def op10_divergence_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.rule_values(_table(spark, folder, "documents")).drop("class_distance", "common_distance")


def op11_source_skyband(spark: SparkSession, folder: str) -> DataFrame:
    return source_audit.audited(_table(spark, folder, "documents"))


def op12_skip_chain_privacy(spark: SparkSession, folder: str) -> DataFrame:
    return personal_data.span_digests(personal_data.found_spans(_table(spark, folder, "documents")))


def op13_shared_ranking(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.ranked_documents(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_suffix_dedup,
        op2_minhash_near_dedup,
        op3_minimax_shards,
        op4_best_fit_packing,
        op5_factorisation_machine,
        op6_token_store,
        op7_url_filter,
        op8_chat_windows,
        op9_string_tiling,
        op10_divergence_rules,
        op11_source_skyband,
        op12_skip_chain_privacy,
        op13_shared_ranking,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": url_filter.JUDGED_SQL,
    "op11_source_skyband": source_audit.AUDIT_SQL,
    "op13_shared_ranking": lexical.RANKED_SQL,
}
