"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import (
    chat_format,
    collocations,
    decontaminate,
    language_id,
    packing,
    personal_data,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash_dedup,
    spelling,
    suffix_dedup,
    token_blocks,
)

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/documents.parquet")


def op1_secret_scan(spark: SparkSession, root: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(documents(spark, root)))


def op2_simhash_dedup(spark: SparkSession, root: str) -> DataFrame:
    return simhash_dedup.digest(simhash_dedup.near_duplicates(documents(spark, root)))


def op3_decontamination(spark: SparkSession, root: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, root), spark.read.parquet(f"{root}/benchmark.parquet"))


def op4_best_fit_packing(spark: SparkSession, root: str) -> DataFrame:
    return packing.digest(packing.written(documents(spark, root)))


def op5_chat_format(spark: SparkSession, root: str) -> DataFrame:
    rows = chat_format.with_control_conversation(spark.read.parquet(f"{root}/conversations.parquet"))
    return chat_format.read_back(chat_format.format_conversations(rows))


def op6_quality_classifier(spark: SparkSession, root: str) -> DataFrame:
    return quality_classifier.score_documents(documents(spark, root), spark.read.parquet(f"{root}/labels.parquet"))


def op7_language_id(spark: SparkSession, root: str) -> DataFrame:
    return language_id.identify(documents(spark, root))


def op8_token_blocks(spark: SparkSession, root: str) -> DataFrame:
    folder = token_blocks.written(documents(spark, root))
    return token_blocks.digest(token_blocks.read_tokens(spark, folder))


def op9_quality_rules(spark: SparkSession, root: str) -> DataFrame:
    return quality_rules.digest(quality_rules.judge(documents(spark, root)))


def op10_suffix_dedup(spark: SparkSession, root: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.remove_repeats(documents(spark, root), keep=False))


def op11_collocations(spark: SparkSession, root: str) -> DataFrame:
    return collocations.collocations(documents(spark, root))


def op12_spelling_variants(spark: SparkSession, root: str) -> DataFrame:
    return spelling.variants(documents(spark, root))


def op13_personal_data(spark: SparkSession, root: str) -> DataFrame:
    return personal_data.digest(personal_data.find_personal_data(documents(spark, root)))


QUERIES: dict[str, Query] = {
    q.__name__: q
    for q in (
        op1_secret_scan,
        op2_simhash_dedup,
        op3_decontamination,
        op4_best_fit_packing,
        op5_chat_format,
        op6_quality_classifier,
        op7_language_id,
        op8_token_blocks,
        op9_quality_rules,
        op10_suffix_dedup,
        op11_collocations,
        op12_spelling_variants,
        op13_personal_data,
    )
}
ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": quality_rules.oracle_sql(),
    "op11_collocations": collocations.oracle_sql(),
}
