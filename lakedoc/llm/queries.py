"""Registered queries of the operators: name to function, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    byte_bpe,
    chat_format,
    exact_dedup,
    filter_audit,
    hamming_search,
    lm_score,
    packing,
    quality_model,
    quality_rules,
    simhash,
    suffix_dedup,
    token_files,
    vector_codes,
)
from .common import table_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op8_exact_dedup", exact_dedup.ORACLE_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table_rows(spark, sf_dir, "documents"))


@query("op10_quality_rules")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(
        table_rows(spark, sf_dir, "documents"), table_rows(spark, sf_dir, "labels")
    )


@query("op3_token_files")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table_rows(spark, sf_dir, "documents")
    return token_files.token_file_digests(documents, vocabulary("byte_bpe_50k.json"))


@query("op9_byte_bpe")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table_rows(spark, sf_dir, "documents")
    return byte_bpe.round_trips(documents, vocabulary("byte_bpe_50k.tiktoken"))


@query("op4_best_fit_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table_rows(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op5_chat_format", chat_format.ORACLE_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = chat_format.canonical_turns(table_rows(spark, sf_dir, "conversations"))
    probe = spark.createDataFrame(chat_format.PROBE, turns.schema)
    return chat_format.formatted_digests(turns.unionByName(probe))


@query("op6_simhash")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table_rows(spark, sf_dir, "documents"))


@query("op1_quality_model")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(
        table_rows(spark, sf_dir, "documents"), table_rows(spark, sf_dir, "labels")
    )


@query("op2_suffix_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeat_digests(table_rows(spark, sf_dir, "documents"))


@query("op7_lm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.scores(table_rows(spark, sf_dir, "documents"))


@query("op13_filter_audit", filter_audit.ORACLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(
        table_rows(spark, sf_dir, "documents"), table_rows(spark, sf_dir, "labels")
    )


@query("op11_vector_codes", vector_codes.ORACLE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table_rows(spark, sf_dir, "embeddings"))


@query("op12_hamming_search")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_search.nearest(table_rows(spark, sf_dir, "embeddings"))
