"""The queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from packsmith.session import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import decontam

    return decontam.contamination(decontam.build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from packsmith.llm import pieces

    return pieces.encoding_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import licenses

    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import secrets

    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from packsmith.llm import tokenbin

    return tokenbin.record_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import simhash

    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import linededup

    return linededup.line_digest(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import toxicity

    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from packsmith.llm import ann

    return ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_language_id": op2_language_id,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_token_records": op6_token_records,
    "op7_simhash": op7_simhash,
    "op8_line_dedup": op8_line_dedup,
    "op9_toxicity": op9_toxicity,
    "op10_nearest": op10_nearest,
}
