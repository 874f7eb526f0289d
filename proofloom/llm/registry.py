"""The queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from proofloom.llm import bpe, byte_bpe, exact, importance, language, licenses, media, mixing, quality, simhash, suffixes, toxicity, whitening
from proofloom.llm.common import read_table

#: The tokenizer files of the queries; parameters of the operators, since they are not part of the repository.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(read_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"))
    return mixed.orderBy("position", "doc_id").select("doc_id", "size", "source_size", "target", "taken")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.detect(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read_table(spark, sf_dir, "documents"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.fingerprints(read_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read_table(spark, sf_dir, "documents"), TOKENIZER)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digests(read_table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_mixing": op2_mixing,
        "op3_toxicity": op3_toxicity,
        "op4_language": op4_language,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_fingerprints": op6_fingerprints,
        "op7_quality": op7_quality,
        "op8_bpe": op8_bpe,
        "op9_simhash": op9_simhash,
        "op10_media_columns": op10_media_columns,
        "op11_whitening": op11_whitening,
        "op12_importance": op12_importance,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": mixing.ORACLE, "op12_importance": importance.ORACLE}
