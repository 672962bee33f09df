"""Queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textwarden.llm import band_join, decontamination, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, oracles, periodic_runs, quality, substring_dedup, suffix_dedup, token_counts, toxicity


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _held_out(parts: int, part: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == part, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").withColumn("held_out", _held_out(3, 1))
    model = language_id.fit(docs.where("NOT held_out").select("doc_id", "text", "lang"))
    return language_id.predict(docs, model, extra={"held_out": F.col("held_out")})


def toxicity_model(spark: SparkSession, sf_dir: str) -> tuple | None:
    labels = _read(spark, sf_dir, "labels").where(~_held_out(4, 2)).select("doc_id", "toxic")
    return toxicity.fit(_read(spark, sf_dir, "documents"), labels)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", _held_out(4, 2).alias("held_out"), "text")
    out = toxicity.score(docs, toxicity_model(spark, sf_dir))
    return out.selectExpr("doc_id", "held_out", "toxic_score AS score", f"cast(toxic_score >= {toxicity.THRESHOLD} AS int) AS predicted", "n_sentences", "cast(size(offending) AS bigint) AS n_offending")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_read(spark, sf_dir, "documents")).select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(_read(spark, sf_dir, "documents"), width=35)
    return out.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.components(_read(spark, sf_dir, "documents"), n=4, percent=85)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"), width=400)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.score(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def quality_base_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the base rule of op8, which SQL can express."""
    counted = quality.features(_read(spark, sf_dir, "documents"))
    return counted.selectExpr("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{quality.BASE_FAILED} AS base_failed")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.summary(decontamination.find(docs, _read(spark, sf_dir, "benchmark")))


#: The folder of public tokenizer files; a parameter of the environment, not of the repository.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = token_counts.load_sentencepiece(f"{TOKENIZERS}/piece_bpe_32k.model")
    return token_counts.count_tokens(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocab).select("doc_id", "n_tokens")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_runs(_read(spark, sf_dir, "documents"))
    return periodic_runs.summary(periodic_runs.find(docs)).drop("n_words")


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(_read(spark, sf_dir, "documents"))


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join.ranked(band_join.near_lines(_read(spark, sf_dir, "items"), _read(spark, sf_dir, "sale_lines")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_toxicity, op3_lm_scoring, op4_substring_dedup, op5_mixing, op6_ngram_jaccard_join, op7_suffix_array_dedup, op8_quality_rules, op9_decontamination, op10_token_counts, op11_periodic_runs, op12_exact_dedup, op13_band_join, quality_base_counts)}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_lm_scoring": lm_scoring.ORACLE,
        "op4_substring_dedup": oracles.SUBSTRING,
        "op5_mixing": mixing.ORACLE,
        "op6_ngram_jaccard_join": oracles.JACCARD,
        "op7_suffix_array_dedup": oracles.SUFFIX,
        "op11_periodic_runs": oracles.RUNS,
        "op12_exact_dedup": exact_dedup.ORACLE,
        "op13_band_join": oracles.BAND,
        "quality_base_counts": oracles.QUALITY_BASE,
    }
