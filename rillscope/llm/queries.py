"""Registered queries of the text operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

WORD_VOCAB = 49_408
END_ID = 1


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_binary import token_digests

    return token_digests(_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"), END_ID, WORD_VOCAB)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_verdicts

    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).drop("failed")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import repeated_bytes

    return repeated_bytes(_table(spark, sf_dir, "documents")).drop("kept")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import encoded_lengths, length_histogram

    return length_histogram(encoded_lengths(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern()))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .byte_bpe import bpe_digests

    return bpe_digests(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), _pattern())


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import duplicate_passages

    return duplicate_passages(_table(spark, sf_dir, "documents"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import repaired_turns

    return repaired_turns(_table(spark, sf_dir, "conversations"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_texts

    return score_texts(_table(spark, sf_dir, "documents"))


def op10_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash_dedup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import whiten

    return whiten(_table(spark, sf_dir, "embeddings"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import divergences

    return divergences(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_binary": op1_token_binary,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_quality_rules": op3_quality_rules,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_token_counts": op5_token_counts,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_chat_format": op7_chat_format,
        "op8_decontamination": op8_decontamination,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_minhash_dedup": op10_minhash_dedup,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_whitening": op12_whitening,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    """SQL cannot express the other operators; they are tested against brute force."""
    from .oracle import divergence_sql, exact_dedup_sql, quality_rules_sql

    return {"op3_quality_rules": quality_rules_sql(), "op11_exact_dedup": exact_dedup_sql(), "op13_source_divergence": divergence_sql()}
