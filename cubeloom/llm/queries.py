"""The registered queries of this subpackage, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cubeloom.llm import bpe, brown_lm, html_text, jaccard_join, line_rules, packing, positional_index, quality, spelling_variants, substring_dedup, token_counts, url_filter, vector_codes
from cubeloom.llm.common import table
from cubeloom.llm.oracle import ORACLES


def byte_bpe_path() -> str:
    """Where the public byte-level BPE file is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score_documents(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup_digests(table(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_benchmark_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positional_index.decontamination_digests(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.apply_rules(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_by_section(table(spark, sf_dir, "documents"), byte_bpe_path())


def op10_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), byte_bpe_path())


def word_bpe_path() -> str:
    """Where the public BPE file of whole words is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_bpe_path())


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_brown_lm": op1_brown_lm,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_html_text": op3_html_text,
        "op4_quality": op4_quality,
        "op5_url_templates": op5_url_templates,
        "op6_benchmark_index": op6_benchmark_index,
        "op7_line_rules": op7_line_rules,
        "op8_jaccard_join": op8_jaccard_join,
        "op9_token_counts": op9_token_counts,
        "op10_bpe_round_trip": op10_bpe_round_trip,
        "op11_packing": op11_packing,
        "op12_vector_codes": op12_vector_codes,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
