"""The operators' queries and SQL by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, lm_score, media_columns, near_dup, pieces, prefix_trie, quality_model, quality_rules, secret_scan, source_mix, substring_dedup, toxicity, whitening

_MODULES = {
    "op1_toxicity": toxicity,
    "op2_substring_dedup": substring_dedup,
    "op3_quality_classifier": quality_model,
    "op4_source_mix": source_mix,
    "op5_ppm_score": lm_score,
    "op6_quality_rules": quality_rules,
    "op7_media_columns": media_columns,
    "op8_sentencepiece": pieces,
    "op9_secret_scan": secret_scan,
    "op10_minhash_dedup": near_dup,
    "op11_line_dedup": line_dedup,
    "op12_prefix_trie": prefix_trie,
    "op13_whitening": whitening,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: m.query for name, m in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in _MODULES.items() if getattr(m, "ORACLE", None)}
