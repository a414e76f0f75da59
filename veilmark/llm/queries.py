"""The registered queries of this package, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilmark.llm import q_chat_format, q_decontaminate, q_exact_dedup, q_language_id, q_license_scan, q_main_text, q_merkle, q_ngram_join, q_passages, q_quality_rules, q_resample, q_sentence_pieces, q_warc

_MODULES = (q_exact_dedup, q_chat_format, q_license_scan, q_sentence_pieces, q_language_id, q_ngram_join, q_decontaminate, q_warc, q_main_text, q_passages, q_resample, q_merkle, q_quality_rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
