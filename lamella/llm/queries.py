"""The queries of this subpackage, by name, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprints, lang_id, mixing, near_dedup, quality_classifier, quality_rules, secrets, suffix_dedup, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        secrets.op1_secret_scan,
        near_dedup.op2_near_dedup,
        fingerprints.op3_fingerprints,
        bpe.op4_byte_bpe,
        suffix_dedup.op5_suffix_dedup,
        lang_id.op6_lang_id,
        quality_rules.op7_quality_rules,
        token_counts.op8_token_counts,
        quality_classifier.op9_quality_classifier,
        mixing.op10_source_mixing,
    )
}

ORACLE_SQL: dict[str, str] = {}
