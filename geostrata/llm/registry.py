"""Queries and SQL of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geostrata.llm import decontamination, language_id, packing, quality_classifier, quality_rules, secrets, sharding, simhash, suffix_dedup, token_counts


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        language_id.op1_language_id,
        sharding.op2_sharding,
        simhash.op3_simhash,
        token_counts.op4_token_counts,
        quality_rules.op5_quality_rules,
        suffix_dedup.op6_suffix_dedup,
        packing.op7_packing,
        decontamination.op8_decontamination,
        secrets.op9_secrets,
        quality_classifier.op10_quality_classifier,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": sharding.sql()}
