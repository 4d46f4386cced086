"""Registered queries of the operators, and DuckDB SQL where it can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simtrail.llm import (
    decontaminate,
    disclosure,
    line_dedup,
    manifest,
    near_dedup,
    oracle,
    page_text,
    phrases,
    pieces,
    quality_model,
    quality_rules,
    repeats,
    simhash_near,
    token_files,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = [
        near_dedup.op1_minhash_near_dedup,
        quality_model.op2_quality_classifier,
        token_files.op3_orc_tokens,
        quality_rules.op4_quality_rules,
        decontaminate.op5_winnowing_decontamination,
        line_dedup.op6_simhash_line_dedup,
        page_text.op7_html_main_text,
        disclosure.op8_pii_disclosure,
        pieces.op9_sentencepiece,
        repeats.op10_suffix_repeats,
        simhash_near.op11_simhash_near_dedup,
        phrases.op12_phrase_collocations,
        manifest.op13_merkle_manifest,
    ]
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express; the others are held against brute force in tests."""
    return oracle.oracle_sql()
