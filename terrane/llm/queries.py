"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terrane.llm import alignment, audio_media, bpe_table, chat_tree, decontaminate, language_id, license_scan, merkle, mixing, oracle, quality, simhash, suffix_dedup, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_simhash_near_dedup": simhash.op2_simhash_near_dedup,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_chat_prefix_tree": chat_tree.op5_chat_prefix_tree,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
        "op8_language_id": language_id.op8_language_id,
        "op9_media_columns": audio_media.op9_media_columns,
        "op10_quality_classifier": quality.op10_quality_classifier,
        "op11_bpe_table": bpe_table.op11_bpe_table,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_token_alignment": alignment.op13_token_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
