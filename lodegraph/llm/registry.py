"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embeddings, jaccard, langid, licences, mix, negatives, packing, quality, secrets, substrings, suffixes, whitening


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mix.op1_mix_sources,
        "op2_quality": quality.op2_quality,
        "op3_substring_dedup": substrings.op3_substring_dedup,
        "op4_format_chat": chat.op4_format_chat,
        "op5_pack": packing.op5_pack,
        "op6_embedding_dedup": embeddings.op6_embedding_dedup,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_licence_scan": licences.op8_licence_scan,
        "op9_language_id": langid.op9_language_id,
        "op10_jaccard_join": jaccard.op10_jaccard_join,
        "op11_whitening": whitening.op11_whitening,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_suffix_dedup": suffixes.op13_suffix_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mix.ORACLE, "op3_substring_dedup": substrings.ORACLE, "op4_format_chat": chat.ORACLE,
            "op6_embedding_dedup": embeddings.ORACLE, "op10_jaccard_join": jaccard.ORACLE, "op12_hard_negatives": negatives.ORACLE}
