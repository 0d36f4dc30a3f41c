"""Operators for preparing training text, and their registered queries."""

from __future__ import annotations


def _modules():
    from . import (
        decontamination,
        fill_in_middle,
        jaccard_join,
        language_id,
        licence_scan,
        quality_model,
        quality_rules,
        sentencepiece_bpe,
        spot_signatures,
        suffix_dedup,
        token_counts,
        token_files,
        vector_codes,
    )

    return (
        jaccard_join,
        token_files,
        suffix_dedup,
        language_id,
        licence_scan,
        decontamination,
        quality_rules,
        sentencepiece_bpe,
        quality_model,
        token_counts,
        spot_signatures,
        vector_codes,
        fill_in_middle,
    )


def queries() -> dict:
    return {name: query for module in _modules() for name, query in module.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for module in _modules() for name, sql in getattr(module, "ORACLE", {}).items()}
