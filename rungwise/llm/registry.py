"""Queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from rungwise.llm import (
    exact_dedup,
    fixity,
    jaccard_join,
    language,
    licences,
    mixing,
    packing,
    suffix_dedup,
    topk,
    toxicity,
)

_MODULES = {
    "op1_suffix_dedup": suffix_dedup,
    "op2_toxicity": toxicity,
    "op3_language": language,
    "op4_fixity_audit": fixity,
    "op5_jaccard_join": jaccard_join,
    "op6_best_fit_packing": packing,
    "op7_licence_dice": licences,
    "op8_poisson_mixing": mixing,
    "op9_exact_dedup": exact_dedup,
    "op10_pivot_topk": topk,
}


def queries() -> dict:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if module.ORACLE}
