"""The queries of this package and, where SQL can express them, their oracles."""

from __future__ import annotations

from snaptide.llm import bloom_cascade, ecoc_lang, latent_decontam, line_dedup, page_diff, pareto_mix, quality_rules, secret_link, simhash_pivots, warc_members

_OPERATORS = {
    "op1_pareto_mix": pareto_mix,
    "op2_secret_link": secret_link,
    "op3_ecoc_lang": ecoc_lang,
    "op4_bloom_cascade": bloom_cascade,
    "op5_simhash_pivots": simhash_pivots,
    "op6_page_diff": page_diff,
    "op7_line_dedup": line_dedup,
    "op8_latent_decontam": latent_decontam,
    "op9_quality_rules": quality_rules,
    "op10_warc_members": warc_members,
}


def queries() -> dict:
    return {name: module.query for name, module in _OPERATORS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _OPERATORS.items() if getattr(module, "ORACLE", None)}
