"""Queries of the operators of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from wordloom.llm import bpe, language_id, line_dedup, minhash, packing, quality_rules, sharding, suffix_dedup, topk_search, url_filter

QUERIES = {
    "op1_suffix_dedup": suffix_dedup.op1,
    "op2_url_filter": url_filter.op2,
    "op3_language_id": language_id.op3,
    "op4_topk_search": topk_search.op4,
    "op5_quality_rules": quality_rules.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_packing": packing.op7,
    "op8_minhash": minhash.op8,
    "op9_bpe": bpe.op9,
    "op10_sharding": sharding.op10,
}

ORACLES = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_url_filter": url_filter.ORACLE,
    "op4_topk_search": topk_search.ORACLE,
    "op5_quality_rules": quality_rules.ORACLE,
    "op6_line_dedup": line_dedup.ORACLE,
    "op10_sharding": sharding.ORACLE,
}
