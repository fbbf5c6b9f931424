"""Queries and SQL of the operators in this package, by name."""

from __future__ import annotations

from . import bpe, divergence, exact_dedup, filter_audit, html_extraction, line_dedup, lm_scoring, mixing, sharding, simhash, token_files, topk, toxicity

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_bpe": bpe.op2_bpe,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_token_files": token_files.op4_token_files,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_lm_scoring": lm_scoring.op7_lm_scoring,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_top_k": topk.op9_top_k,
    "op10_sharding": sharding.op10_sharding,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op9_top_k": topk.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
    "op12_html_extraction": html_extraction.op12_html_extraction,
    "op13_source_divergence": divergence.ORACLE,
}
