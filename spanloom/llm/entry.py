"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from spanloom.llm import chat, decontaminate, html, infill, langid, licenses, mixing, negatives, pii, quality, search, simhash, suffix_dedup

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_bm25_search": search.op2_bm25_search,
    "op3_chat_format": chat.op3_chat_format,
    "op4_language_id": langid.op4_language_id,
    "op5_html_extraction": html.op5_html_extraction,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_simhash_near_dedup": simhash.op7_simhash_near_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_pii_spans": pii.op9_pii_spans,
    "op10_benchmark_decontamination": decontaminate.op10_benchmark_decontamination,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_fill_in_middle": infill.op12_fill_in_middle,
    "op13_license_scan": licenses.op13_license_scan,
}

ORACLE = {
    "op2_bm25_search": search.OP2_SQL,
    "op8_mix_sources": mixing.OP8_SQL,
    "op11_hard_negatives": negatives.OP11_SQL,
    "op12_fill_in_middle": infill.OP12_SQL,
    "op13_license_scan": licenses.OP13_SQL,
}
