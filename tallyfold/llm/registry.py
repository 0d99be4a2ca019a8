"""The queries of this subpackage, and SQL where it can express one."""

from __future__ import annotations

from tallyfold.llm import chat, decontaminate, filter_audit, html_extract, language_model, licenses, near_join, packing, pii, quality, secrets, source_audit, vector_search

QUERIES = {
    "op1_lm_scoring": language_model.op1_lm_scoring,
    "op2_license_scans": licenses.op2_license_scans,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_html_extraction": html_extract.op4_html_extraction,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_ngram_jaccard_join": near_join.op6_ngram_jaccard_join,
    "op7_pii": pii.op7_pii,
    "op8_benchmark_decontamination": decontaminate.op8_benchmark_decontamination,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_exact_top_k": vector_search.op10_exact_top_k,
    "op11_source_divergence_audit": source_audit.op11_source_divergence_audit,
    "op12_secret_scans": secrets.op12_secret_scans,
    "op13_filter_interaction_audit": filter_audit.op13_filter_interaction_audit,
}

SQL: dict[str, str] = {
    "op5_chat_formatting": chat.OP5_SQL,
    "op10_exact_top_k": vector_search.OP10_SQL,
    "op11_source_divergence_audit": source_audit.OP11_SQL,
    "op13_filter_interaction_audit": filter_audit.OP13_SQL,
}
