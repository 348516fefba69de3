"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from salescope.llm import chat, decontamination, exact_dedup, filter_audit, jaccard_join, lexical_search, lm_score, mixing, simhash, substring_dedup, toxicity, url_filter, warc

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_source_mixing": mixing.op2_source_mixing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_jaccard_join": jaccard_join.op5_jaccard_join,
    "op6_decontamination": decontamination.op6_decontamination,
    "op7_lm_score": lm_score.op7_lm_score,
    "op8_warc": warc.op8_warc,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_filter_audit": filter_audit.op11_filter_audit,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_simhash": simhash.op13_simhash,
}

ORACLE = {
    "op1_chat_formatting": chat.OP1_SQL,
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op8_warc": warc.OP8_SQL,
    "op9_url_filter": url_filter.OP9_SQL,
    "op11_filter_audit": filter_audit.OP11_SQL,
    "op12_lexical_search": lexical_search.OP12_SQL,
}
