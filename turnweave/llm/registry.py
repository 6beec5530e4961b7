"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from turnweave.llm import queries as q

QUERIES = {
    "op1_exact_dedup": q.op1_exact_dedup,
    "op2_toxicity": q.op2_toxicity,
    "op3_chat_formatting": q.op3_chat_formatting,
    "op4_license_scan": q.op4_license_scan,
    "op5_best_fit_packing": q.op5_best_fit_packing,
    "op6_pii": q.op6_pii,
    "op7_sharding": q.op7_sharding,
    "op8_near_dedup": q.op8_near_dedup,
    "op9_quality_rules": q.op9_quality_rules,
    "op10_mixing": q.op10_mixing,
    "op11_spelling_variants": q.op11_spelling_variants,
    "op12_quality_classifier": q.op12_quality_classifier,
    "op13_prefix_trie": q.op13_prefix_trie,
}

ORACLE_SQL = {
    "op1_exact_dedup": q.OP1_SQL,
    "op3_chat_formatting": q.OP3_SQL,
    "op4_license_scan": q.OP4_SQL,
    "op7_sharding": q.OP7_SQL,
    "op9_quality_rules": q.OP9_SQL,
    "op10_mixing": q.OP10_SQL,
    "op11_spelling_variants": q.OP11_SQL,
    "op13_prefix_trie": q.OP13_SQL,
}
