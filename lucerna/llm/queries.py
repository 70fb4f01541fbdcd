"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, jaccard_join, lexical_search, lm_scoring, mixing, packing, pii, quality, structure_repair, suffix_dedup, token_counts, toxicity

QUERIES = {
    "op1_pii_surrogates": pii.op1,
    "op2_toxicity": toxicity.op2,
    "op3_chat_formatting": chat.op3,
    "op4_suffix_dedup": suffix_dedup.op4,
    "op5_token_counts": token_counts.op5,
    "op6_quality_rules": quality.op6,
    "op7_best_fit_packing": packing.op7,
    "op8_jaccard_join": jaccard_join.op8,
    "op9_lm_scoring": lm_scoring.op9,
    "op10_spaced_seeds": decontaminate.op10,
    "op11_structure_repair": structure_repair.op11,
    "op12_lexical_search": lexical_search.op12,
    "op13_source_mix": mixing.op13,
}
ORACLE_SQL = {"op3_chat_formatting": chat.OP3_SQL, "op12_lexical_search": lexical_search.OP12_SQL}
