"""Queries of this subpackage, by name, and the SQL of those that SQL can state.

``base...`` are the columns of an operator's query that SQL can state where it can't state them all.
"""

from . import decontaminate, extraction, langid, lexical, mixing, negatives, pii, repeats, secrets, simhash, suffix_tree, topk, toxicity

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_secrets": secrets.query,
    "op3_language": langid.query,
    "op4_decontaminate": decontaminate.query,
    "op5_personal_data": pii.query,
    "op6_toxicity": toxicity.query,
    "op7_suffix_tree": suffix_tree.query,
    "op8_near_duplicates": simhash.query,
    "op9_repeats": repeats.query,
    "op10_top_k": topk.query,
    "op11_main_text": extraction.query,
    "op12_ranked_search": lexical.query,
    "op13_hard_negatives": negatives.query,
    "base2_secrets": secrets.base_query,
    "base5_personal_data": pii.base_query,
    "base7_unigram": suffix_tree.base_query,
}
SQL = {
    "op1_mix_sources": mixing.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op9_repeats": repeats.SQL,
    "op10_top_k": topk.SQL,
    "op11_main_text": extraction.SQL,
    "op12_ranked_search": lexical.SQL,
    "op13_hard_negatives": negatives.SQL,
    "base2_secrets": secrets.BASE_SQL,
    "base5_personal_data": pii.BASE_SQL,
    "base7_unigram": suffix_tree.BASE_SQL,
}
