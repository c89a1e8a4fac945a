"""Queries of the corpus operators, one per operator, and their SQL twins."""

from __future__ import annotations

from longview.llm import clustering, conversations, exact_dedup, html_text, jaccard, line_dedup, mixing, packing, pii, quality, sharding, simhash, toxicity

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_line_dedup": line_dedup.op2_line_dedup,
    "op3_html_text": html_text.op3_html_text,
    "op4_sharding": sharding.op4_sharding,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_mixing": mixing.op6_mixing,
    "op7_pii": pii.op7_pii,
    "op8_simhash": simhash.op8_simhash,
    "op9_quality": quality.op9_quality,
    "op10_exact_dedup": exact_dedup.op10_exact_dedup,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_ngram_jaccard": jaccard.op13_ngram_jaccard,
}
SQL = {
    "op2_line_dedup": line_dedup.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_centroid_clustering": clustering.SQL,
    "op13_ngram_jaccard": jaccard.SQL,
}
