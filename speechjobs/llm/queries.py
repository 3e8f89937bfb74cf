"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from . import bpe, centroids, conversations, exact_dedup, fingerprints, language_id, mixing, near_dedup, packing, pii, quality, substring_dedup, toxicity

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_mixing": mixing.op2_mixing,
    "op3_substring_dedup": substring_dedup.op3_substring_dedup,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_packing": packing.op7_packing,
    "op8_language_id": language_id.op8_language_id,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_bpe": bpe.op11_bpe,
    "op12_conversations": conversations.op12_conversations,
    "op13_centroids": centroids.op13_centroids,
}
ORACLE = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_substring_dedup": substring_dedup.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op9_near_dedup": near_dedup.OP9_SQL,
    "op12_conversations": conversations.OP12_SQL,
    "op13_centroids": centroids.OP13_SQL,
}
