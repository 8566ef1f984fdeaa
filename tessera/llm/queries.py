"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from . import bpe, chat, embedding, fingerprint, line_dedup, mixing, near_dup, pii, repair, resample, substring, toxicity, urls

QUERIES = {
    "op1_chat_format": chat.op1_chat_format,
    "op2_entropy_mix": mixing.op2_entropy_mix,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_count_min_substrings": substring.op4_count_min_substrings,
    "op5_byte_bpe": bpe.op5_byte_bpe,
    "op6_boosted_pii": pii.op6_boosted_pii,
    "op7_p_stable_vectors": embedding.op7_p_stable_vectors,
    "op8_order_minhash": near_dup.op8_order_minhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_fingerprint": fingerprint.op10_fingerprint,
    "op11_bloom_urls": urls.op11_bloom_urls,
    "op12_structure_repair": repair.op12_structure_repair,
    "op13_importance_resample": resample.op13_importance_resample,
}

ORACLE_SQL = {
    "op4_count_min_substrings": substring.OP4_SQL,
    "op9_line_dedup": line_dedup.OP9_SQL,
    "op11_bloom_urls": urls.OP11_SQL,
    "op12_structure_repair": repair.OP12_SQL,
    "op13_importance_resample": resample.OP13_SQL,
}
