"""Queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from terraloom.llm import ann, hamming, html_text, mixing, pieces, secrets, sharding, simhash, substring, toxicity


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.op1_secret_scan,
        "op2_substring_dedup": substring.op2_substring_dedup,
        "op3_merge_dropout": pieces.op3_merge_dropout,
        "op4_virtual_slots": sharding.op4_virtual_slots,
        "op5_hamming_topk": hamming.op5_hamming_topk,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_stable_projections": ann.op7_stable_projections,
        "op8_simhash": simhash.op8_simhash,
        "op9_main_text": html_text.op9_main_text,
        "op10_mix_sources": mixing.op10_mix_sources,
    }


def oracle_sql() -> dict:
    return {"op2_substring_dedup": substring.OP2_SQL, "op5_hamming_topk": hamming.OP5_SQL, "op10_mix_sources": mixing.OP10_SQL}
