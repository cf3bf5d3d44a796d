"""Queries of the training-data operators and their oracle SQL.

Operators without SQL are iterative, probabilistic or need a tokenizer; tests/llm holds them against brute force.
"""

from __future__ import annotations

from . import ann, exact_dedup, language_id, license_scan, lm_scoring, mixing, near_dedup, packing, sharding, suffix_dedup

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_packing": packing.op4_packing,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_lm_scoring": lm_scoring.op6_lm_scoring,
    "op7_license_scan": license_scan.op7_license_scan,
    "op8_nearest": ann.op8_nearest,
    "op9_sharding": sharding.op9_sharding,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {
    "op5_exact_dedup": exact_dedup.ORACLE_SQL,
    "op9_sharding": sharding.ORACLE_SQL,
}
