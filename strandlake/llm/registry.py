"""The queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from . import bloom_sketch, license_scan, line_dedup, lm_scoring, mixing, near_dedup, packing, quality_rules, records, surrogates

QUERIES = {
    "op1_lm_scoring": lm_scoring.op1_lm_scoring,
    "op2_bloom_sketch": bloom_sketch.op2_bloom_sketch,
    "op3_surrogates": surrogates.op3_surrogates,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_near_dedup": near_dedup.op6_near_dedup,
    "op7_binary_records": records.op7_binary_records,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_retrieval_packing": packing.op10_retrieval_packing,
}

ORACLES = {
    "op4_quality_rules": quality_rules.ORACLE,
    "op5_license_scan": license_scan.ORACLE,
    "op6_near_dedup": near_dedup.ORACLE,
}
