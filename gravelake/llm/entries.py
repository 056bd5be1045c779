"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe_codec, exact_dedup, hilbert_packing, odd_sketch_dedup, pii, quality_gbt, quality_rules, substring_dedup, token_counts, url_filters

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_odd_sketch_dedup": odd_sketch_dedup.op2_odd_sketch_dedup,
    "op3_bpe_codec": bpe_codec.op3_bpe_codec,
    "op4_pii": pii.op4_pii,
    "op5_quality_gbt": quality_gbt.op5_quality_gbt,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_hilbert_packing": hilbert_packing.op8_hilbert_packing,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_token_counts": token_counts.op10_token_counts,
}

ORACLE: dict[str, str] = {
    "op2_odd_sketch_dedup": odd_sketch_dedup.OP2_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op7_url_filters": url_filters.OP7_SQL,
    "op9_substring_dedup": substring_dedup.OP9_SQL,
}
