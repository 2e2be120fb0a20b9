"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import exact_dedup, html_extract, line_dedup, packing, quality, sampled_pieces, sharding, simhash, token_counts, toxicity

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_exact_dedup": exact_dedup.op2_exact_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_sampled_pieces": sampled_pieces.op4_sampled_pieces,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_simhash_dedup": simhash.op6_simhash_dedup,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_html_extract": html_extract.op10_html_extract,
}
ORACLE_SQL = {"op2_exact_dedup": exact_dedup.OP2_SQL}
