"""The driver queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ball_tree, language, line_dedup, mixing, near_dedup, packing, quality, sharding, token_files, toxicity

QUERIES = {
    "op1_near_dedup": near_dedup.op1_near_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_language": language.op3_language,
    "op4_token_files": token_files.op4_token_files,
    "op5_quality": quality.op5_quality,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_top_products": ball_tree.op7_top_products,
    "op8_packing": packing.op8_packing,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_sharding": sharding.op10_sharding,
}

ORACLE_SQL: dict[str, str] = {"op1_near_dedup": near_dedup.SQL, "op7_top_products": ball_tree.SQL}
