"""The registered queries of this folder, and DuckDB SQL where it can express them."""

from __future__ import annotations

from tallyspark.llm import decontaminate, divergence, line_dedup, nearest, packing, periodic, pseudonyms, quality, secrets, simhash, token_files, token_rollup, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.query,
    "op2_secrets": secrets.query,
    "op3_packing": packing.query,
    "op4_quality": quality.query,
    "op5_line_dedup": line_dedup.query,
    "op6_nearest": nearest.query,
    "op7_toxicity": toxicity.query,
    "op8_token_counts": token_rollup.query,
    "op9_simhash": simhash.query,
    "op10_pseudonyms": pseudonyms.query,
    "op11_token_files": token_files.query,
    "op12_periodic_runs": periodic.query,
    "op13_source_divergence": divergence.query,
    "conversation_packing": packing.conversations_query,
}
ORACLE = {"op1_decontamination": decontaminate.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op13_source_divergence": divergence.ORACLE}
