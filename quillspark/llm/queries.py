"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from quillspark.llm import decontamination, difference_cover, exact_dedup, jaccard_join, language_id, mixing, run_index, token_counts, token_output, toxicity

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_run_index": run_index.op2_run_index,
    "op3_language_id": language_id.op3_language_id,
    "op4_difference_cover": difference_cover.op4_difference_cover,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_jaccard_join": jaccard_join.op9_jaccard_join,
    "op10_token_output": token_output.op10_token_output,
}
SQL = {"op1_mix_sources": mixing.SQL, "op2_run_index": run_index.SQL, "op4_difference_cover": difference_cover.SQL, "op5_decontamination": decontamination.SQL, "op9_jaccard_join": jaccard_join.SQL, "op8_exact_dedup": exact_dedup.SQL}
