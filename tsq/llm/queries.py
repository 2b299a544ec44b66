"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from tsq.llm import chunks, classifier, decontam, lm, mixing, neardup, pii, quality, suffix, tokens

QUERIES = {
    "op1_decontaminate": decontam.op1_decontaminate,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_quality_score": classifier.op4_quality_score,
    "op5_lm_score": lm.op5_lm_score,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_pii_spans": pii.op8_pii_spans,
    "op9_chunk_dedup": chunks.op9_chunk_dedup,
    "op10_token_counts": tokens.op10_token_counts,
}

ORACLES = {
    "op2_mix_sources": mixing.ORACLE,
    "op6_quality_rules": quality.ORACLE,
}
