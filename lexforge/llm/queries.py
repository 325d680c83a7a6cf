"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lexforge.llm import bpe, decontamination, embedding_dedup, exact_dedup, fill_in_middle, hard_negatives, language_id, line_dedup, lm_scoring, mixing, near_dedup, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
        "op2_mix_sources": mixing.op2_mix_sources,
        "op3_bpe": bpe.op3_bpe,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_line_dedup": line_dedup.op5_line_dedup,
        "op6_language_id": language_id.op6_language_id,
        "op7_url_filter": url_filter.op7_url_filter,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_lm_scoring": lm_scoring.op9_lm_scoring,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
        "op12_decontamination": decontamination.op12_decontamination,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_embedding_dedup": embedding_dedup.OP1_SQL,
        "op2_mix_sources": mixing.OP2_SQL,
        "op5_line_dedup": line_dedup.OP5_SQL,
        "op7_url_filter": url_filter.OP7_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op11_fill_in_middle": fill_in_middle.OP11_SQL,
        "op12_decontamination": decontamination.OP12_SQL,
        "op13_hard_negatives": hard_negatives.OP13_SQL,
    }
