"""The registered queries of the corpus operators, and SQL where it can express them."""

from __future__ import annotations

import corpus_pipeline
from tidewatch.llm import chat_format, decontaminate, exact_dedup, line_dedup, ngram_join, piece_bpe, quality, sharding, spelling, topk, toxicity, url_filter, whitening


def queries() -> dict:
    return {
        "op1_preference_format": chat_format.op1_preference_format,
        "op2_decontamination": decontaminate.op2_decontamination,
        "op3_quality": quality.op3_quality,
        "op4_url_filter": url_filter.op4_url_filter,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_bounded_ring": sharding.op6_bounded_ring,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_piece_bpe": piece_bpe.op8_piece_bpe,
        "op9_topk": topk.op9_topk,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_spelling_variants": spelling.op11_spelling_variants,
        "op12_exact_dedup": exact_dedup.op12_exact_dedup,
        "op13_whitening": whitening.op13_whitening,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    return {
        "op1_preference_format": chat_format.OP1_SQL,
        "op4_url_filter": url_filter.OP4_SQL,
        "op5_ngram_join": ngram_join.OP5_SQL,
        "op7_line_dedup": line_dedup.OP7_SQL,
        "op9_topk": topk.OP9_SQL,
        "op11_spelling_variants": spelling.OP11_SQL,
        "op12_exact_dedup": exact_dedup.OP12_SQL,
    }
