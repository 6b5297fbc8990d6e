"""The operators' queries over whole tables, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import chat, jaccard, lm, media, packing, pieces, pii, quality, repeats, topk

QUERIES = {
    "op1_quality_classifier": quality.query,
    "op2_chat_formatting": chat.query,
    "op3_best_fit_packing": packing.query,
    "op4_media_columns": media.query,
    "op5_sentencepiece": pieces.query,
    "op6_topk_search": topk.query,
    "op7_lm_scoring": lm.query,
    "op8_ngram_jaccard_join": jaccard.query,
    "op9_suffix_array_dedup": repeats.query,
    "op10_pii": pii.query,
}
ORACLES = {
    "op2_chat_formatting": chat.ORACLE,
    "op6_topk_search": topk.ORACLE,
}
