"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import decontaminate, html_extract, language_id, line_dedup, mixing, ngram_join, substring_dedup, token_counts, topk, toxicity

QUERIES = {
    "op1_language_id": language_id.query,
    "op2_token_counts": token_counts.query,
    "op3_decontamination": decontaminate.query,
    "op4_ngram_join": ngram_join.query,
    "op5_mixing": mixing.query,
    "op6_topk": topk.query,
    "op7_line_dedup": line_dedup.query,
    "op8_html": html_extract.query,
    "op9_substring_dedup": substring_dedup.query,
    "op10_toxicity": toxicity.query,
}
ORACLE = {"op4_ngram_join": ngram_join.SQL, "op5_mixing": mixing.SQL, "op6_topk": topk.SQL}
