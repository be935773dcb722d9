"""The registered queries of this package and their SQL."""

from __future__ import annotations

from . import decontaminate, hard_negatives, html_text, language_id, near_dedup, nearest, periodic_runs, sentencepieces, substring_dedup, token_counts, token_files, toxicity, url_filter

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_html_text": html_text.op2_html_text,
    "op3_token_files": token_files.op3_token_files,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_sentencepiece": sentencepieces.op6_sentencepiece,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_nearest": nearest.op10_nearest,
    "op11_toxicity": toxicity.op11_toxicity,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
}

ORACLE_SQL = {
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op8_decontaminate": decontaminate.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
}
