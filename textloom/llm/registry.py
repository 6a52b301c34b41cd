"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from textloom.llm import bpe, exact_dedup, html_text, licenses, mixing, near_dedup, pii, quality, substring_dedup, url_filter

QUERIES = {
    "op1_license_scan": licenses.op1_license_scan,
    "op10_pii": pii.op10_pii,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_page_text": html_text.op3_page_text,
    "op4_temperature_mixing": mixing.op4_temperature_mixing,
    "op5_bagminhash": near_dedup.op5_bagminhash,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_url_filter": url_filter.op7_url_filter,
    "op8_bpe": bpe.op8_bpe,
    "op9_quality_rules": quality.op9_quality_rules,
}
ORACLE_SQL = {
    "op5_bagminhash": near_dedup.SQL_OP5,
    "op6_exact_dedup": exact_dedup.SQL_OP6,
    "op7_url_filter": url_filter.SQL_OP7,
    "op2_substring_dedup": substring_dedup.SQL_OP2,
    "op9_quality_rules": quality.SQL_OP9,
}
