"""The queries of this package and their SQL twins; __spark_entry__ adds them to the catalogue."""

from __future__ import annotations

from barspark.llm import decontamination, hard_negatives, html_extract, language_id, license_scan, line_dedup, mixing, quality_rules, sharding, simhash_dedup, substring_dedup, token_counts, whitening

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_decontamination": decontamination.op4_decontamination,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_sharding": sharding.op7_sharding,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_simhash_dedup": simhash_dedup.op9_simhash_dedup,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_language_id": language_id.op12_language_id,
    "op13_whitening": whitening.op13_whitening,
}

#: Queries that SQL can express; the others are tested against brute force in tests/llm.
ORACLE_SQL = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_mixing": mixing.OP3_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
}
