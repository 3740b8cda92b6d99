"""The queries and SQL oracles of the training-data operators."""

from __future__ import annotations

from weftline.llm import decontaminate, line_dedup, lm_score, ngram_join, quality_classifier, quality_rules, secret_scan, spm_codec, suffix_dedup, url_filter

QUERIES = {
    "op1_secret_scans": secret_scan.op1_secret_scans,
    "op2_sentencepiece": spm_codec.op2_sentencepiece,
    "op3_substring_dedup": line_dedup.op3_substring_dedup,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_url_filters": url_filter.op5_url_filters,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_lm_scoring": lm_score.op8_lm_scoring,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_ngram_join": ngram_join.op10_ngram_join,
}
ORACLES = {
    "op1_secret_scans": secret_scan.ORACLE,
    "op3_substring_dedup": line_dedup.ORACLE,
    "op4_suffix_dedup": suffix_dedup.ORACLE,
    "op5_url_filters": url_filter.ORACLE,
    "op8_lm_scoring": lm_score.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_ngram_join": ngram_join.ORACLE,
}
