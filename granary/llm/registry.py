"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from granary.llm import collocations, decontaminate, jaccard_join, merkle, packing, quality_cnn, quality_rules, secret_scan, token_rollup, toxicity, url_filter, warc, wavelet

QUERIES = {
    "op1_secret_scans": secret_scan.op1_secret_scans,
    "op2_benchmark_decontamination": decontaminate.op2_benchmark_decontamination,
    "op3_ngram_jaccard": jaccard_join.op3_ngram_jaccard,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_warc": warc.op6_warc,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_filters": url_filter.op8_url_filters,
    "op9_token_counts": token_rollup.op9_token_counts,
    "op10_quality_classifier": quality_cnn.op10_quality_classifier,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_token_files": wavelet.op12_token_files,
    "op13_phrase_collocations": collocations.op13_phrase_collocations,
    "token_rollup_by_expressions": token_rollup.token_rollup_by_expressions,
}

ORACLE = {
    "op1_secret_scans": secret_scan.SQL,
    "op5_quality_rules": quality_rules.SQL,
    "op8_url_filters": url_filter.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op13_phrase_collocations": collocations.SQL,
    "token_rollup_by_expressions": token_rollup.SQL,
}
