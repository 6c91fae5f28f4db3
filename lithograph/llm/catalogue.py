"""Queries and SQL of the corpus operators, gathered."""

from __future__ import annotations

from lithograph.llm import centroids, decontaminate, exact_dedup, hard_negatives, jaccard_join, license_scan, lm_score, near_dedup, secret_scan, sentencepiece_codec, substring_dedup, token_files, toxicity

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
for _module in (centroids, decontaminate, exact_dedup, hard_negatives, jaccard_join, license_scan, lm_score, near_dedup, secret_scan, sentencepiece_codec, substring_dedup, token_files, toxicity):
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
