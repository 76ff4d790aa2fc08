"""All corpus queries and their SQL."""

from __future__ import annotations

from . import (
    collocations, decontaminate, exact_dedup, language_id, lm_score, merkle_manifest, near_dedup, packing, pii,
    quality_crf, substring_dedup, suffix_dedup, token_counts,
)

_MODULES = (
    quality_crf, near_dedup, token_counts, lm_score, exact_dedup, substring_dedup, language_id, decontaminate, packing,
    suffix_dedup, pii, collocations, merkle_manifest,
)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
