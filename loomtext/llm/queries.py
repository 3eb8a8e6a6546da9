"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, edit_fingerprints, embedding_dedup, fill_in_middle, language_id, line_dedup, lm_scoring, near_dedup, packing, pii, sharding, spelling, toxicity

_MODULES = [bpe, edit_fingerprints, embedding_dedup, fill_in_middle, language_id, line_dedup, lm_scoring, near_dedup, packing, pii, sharding, spelling, toxicity]


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
