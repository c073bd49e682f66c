"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, embedding_dedup, filter_audit, line_dedup, minhash, mixing, quality, sharding, source_divergence, suffix_dedup, token_counts, toxicity, url_filter

_MODULES = [decontamination, embedding_dedup, filter_audit, line_dedup, minhash, mixing, quality, sharding, source_divergence, suffix_dedup, token_counts, toxicity, url_filter]
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in _MODULES for k, s in m.ORACLE_SQL.items()}
