"""Queries and SQL of this package's operators."""

from __future__ import annotations

from . import credential_links, decontaminate, html_text, importance, jaccard_join, language_id, packing, prefix_trie, quality_rules, substring_dedup, toxicity, url_filter, vector_codes

_MODULES = (quality_rules, packing, language_id, jaccard_join, substring_dedup, url_filter, toxicity, html_text, importance, decontaminate, credential_links, vector_codes, prefix_trie)
QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in _MODULES for k, s in m.SQL.items()}
