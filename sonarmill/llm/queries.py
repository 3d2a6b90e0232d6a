"""All queries of the subpackage."""

from __future__ import annotations

from sonarmill.llm import language_queries, leaks_queries, mixing_queries, overlap_queries, splits_queries

_MODULES = (overlap_queries, splits_queries, leaks_queries, mixing_queries, language_queries)
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in _MODULES for name, text in module.ORACLE.items()}
