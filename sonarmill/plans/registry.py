"""All queries of the library, without the optional subpackages."""

from __future__ import annotations

from sonarmill.plans import data_problems, diagnostic_queries, manifest_queries, metric_queries, signal_queries, stream_queries

_MODULES = (data_problems, metric_queries, manifest_queries, diagnostic_queries, signal_queries, stream_queries)
FLAGSHIP = "p2_found"
QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: text for module in _MODULES for name, text in module.ORACLE.items()}
