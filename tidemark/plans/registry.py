"""All queries over the driver tables, by name, with their DuckDB twins."""

from __future__ import annotations

from tidemark.plans import admission_queries, brief_queries, curation_queries, graph_queries, grid_queries, index_queries, more_queries, recall_queries, report_queries, scope_queries, table_queries, upkeep_queries

PAIRS = graph_queries.PAIRS | report_queries.PAIRS | curation_queries.PAIRS | more_queries.PAIRS | recall_queries.PAIRS | brief_queries.PAIRS | admission_queries.PAIRS | index_queries.PAIRS | table_queries.PAIRS | scope_queries.PAIRS | grid_queries.PAIRS | upkeep_queries.PAIRS

QUERIES = {name: query for name, (query, _) in PAIRS.items()}
ORACLES = {name: sql for name, (_, sql) in PAIRS.items() if sql}
