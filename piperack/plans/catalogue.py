"""The registered queries and, under the same names, their SQL."""

from __future__ import annotations

from piperack.plans import answer_queries, drawing_queries, generation_queries, graph_queries, kb_queries, more_queries, record_queries, sheet_queries, study_queries, table_queries, topology_queries

_MODULES = (graph_queries, answer_queries, kb_queries, study_queries, table_queries, drawing_queries, generation_queries, more_queries, record_queries, sheet_queries, topology_queries)
QUERIES: dict = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
