"""All queries of the corpus operators and their SQL."""

from __future__ import annotations

from .plans import corpus_queries, document_queries, file_queries, graph_queries, map_queries, office_queries, reader_queries, table_queries

_MODULES = (corpus_queries, table_queries, file_queries, document_queries, graph_queries, map_queries, office_queries, reader_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL: dict[str, str] = {name: s for m in _MODULES for name, s in m.SQL.items()}
