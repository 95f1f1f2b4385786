"""Registered queries of the library's own operators and their DuckDB equivalents."""

from __future__ import annotations

from gridspark.plans import cell_queries, document_queries, relation_queries, retrieval_queries, source_queries, sourcing_queries, table_queries

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for module in (cell_queries, table_queries, relation_queries, retrieval_queries, source_queries, sourcing_queries, document_queries):
    QUERIES |= module.REGISTER.queries
    ORACLE_SQL |= module.REGISTER.sql

FLAGSHIP = QUERIES["hybrid_rank"]
