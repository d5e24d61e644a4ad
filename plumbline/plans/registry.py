"""All queries of the ranking engine by name, and their DuckDB SQL."""

from __future__ import annotations

from . import choice_queries, pool_queries, rank_queries, report_queries, text_queries

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in (text_queries, choice_queries, rank_queries, report_queries, pool_queries):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
