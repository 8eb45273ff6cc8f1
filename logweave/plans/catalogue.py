"""The registered queries and their SQL."""

from __future__ import annotations

from . import flow_queries, log_queries, table_queries

_PARTS = (log_queries, table_queries, flow_queries)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
