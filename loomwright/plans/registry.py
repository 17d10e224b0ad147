"""All queries of the engine proper, by name, with their DuckDB oracles."""

from __future__ import annotations

from . import index_queries, likeness_queries, series_queries, source_queries, text_queries, vector_queries

_MODULES = (vector_queries, series_queries, text_queries, index_queries, source_queries, likeness_queries)


def queries() -> dict:
    return {k: v for m in _MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in _MODULES for k, v in m.ORACLES.items()}
