"""The queries of the engine, one for each operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def all_queries() -> tuple[dict[str, Query], dict[str, str]]:
    from . import documents, governance, graph, profiling, relational, retrieval

    queries: dict[str, Query] = {}
    sql: dict[str, str] = {}
    for module in (relational, governance, profiling, documents, retrieval, graph):
        queries |= module.QUERIES
        sql |= module.ORACLE_SQL
    return queries, sql
