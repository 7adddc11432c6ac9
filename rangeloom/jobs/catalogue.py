"""The registered queries over sequence graphs and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import archive_queries, audit_queries, exchange_queries, graph_queries, index_queries, stream_queries, verify_queries, walk_queries

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (archive_queries, walk_queries, graph_queries, index_queries, audit_queries, exchange_queries, verify_queries, stream_queries)


def queries() -> dict[str, Query]:
    return {name: query for module in MODULES for name, (query, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, (_, sql) in module.QUERIES.items() if sql}
