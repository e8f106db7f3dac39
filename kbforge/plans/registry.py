"""All registered queries of the library and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics_queries, chunk_queries, graph_queries, more_queries, search_queries, stream_queries, table_queries, text_queries

MODULES = [text_queries, chunk_queries, search_queries, graph_queries, analytics_queries, table_queries, stream_queries, more_queries]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


QUERY_NAMES = [name for module in MODULES for name in module.QUERIES]
