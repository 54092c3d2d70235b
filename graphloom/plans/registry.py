"""All queries over the given tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code_queries, file_queries, graph_queries, index_queries, scan_queries, search_queries, upkeep_queries

MODULES = (file_queries, graph_queries, search_queries, code_queries, scan_queries, index_queries, upkeep_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
