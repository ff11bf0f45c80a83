"""All queries of the core, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.plans import chunk_queries, layout_queries, search_queries, table_queries, training_data

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, Callable[[], str]] = {}
for module in (chunk_queries, layout_queries, search_queries, table_queries, training_data):
    QUERIES |= module.QUERIES
    SQL |= module.SQL
