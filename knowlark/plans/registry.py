"""Registered queries over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from knowlark.plans import graph_queries, search_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]
PARTS = (search_queries, table_queries, graph_queries)
SMALLEST = "/root/testdata/sf0.001"


def entry(spark: SparkSession) -> DataFrame:
    return search_queries.bm25_search(spark, SMALLEST)


def queries() -> dict[str, Query]:
    return {name: q for part in PARTS for name, q in part.QUERIES_OF.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.SQL.items()}
