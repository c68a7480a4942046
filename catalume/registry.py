"""Every catalog query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import file_queries, index_queries, more_queries, scalar_queries, search_queries
from .sources.catalog import Catalog


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = search_queries.SPARK | scalar_queries.SPARK | more_queries.SPARK | index_queries.SPARK | file_queries.SPARK
    return {name: lambda spark, sf_dir, f=f: f(Catalog(spark, sf_dir)) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    return search_queries.SQL | scalar_queries.SQL | more_queries.SQL | index_queries.SQL | file_queries.SQL
