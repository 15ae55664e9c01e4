"""All queries of the core, by name, and their SQL. Importing the modules of queries fills the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import cells, details, registry, sources, surfaces, survey

__all__ = ["cells", "details", "oracle_sql", "queries", "sources", "surfaces"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return survey.queries() | registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return survey.oracle_sql() | registry.SQL
