"""Names of all queries over the reference-style operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.queries import evaluation_queries, extension_queries, interval_queries, plan_queries, sequence_queries, statistic_queries

MODULES = (interval_queries, sequence_queries, statistic_queries, plan_queries, extension_queries, evaluation_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
