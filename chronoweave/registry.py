"""Queries of the library's own operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.sources.graph_tables import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``f(tables)`` under its name, with the SQL that gives the same rows where there is one."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql)
        return f

    return keep


def load() -> None:
    """Import the modules that register queries."""
    from chronoweave.queries import causal, core, graph, resolution, text  # noqa: F401


load()
