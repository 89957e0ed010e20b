"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name, and their oracle SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str | None = None) -> None:
        self.queries[name] = query
        if sql:
            self.sql[name] = sql

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        def wrap(f: Query) -> Query:
            self.add(name or f.__name__, f, sql)
            return f

        return wrap
