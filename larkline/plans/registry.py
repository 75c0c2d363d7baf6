"""Where queries and their oracle SQL are kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Named queries, each with the SQL of the same result where SQL can say it."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None, longs: tuple[str, ...] = ()) -> Callable[[Query], Query]:
        """Register a query; ``longs`` are result columns that SQL sums to a wider type than 64 bits."""
        if sql is not None and longs:
            sql = f"select * replace ({', '.join(f'cast({c} as bigint) as {c}' for c in longs)}) from ({sql})"

        def keep(f: Query) -> Query:
            if name in self.queries:
                raise ValueError(f"{name} is registered twice")
            self.queries[name] = f
            if sql is not None:
                self.oracles[name] = sql
            return f

        return keep
