"""Every operator as a query over the given tables, with the same question in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
ENTRIES: dict[str, tuple[Query, str | None]] = {}


def entry(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query and, where SQL can ask it over whole tables, the SQL."""

    def add(query: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"duplicate entry {name}")
        ENTRIES[name] = (query, sql)
        return query

    return add


def load() -> dict[str, tuple[Query, str | None]]:
    from predia.registry import (  # noqa: F401
        aggregation, catalogue, filtering, gates, joining, matching, orchestration, scalars,
        sources, valuation, windows_sets, zones,
    )

    return ENTRIES
