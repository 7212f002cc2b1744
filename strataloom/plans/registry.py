"""Where queries are registered with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.plans.bind import sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def paged(body: str, top: int, order: str) -> str:
    """DuckDB SQL of a bounded answer over the rows of ``body``."""
    n = "(SELECT count(*) FROM every_row)"
    return f"""WITH every_row AS ({body}) SELECT *, {n} AS total, least({top}, {n}) AS returned, {n} > {top} AS truncated, CASE WHEN {n} > {top} THEN 'top' END AS truncation_reason
    FROM every_row ORDER BY {order} LIMIT {top}"""


def query(tables: str = "", body: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name; ``body`` is DuckDB SQL over the bound relations named in ``tables``."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLES[f.__name__] = sql(tables, body)
        return f

    return add
