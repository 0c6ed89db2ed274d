"""How a module of plans registers its queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def registration() -> tuple[dict[str, Query], dict[str, str], Callable]:
    """Queries by name, SQL by name, and a decorator that adds to both."""
    queries: dict[str, Query] = {}
    sqls: dict[str, str] = {}

    def query(name: str, sql: str | None = None, zero: tuple[str, ...] = ()):
        """Register a query; in the columns of ``zero``, which rounding may turn into a negative zero, zero has no sign."""

        def add(f: Query) -> Query:
            queries[name] = (lambda spark, d: f(spark, d).withColumns({c: F.when(F.col(c) == 0, 0.0).otherwise(F.col(c)) for c in zero})) if zero else f
            if sql:
                plain = ", ".join(f"CASE WHEN {c} = 0 THEN 0 ELSE {c} END AS {c}" for c in zero)
                sqls[name] = f"SELECT * REPLACE ({plain}) FROM ({sql})" if zero else sql
            return f

        return add

    return queries, sqls, query
