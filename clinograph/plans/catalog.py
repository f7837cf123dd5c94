"""The registered queries of the evaluation operators and their DuckDB SQL.

A query's name begins with the number of the operator it shows.  All read whole tables.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with SQL where there is some."""

    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[make.__name__] = make
        if sql:
            ORACLE_SQL[make.__name__] = sql
        return make

    return add


def rounded(df: DataFrame, /, **digits: int) -> DataFrame:
    """The named columns as doubles of so many digits, which sums in another order don't change."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), n) for c, n in digits.items()})


def long(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


from . import daily_queries, field_queries, member_queries, source_queries, table_queries  # noqa: E402, F401  they register themselves
