"""The registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with the SQL that gives the same rows where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def share(part: Column | str, of: Column | None = None) -> Column:
    """A share of counts, or one that is null where nothing was counted, as the SQL has it: NaN of nothing."""
    return F.coalesce(part if of is None else F.try_divide(part, of), F.lit(float("nan")))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """All doubles rounded, so that results don't depend on the order of sums."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
