"""Registry of the queries this package answers on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"query {name} registered twice")
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


def tidy(df: DataFrame, digits: int = 4, **per_column: int) -> DataFrame:
    """Output form: doubles rounded, booleans as 0/1, dates as text, counts as long."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, per_column.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.BooleanType, T.IntegerType, T.ShortType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("|", c)
        cols.append(c.alias(f.name))
    return df.select(*cols)
