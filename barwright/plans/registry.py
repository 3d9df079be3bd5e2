"""Named queries and, where SQL can say it, the statement each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with the SQL it is checked against."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tidy(df: DataFrame, digits: int = 6, significant: tuple[str, ...] = (), exact: tuple[str, ...] = (), **special: int) -> DataFrame:
    """Round every double column, so that sums taken in another order agree.

    Columns of ``significant`` keep nine significant digits, whatever their size; those of
    ``exact`` come from the same few operations in any engine and stay as they are.
    """
    cols = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in exact:
            pass
        elif field.name in significant:
            c = F.format_string("%.8e", c).cast("double").alias(field.name)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = (F.round(c.cast("double"), special.get(field.name, digits)) + F.lit(0.0)).alias(field.name)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint").alias(field.name)
        cols.append(c)
    return df.select(*cols)
