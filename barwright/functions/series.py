"""Window specs and guarded rolling aggregates shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def by_date():
    """Rows of one series in date order.

    Equal specs share a single sort. A partition is one series and holds at most one
    row per trading day, because the panel is keyed on (symbol, date).
    """
    return Window.partitionBy("symbol").orderBy("date")


def by_date_desc():
    """Latest first: a look ahead is a running frame here, where a frame that reaches
    to the end of the series would be evaluated anew for every row."""
    return Window.partitionBy("symbol").orderBy(F.col("date").desc())


def whole():
    """All rows of one series."""
    return Window.partitionBy("symbol")


def series_by(*keys: str):
    return Window.partitionBy(*keys).orderBy("date")


def trailing(n: int, spec=None):
    return (spec or by_date()).rowsBetween(-(n - 1), 0)


def rolling(agg: Column, counted: Column | str, n: int, spec=None) -> Column:
    """Rolling aggregate that is NULL until ``n`` non-null values are in the frame."""
    frame = trailing(n, spec)
    return F.when(F.count(counted).over(frame) == n, agg.over(frame))


def prev(col: str, k: int = 1, spec=None) -> Column:
    return F.lag(col, k).over(spec or by_date())


def dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    """``df`` by ``keys`` over ``n`` tasks; as it is where ``n`` is None."""
    return df if n is None else df.repartition(n, *keys)


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def simple_return(close: str = "close", k: int = 1, spec=None) -> Column:
    return F.try_divide(F.col(close), prev(close, k, spec)) - 1


def log_ratio(a: Column, b: Column, floor: float = 0.0) -> Column:
    """ln(a/b) where both exceed ``floor``, else NULL."""
    return F.when((a > floor) & (b > floor), F.log(a / b))


def log_return(close: str = "close", k: int = 1, spec=None, floor: float = 0.0) -> Column:
    return log_ratio(F.col(close), prev(close, k, spec), floor)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL."""
    inf = F.lit(float("inf"))
    return F.when(~F.isnan(c) & (F.abs(c) != inf), c)
