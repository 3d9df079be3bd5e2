"""Incremental loads as one plan each: expected days, stored days, landed rows, merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.operators import calendar as cal
from barwright.operators.upsert import fold_bars, upsert_bars


def day_after_latest(stored: DataFrame, symbols: DataFrame, start: Column) -> DataFrame:
    """First date to load per symbol: the day after its latest bar, or ``start`` when it has none."""
    latest = stored.groupBy("symbol").agg(F.max("date").alias("latest"))
    return symbols.select("symbol").join(latest, "symbol", "left").select(
        "symbol", F.coalesce(F.date_add("latest", 1), start).alias("first_date")
    )


def last_day(landed: DataFrame) -> Column:
    """The as-of date of a load: the last day that has landed."""
    return landed.agg(F.max("date")).scalar()


def wanted_days(stored: DataFrame, symbols: DataFrame, start: Column, end: Column, tail_only: bool) -> DataFrame:
    """Trading days to load: after the latest bar only, or every one not stored."""
    if tail_only:
        spans = day_after_latest(stored, symbols, start)
    else:
        spans = symbols.select("symbol", start.alias("first_date"))
    return cal.missing_days(stored, spans.withColumn("last_date", end), "trading")


def refresh(stored: DataFrame, landed: DataFrame, wanted: DataFrame, order: list[str], asof: Column | None = None) -> DataFrame:
    """Merge landed rows of the wanted days, and always those of ``asof``, into the stored bars."""
    batch = landed.join(wanted.select("symbol", "date"), ["symbol", "date"], "left_semi")
    if asof is not None:
        # Today's bar may still change, so it is taken whether stored or not.
        batch = batch.unionByName(landed.filter(F.col("date") == asof)).dropDuplicates(["symbol", "date", *order])
    return upsert_bars(stored, fold_bars(batch, order).select(*stored.columns))


def not_stored(landed: DataFrame, stored: DataFrame, asof: Column) -> DataFrame:
    """Landed rows of dates that are not stored, plus all rows of ``asof``."""
    fresh = landed.join(stored.select("symbol", "date"), ["symbol", "date"], "left_anti").filter(F.col("date") != asof)
    return fresh.unionByName(landed.filter(F.col("date") == asof))


def reload(stored: DataFrame, landed: DataFrame, start: Column, end: Column) -> DataFrame:
    """Replace the rows of a date range by the landed ones."""
    inside = F.col("date").between(start, end)
    return stored.filter(~inside).unionByName(landed.filter(inside).select(*stored.columns))


def reload_last(stored: DataFrame, landed: DataFrame, n: int) -> DataFrame:
    """Replace the last ``n`` days that are stored by what has landed for them."""
    end = last_day(stored)
    return reload(stored, landed, F.date_sub(end, n - 1), end)


def received_check(spans: DataFrame, received: DataFrame) -> DataFrame:
    """Weekdays of each loaded span for which no row came."""
    return cal.missing_days(received, spans, "weekday")
