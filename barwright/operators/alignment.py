"""Joins of series on dates: inner, left, as-of and range.

Every join is an equi-join on (symbol, date) or on date, so Spark may pick a
broadcast when its own size check passes and a shuffle join otherwise. No side is
forced to be broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from barwright.functions.series import by_date, by_date_desc, dealt, log_ratio, series_by


def complete_dates(series: DataFrame, assets: int) -> DataFrame:
    """Dates on which all ``assets`` series of (asset, date, value) have a value."""
    return (
        series.filter(F.col("value").isNotNull())
        .groupBy("date")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") == assets)
        .select("date")
    )


def asset_returns(series: DataFrame) -> DataFrame:
    """Log return of each asset over its own previous date, in long form."""
    w = series_by("asset")
    value, before = F.col("value"), F.lag("value").over(w)
    return series.select("asset", "date", log_ratio(value, before).alias("ret"))


def inner_align(left: DataFrame, right: DataFrame, keys=("symbol", "date")) -> DataFrame:
    return left.join(right, list(keys), "inner")


def reindex(series: DataFrame, dates: DataFrame, keys=("symbol", "date")) -> DataFrame:
    """Put a series on another set of dates; dates without a value become NULL."""
    return dates.join(series, list(keys), "left")


def latest_before(bars: DataFrame, requested: DataFrame, value: str = "close", tasks: int | None = None) -> DataFrame:
    """Last ``value`` strictly before each requested (symbol, date).

    One union and one window instead of a range join: each request row looks back
    over the bars that sort before it. Bars of the same day sort after the request.
    ``tasks`` is how many the series are dealt to; the session's own number where it is None.
    """
    marks = requested.select("symbol", "date", F.lit(None).cast("double").alias("v"), F.lit(0).alias("kind"))
    known = bars.select("symbol", "date", F.col(value).cast("double").alias("v"), F.lit(1).alias("kind"))
    w = series_by("symbol").orderBy("date", "kind").rowsBetween(Window.unboundedPreceding, -1)
    both = dealt(marks.unionByName(known), tasks, "symbol").withColumn(f"last_{value}", F.last("v", ignorenulls=True).over(w))
    return both.filter("kind = 0").select("symbol", "date", f"last_{value}")


def carry_forward(bars: DataFrame, gaps: DataFrame, max_days: int = 5, tasks: int | None = None) -> DataFrame:
    """Bars for short empty ranges: all prices the last close, volume 0, weekdays only."""
    short = gaps.filter(F.datediff("range_end", "range_start") <= max_days)
    days = short.select("symbol", F.explode(F.sequence("range_start", "range_end")).alias("date")).filter(
        F.weekday("date") < 5
    )
    filled = latest_before(bars, days, tasks=tasks).filter(F.col("last_close").isNotNull())
    price = F.col("last_close")
    return filled.select(
        "symbol", "date", price.alias("open"), price.alias("high"), price.alias("low"), price.alias("close"),
        F.lit(0).cast("bigint").alias("volume"),
    )


def interpolate(series: DataFrame, value: str) -> DataFrame:
    """Fill NULLs by time-weighted blending of the neighbours, then outwards from the ends."""
    back = by_date().rowsBetween(Window.unboundedPreceding, 0)
    ahead = by_date_desc().rowsBetween(Window.unboundedPreceding, 0)
    v = F.col(value)
    stamp = F.when(v.isNotNull(), F.col("date"))
    df = series.select(
        "*",
        F.last(v, True).over(back).alias("_pv"),
        F.last(stamp, True).over(back).alias("_pd"),
        F.last(v, True).over(ahead).alias("_nv"),
        F.last(stamp, True).over(ahead).alias("_nd"),
    )
    moved = (F.col("_nv") - F.col("_pv")) * F.datediff("date", "_pd")
    blended = F.col("_pv") + F.try_divide(moved, F.datediff("_nd", "_pd").cast("double"))
    return df.withColumn(value, F.coalesce(v, blended, F.col("_pv"), F.col("_nv"))).drop("_pv", "_pd", "_nv", "_nd")


def date_alignment(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Every (symbol, date) of either side, marked common, features_only or targets_only."""
    f = features.select("symbol", "date").withColumn("in_features", F.lit(True))
    t = targets.select("symbol", "date").withColumn("in_targets", F.lit(True))
    both = f.join(t, ["symbol", "date"], "full_outer")
    return both.select(
        "symbol",
        "date",
        F.when(F.col("in_features") & F.col("in_targets"), "common")
        .when(F.col("in_features"), "features_only")
        .otherwise("targets_only")
        .alias("side"),
    )
