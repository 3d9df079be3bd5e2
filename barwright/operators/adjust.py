"""Split back-adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

PRICES = ["open", "high", "low", "close"]


def split_factors(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Product of the ratios of all splits after each bar.

    Splits are interleaved with the bars of their symbol and summed latest first
    in logarithms: one running window in place of a range join. A split on the day of a bar
    does not touch that bar.
    """
    b = bars.select("symbol", "date", F.lit(1).alias("kind"), F.lit(0.0).alias("ln_ratio"))
    s = splits.filter("ratio > 0").select(
        "symbol", F.col("split_date").alias("date"), F.lit(0).alias("kind"), F.log("ratio").alias("ln_ratio")
    )
    latest_first = Window.partitionBy("symbol").orderBy(F.col("date").desc(), F.col("kind").desc())
    later = latest_first.rowsBetween(Window.unboundedPreceding, -1)
    both = b.unionByName(s).withColumn("factor", F.exp(F.coalesce(F.sum("ln_ratio").over(later), F.lit(0.0))))
    return both.filter("kind = 1").select("symbol", "date", "factor")


def back_adjusted(bars: DataFrame, splits: DataFrame) -> DataFrame:
    """Prices divided and volume multiplied by the factor; a pure column, so safe to repeat."""
    out = bars.join(split_factors(bars, splits), ["symbol", "date"])
    return out.select(
        "symbol",
        "date",
        *[(F.col(c) / F.col("factor")).alias(c) for c in PRICES],
        (F.col("volume") * F.col("factor")).alias("volume"),
        "factor",
    )
