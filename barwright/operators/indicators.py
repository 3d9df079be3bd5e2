"""Return, range and moving-average columns of the bar panel.

Each function adds columns built on the same window spec, so a chain of them costs
one shuffle on symbol and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import by_date, log_return, prev, rolling, simple_return, trailing, whole

# Windows of the momentum, average and band measures.
ROC_WINDOWS = [5, 10, 20, 60, 120]
MA_WINDOWS = [10, 20, 50, 200]


def returns(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"simple_return": simple_return(), "log_return": log_return()})


def rate_of_change(bars: DataFrame, windows=ROC_WINDOWS) -> DataFrame:
    """Change over n rows as a fraction."""
    return bars.withColumns({f"roc_{n}d": simple_return(k=n) for n in windows})


def rate_of_change_percent(bars: DataFrame, window: int = 20) -> DataFrame:
    before = prev("close", window)
    return bars.withColumn(f"roc_pct_{window}d", F.try_divide(F.col("close") - before, before) * 100)


def gap_percent() -> Column:
    before = prev("close")
    return F.try_divide(F.col("open") - before, before) * 100


def gaps(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"gap": F.col("open") - prev("close"), "gap_pct": gap_percent()})


def true_range(skip_nulls: bool = True) -> Column:
    """Largest of high-low and the distances of both to the previous close.

    With ``skip_nulls`` the first row is its high-low range, else it is NULL.
    """
    high, low, before = F.col("high"), F.col("low"), prev("close")
    widest = F.greatest(high - low, F.abs(high - before), F.abs(low - before))
    return widest if skip_nulls else F.when(before.isNotNull(), widest)


def average_true_range(bars: DataFrame, window: int = 14, smooth: int = 5) -> DataFrame:
    """ATR, its centred smoothing, and both as a percentage of the close."""
    atr, norm = f"atr_{window}d", "atr_normalized"
    half = smooth // 2
    centre = by_date().rowsBetween(-half, half)

    def centred(name: str) -> Column:
        return F.when(F.count(name).over(centre) == smooth, F.avg(name).over(centre))

    return (
        bars.withColumn("true_range", true_range())
        .withColumn(atr, rolling(F.avg("true_range"), "true_range", window))
        .withColumn(norm, F.try_divide(F.col(atr), F.when(F.col("close") > 0, F.col("close"))) * 100)
        .withColumns({f"{atr}_smoothed": centred(atr), f"{norm}_smoothed": centred(norm)})
    )


def atr_bands(bars: DataFrame, window: int = 14) -> DataFrame:
    """Close plus and minus ATR, with a true range that is NULL on the first row."""
    return (
        bars.withColumn("_tr", true_range(skip_nulls=False))
        .withColumn("_atr", rolling(F.avg("_tr"), "_tr", window))
        .withColumns({"atr_upper": F.col("close") + F.col("_atr"), "atr_lower": F.col("close") - F.col("_atr")})
        .drop("_tr", "_atr")
    )


def moving_averages(bars: DataFrame, windows=MA_WINDOWS) -> DataFrame:
    return bars.withColumns({f"ma_{n}": rolling(F.avg("close"), "close", n) for n in windows})


def bollinger(bars: DataFrame, window: int = 20, width: float = 2, ddof: int = 1) -> DataFrame:
    """Mean and bands; ``ddof=1`` is the sample, ``ddof=0`` the population deviation."""
    sigma = F.stddev_samp("close") if ddof else F.stddev_pop("close")
    mid, dev = rolling(F.avg("close"), "close", window), rolling(sigma, "close", window)
    return bars.withColumns({"bb_mid": mid, "bb_high": mid + width * dev, "bb_low": mid - width * dev})


def volume_metrics(bars: DataFrame, window: int = 21) -> DataFrame:
    """Volume change, volume over its trailing mean (from one row on) and dollar volume."""
    df = bars.withColumn("_v", F.nullif(F.col("volume"), F.lit(0)))
    return df.withColumns(
        {
            "volume_change": simple_return("_v"),
            "volume_normalized": F.try_divide(F.col("_v"), F.avg("_v").over(trailing(window))),
            "dollar_volume": F.col("close") * F.col("volume"),
        }
    ).drop("_v")


def candle_metrics(bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumns(
        {
            "body_size_norm": F.try_divide(F.abs(o - c), c),
            "upper_shadow_norm": F.try_divide(h - F.greatest(o, c), c),
            "lower_shadow_norm": F.try_divide(F.least(o, c) - l, c),
            "close_position": close_position_or_middle(),
        }
    )


def close_position_clipped() -> Column:
    """Position of the close in the range, by an epsilon division clipped to [0, 1]."""
    raw = (F.col("close") - F.col("low")) / (F.col("high") - F.col("low") + F.lit(1e-10))
    return F.when(raw.isNotNull(), F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def close_position_or_null() -> Column:
    """Position of the close in the range; NULL for a flat bar."""
    return F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low"))


def close_position_or_middle() -> Column:
    """Position of the close in the range; 0.5 for a flat bar."""
    return F.coalesce(F.try_divide(F.col("close") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.5))


def return_metrics(bars: DataFrame) -> DataFrame:
    step = simple_return()
    return bars.withColumns(
        {
            "log_return": log_return(),
            "abs_return": F.abs(step),
            "sq_return": step * step,
            "range_return_open": F.try_divide(F.col("high") - F.col("low"), F.col("open")),
        }
    )


def _positive_log(a: str, b: str) -> Column:
    return F.when((F.col(a) > 0) & (F.col(b) > 0), F.log(F.col(a) / F.col(b)))


def _floor_zero(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(0.0)))


def range_volatility(bars: DataFrame) -> DataFrame:
    """Range over close, true range, Garman-Klass and Rogers-Satchell per bar."""
    hl, co = _positive_log("high", "low"), _positive_log("close", "open")
    rs = _positive_log("high", "close") * _positive_log("high", "open") + _positive_log("low", "close") * _positive_log(
        "low", "open"
    )
    return bars.withColumns(
        {
            "price_range_norm": F.try_divide(F.col("high") - F.col("low"), F.col("close")),
            "true_range": true_range(skip_nulls=False),
            "vol_garman_klass": _floor_zero(0.5 * hl * hl - (2 * F.log(F.lit(2.0)) - 1) * co * co),
            "vol_rogers_satchell": _floor_zero(rs),
        }
    )


def derived_metrics(bars: DataFrame) -> DataFrame:
    """All fifteen derived columns, keyed by symbol and date."""
    out = range_volatility(return_metrics(candle_metrics(volume_metrics(bars))))
    return out.drop("open", "high", "low", "close", "volume")


# Gap classes in reading order.
GAP_CLASSES = ["Large Down (<=-1%)", "Small Down (-1% to 0%)", "No Gap (0%)", "Small Up (0% to 1%)", "Large Up (>1%)"]


def gap_class(gap: Column) -> Column:
    down_far, down, none, up, up_far = GAP_CLASSES
    return (
        F.when(gap <= -1, down_far)
        .when(gap < 0, down)
        .when(gap.isNull() | (gap == 0), none)
        .when(gap <= 1, up)
        .otherwise(up_far)
    )


def gap_events(bars: DataFrame) -> DataFrame:
    """Gap, whether the day traded back to the previous close, and the intraday move.

    Marker size is the root of volume over the largest volume of the series, times 50.
    """
    before = prev("close")
    df = bars.withColumns({"gap_pct": gap_percent(), "_pc": before})
    filled = F.when(F.col("gap_pct") > 0, F.col("low") <= F.col("_pc")).otherwise(F.col("high") >= F.col("_pc"))
    return df.withColumns(
        {
            "gap_filled": F.when(F.col("_pc").isNotNull(), filled),
            "intraday_move": F.try_divide(F.col("close") - F.col("open"), F.col("open")) * 100,
            "marker_size": F.sqrt(F.try_divide(F.col("volume"), F.max("volume").over(whole()))) * 50,
            "gap_class": gap_class(F.col("gap_pct")),
        }
    ).drop("_pc")


def trendlines(bars: DataFrame, epsilon: float = 1e-10) -> DataFrame:
    """Linear trend of the close and exponential trend of its logarithm by row number."""
    df = bars.withColumn("x", (F.row_number().over(by_date()) - 1).cast("double")).withColumn(
        "_ly", F.log(F.col("close") + F.lit(epsilon))
    )
    every = whole()
    n = F.count("close").over(every)
    fits = {
        "linear_trend": F.regr_intercept("close", "x").over(every) + F.regr_slope("close", "x").over(every) * F.col("x"),
        "exp_trend": F.exp(F.regr_intercept("_ly", "x").over(every) + F.regr_slope("_ly", "x").over(every) * F.col("x")),
    }
    return df.withColumns({k: F.when(n >= 2, v) for k, v in fits.items()}).drop("x", "_ly")


def elapsed_days() -> Column:
    return F.datediff("date", F.min("date").over(Window.partitionBy("symbol")))


def intraday_change(bars: DataFrame) -> DataFrame:
    """Change from open to close in percent with a two-decimal text, and the up/down flag."""
    change = F.when(
        F.col("open").isNotNull() & F.col("close").isNotNull() & (F.col("open") != 0),
        (F.col("close") - F.col("open")) / F.col("open") * 100,
    )
    df = bars.withColumn("change_pct", change)
    return df.withColumns(
        {
            "change_text": F.concat(F.round("change_pct", 2).cast("decimal(20,2)").cast("string"), F.lit("%")),
            "is_up": F.col("close") > F.col("open"),
        }
    )
