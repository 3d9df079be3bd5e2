"""Coercion, validation and quality reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import finite
from barwright.operators import calendar as cal
from barwright.operators.distribution import duplicate_keys, null_counts
from barwright.schema import TENORS

OHLCV = ["open", "high", "low", "close", "volume"]


def coerced(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to numbers where it reads as one, then drop rows with any NULL among ``columns``."""
    typed = df.withColumns({c: F.col(c).try_cast("double") for c in columns})
    return typed.dropna(subset=columns)


def valid_stock_bars(df: DataFrame) -> DataFrame:
    """Zero prices become NULL, missing volume 0; only a positive close is kept."""
    prices = {c: F.nullif(F.col(c).try_cast("double"), F.lit(0.0)) for c in ("open", "high", "low", "close")}
    out = df.withColumns({**prices, "volume": F.coalesce("volume", F.lit(0)).cast("bigint")})
    return out.filter(F.col("close") > 0)


def valid_index_bars(df: DataFrame) -> DataFrame:
    """As for stocks, but a zero price stays zero."""
    prices = {c: F.col(c).try_cast("double") for c in ("open", "high", "low", "close")}
    out = df.withColumns({**prices, "volume": F.coalesce("volume", F.lit(0)).cast("bigint")})
    return out.filter(F.col("close") > 0)


def valid_yields(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(*TENORS).isNotNull())


def eligible_stocks(stocks: DataFrame, equities_only: bool = True) -> DataFrame:
    out = stocks.filter("is_active")
    if equities_only:
        out = out.filter((F.col("quotetype") == "EQUITY") & F.col("sector").isNotNull())
    return out.select("symbol", "company_name", "sector", "industry")


# Fixed value: the accepted form of a symbol.
SYMBOL_PATTERN = "^[A-Z0-9.-]+$"


def invalid_symbols(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("symbol").rlike(SYMBOL_PATTERN))


def stale(df: DataFrame, asof: Column, days: int = 365) -> DataFrame:
    return df.filter(F.col("last_updated") < asof - F.expr(f"INTERVAL {days} DAYS"))


def inactive(df: DataFrame) -> DataFrame:
    return df.filter(~F.col("is_active"))


def is_inconsistent() -> Column:
    low, high, o, c = (F.col(x) for x in ("low", "high", "open", "close"))
    return (low > o) | (c > high) | (low > c) | (o > high)


def repeated_symbols(df: DataFrame, order: str) -> DataFrame:
    """Second and later rows of each symbol.

    The first row of a symbol is found by a partially combined minimum and the rest
    by an equi-join, so no symbol has to be gathered and sorted in one task.
    """
    first = df.groupBy("symbol").agg(F.min(order).alias("_first"))
    return df.join(first, "symbol").filter(F.col(order) > F.col("_first")).drop("_first")


def clean_text(c: str) -> Column:
    """Trimmed title case; words start after any character that is not a letter."""
    spaced = F.initcap(F.regexp_replace(F.trim(c), "([^A-Za-z]+)", "\u0001$1\u0002 "))
    return F.regexp_replace(spaced, "\u0002 |\u0001", "")


def first_rows(df: DataFrame, order: str, k: int, key: str = "symbol") -> DataFrame:
    """First ``k`` rows of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= k).drop("_rn")


def missing_date_report(bars: DataFrame, kind: str = "calendar") -> DataFrame:
    """Expected, missing and listed dates of each symbol between its own first and last."""
    spans = cal.span_of(bars, "symbol")
    total = cal.days(spans, kind).groupBy("symbol").agg(F.count("*").alias("total_dates"))
    gone = cal.missing_days(bars, spans, kind).groupBy("symbol").agg(
        F.count("*").alias("missing_dates"), F.min("date").alias("first_missing"), F.max("date").alias("last_missing")
    )
    return total.join(gone, "symbol", "left").select(
        "symbol", "total_dates", F.coalesce("missing_dates", F.lit(0)).alias("missing_dates"), "first_missing", "last_missing"
    )


def consistency_report(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Repeated keys and NULLs per column in long form. ``keys=['date']`` is the legacy check."""
    repeats = duplicate_keys(df, keys).agg(F.count("*").alias("value")).select(
        F.lit("duplicate_keys").alias("item"), "value"
    )
    nulls = null_counts(df, columns).select(F.concat(F.lit("nulls_"), "column").alias("item"), F.col("nulls").alias("value"))
    return repeats.unionByName(nulls)


def quality_checks(loaders: dict[str, tuple[DataFrame, list[str], str, list[str]]]) -> DataFrame:
    """All three checks of several loaders as one long table, in two passes over each.

    Each loader is (rows, key columns, measured column, columns to count NULLs in). The
    first pass takes dates, moments and NULLs; the second counts repeated keys and the rows
    beyond three deviations, combined by key before anything is summed.
    """
    out = None
    for name, (df, keys, measure, columns) in loaders.items():
        x = F.col(measure)
        first = df.agg(
            F.struct(
                (F.datediff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date")).alias("missing"),
                F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.count(x).alias("n"),
                *[F.sum(F.col(c).isNull().cast("long")).alias(f"nulls_{c}") for c in columns],
            ).alias("first")
        ).scalar()
        by_key = df.withColumn("_first", first).groupBy(*keys).agg(
            F.count("*").alias("n"),
            F.sum((F.abs(x - F.col("_first.mean")) > 3 * F.col("_first.std")).cast("long")).alias("far"),
        )
        second = by_key.agg(F.sum((F.col("n") > 1).cast("long")).alias("repeated"), F.sum("far").alias("far"))
        both = second.withColumn("first", first)
        far = F.coalesce("far", F.lit(0))
        items = {
            "missing_dates": F.col("first.missing"), "mean": F.col("first.mean"), "std_dev": F.col("first.std"),
            "outlier_count": far, "outlier_percentage": F.try_divide(far, F.col("first.n")) * 100,
            "duplicate_keys": F.coalesce("repeated", F.lit(0)), **{f"nulls_{c}": F.col(f"first.nulls_{c}") for c in columns},
        }
        long = F.inline(F.array(*[F.struct(F.lit(i).alias("item"), v.cast("double").alias("value")) for i, v in items.items()]))
        part = both.select(long).withColumn("loader", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def guarded_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN and infinities to NULL."""
    return df.withColumns({c: finite(F.col(c)) for c in columns})


def guard_report(df: DataFrame, columns: list[str], *keys: str) -> DataFrame:
    """(keys, rows, values per column, status): whether a feature frame can be used.

    NaN and infinities count as missing. ``status`` is `ok`, `empty` where there are no rows
    (only without keys, as a key without rows is not there), or names the columns without any
    value, comma-joined, behind `all missing`.
    """
    counts = df.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count(finite(F.col(c))).alias(f"values_{c}") for c in columns])
    lost = F.filter(F.array(*[F.when(F.col(f"values_{c}") == 0, F.lit(c)) for c in columns]), lambda c: c.isNotNull())
    status = F.when(F.col("rows") == 0, "empty").when(F.size(lost) > 0, F.concat(F.lit("all missing: "), F.array_join(lost, ","))).otherwise("ok")
    return counts.withColumn("status", status)


def require_columns(df: DataFrame, columns=("date", "close")) -> DataFrame:
    """Raise when a needed column is missing."""
    lost = [c for c in columns if c not in df.columns]
    if lost:
        raise ValueError(f"missing columns: {', '.join(lost)}")
    return df


def frame_report(df: DataFrame, *keys: str, columns=("date", "close")) -> DataFrame:
    """Rows of each key, how many values each needed column has, and whether all have as many and any."""
    counts = require_columns(df, columns).groupBy(*keys).agg(F.count("*").alias("rows"), *[F.count(c).alias(f"{c}s") for c in columns])
    names = [f"{c}s" for c in columns]
    equal = F.greatest(*names) == F.least(*names)
    return counts.withColumns({"equal_lengths": equal, "empty": F.greatest(*names) == 0})


# Accepted names of the close column, first match wins.
CLOSE_NAMES = ["Close", "close", "Adj Close", "adj_close"]


def close_column(df: DataFrame) -> str:
    for name in CLOSE_NAMES:
        if name in df.columns:
            return name
    raise ValueError("no close column")


def observed(df: DataFrame, name: str, columns: list[str]):
    """Attach row, NULL and date-range metrics that are filled when ``df`` is written."""
    from pyspark.sql import Observation

    seen = Observation(name)
    metrics = [F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")]
    metrics += [F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns]
    return df.observe(seen, *metrics), seen


def price_window(bars: DataFrame, marks: DataFrame, mark: str, before: int = 7, after: int = 7) -> DataFrame:
    """Bars within some days of a marked date of the same symbol, flagging the date itself.

    Each mark is spread over the few dates of its window, which makes an equi-join
    on (symbol, date) of what would be a range join.
    """
    spread = marks.select(
        "symbol", mark, F.explode(F.sequence(F.date_sub(mark, before), F.date_add(mark, after))).alias("date")
    )
    out = bars.join(spread, ["symbol", "date"])
    return out.select("symbol", mark, "date", *OHLCV, (F.col("date") == F.col(mark)).alias("is_mark"))


def text_search(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Case-insensitive substring match in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.lower(c).contains(text.lower())
    return df.filter(hit)
