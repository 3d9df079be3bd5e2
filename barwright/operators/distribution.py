"""Grouped distributions, histograms and summaries of the panel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import simple_return, whole
from barwright.operators.indicators import GAP_CLASSES, gap_class, gap_percent, gaps


def box_stats(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Count, mean, range and quartiles of the non-null values of each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    agg = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), q.alias("_q"), F.max(value).alias("max")
    )
    quartiles = [F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(("q25", "median", "q75"))]
    return agg.select(*keys, "n", "mean", "min", *quartiles, "max")


def year_month(date: str = "date") -> Column:
    return F.date_format(date, "yyyy-MM")


def month_label(key: str = "year_month") -> Column:
    return F.date_format(F.to_date(F.concat(F.col(key), F.lit("-01"))), "MMM yyyy")


def monthly_box_stats(df: DataFrame, measures: dict[str, Column]) -> DataFrame:
    """Box statistics of several measures by month, with a label and a month rank."""
    named = df.select("symbol", year_month().alias("year_month"), *[c.alias(k) for k, c in measures.items()])
    long = named.unpivot(["symbol", "year_month"], list(measures), "measure", "value")
    out = box_stats(long, "value", "symbol", "measure", "year_month")
    return out.withColumn("month_label", month_label())


def up_down_volume(bars: DataFrame) -> DataFrame:
    """Volume on days that closed up and on days that did not; the first day is in neither."""
    step = bars.withColumn("_r", simple_return())
    side = F.when(F.col("_r") > 0, "Up Days").when(F.col("_r") <= 0, "Down Days")
    long = step.select("symbol", side.alias("category"), F.col("volume").cast("double").alias("value"))
    return box_stats(long.filter("category IS NOT NULL"), "value", "symbol", "category")


def gap_class_volume(bars: DataFrame) -> DataFrame:
    """Volume by gap class with the rank of the class in reading order."""
    df = bars.select("symbol", gap_class(gap_percent()).alias("gap_class"), F.col("volume").cast("double").alias("value"))
    out = box_stats(df, "value", "symbol", "gap_class")
    order = F.array(*[F.lit(c) for c in GAP_CLASSES])
    return out.withColumn("class_rank", F.array_position(order, F.col("gap_class")))


def _bin(value: Column, low: Column, high: Column, bins: int) -> Column:
    """Bin number on equal bins; the last bin also takes the maximum."""
    width = F.try_divide(high - low, F.lit(float(bins)))
    raw = F.floor(F.try_divide(value - low, width))
    return F.when(value.isNotNull(), F.least(F.coalesce(raw, F.lit(0)), F.lit(bins - 1))).cast("bigint")


def histogram(df: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Equal-width histogram of each symbol between its own extremes."""
    v = F.col(value)
    df = df.filter(v.isNotNull()).withColumns({"_lo": F.min(v).over(whole()), "_hi": F.max(v).over(whole())})
    return df.groupBy("symbol", "_lo", "_hi", _bin(v, F.col("_lo"), F.col("_hi"), bins).alias("bin")).agg(
        F.count("*").alias("n")
    ).select(
        "symbol",
        "bin",
        (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"),
        "n",
    )


def volume_weighted_gaps(bars: DataFrame, bins: int = 30) -> DataFrame:
    """Gap histogram with the mean volume of each bin and a width scaled by it.

    The count of the last bin includes the largest gap, its mean volume does not.
    Empty bins are kept, with volume 0.
    """
    g = gaps(bars).filter("gap_pct IS NOT NULL").withColumns(
        {"_lo": F.min("gap_pct").over(whole()), "_hi": F.max("gap_pct").over(whole())}
    )
    g = g.withColumn("bin", _bin(F.col("gap_pct"), F.col("_lo"), F.col("_hi"), bins))
    inside = F.when(F.col("gap_pct") < F.col("_hi"), F.col("volume"))
    found = g.groupBy("symbol", "bin").agg(F.count("*").alias("n"), F.avg(inside).alias("v"))
    grid = g.groupBy("symbol").agg(F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi")).withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(bins - 1).cast("bigint")))
    )
    full = grid.join(found, ["symbol", "bin"], "left").withColumns(
        {"n": F.coalesce("n", F.lit(0)), "mean_volume": F.coalesce("v", F.lit(0.0))}
    )
    return full.select(
        "symbol",
        "bin",
        (F.col("_lo") + (F.col("bin") + 0.5) * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_center"),
        "n",
        "mean_volume",
        (F.try_divide(F.col("mean_volume"), F.max("mean_volume").over(whole())) * 0.8).alias("width"),
    )


def gap_volume_grid(bars: DataFrame, edges: int = 10) -> DataFrame:
    """Joint histogram of gap and volume on ``edges`` equal edges between the 1 % and 99 % quantiles.

    Rows outside the edges are not counted, as in any histogram with given edges.
    Only cells that hold rows are listed.
    """
    cuts = F.array(F.lit(0.01), F.lit(0.99))
    df = gaps(bars).withColumn("volume", F.col("volume").cast("double"))
    df = df.withColumns(
        {"_g": F.percentile("gap_pct", cuts).over(whole()), "_v": F.percentile("volume", cuts).over(whole())}
    ).filter("gap_pct IS NOT NULL")
    lo_g, hi_g, lo_v, hi_v = F.col("_g")[0], F.col("_g")[1], F.col("_v")[0], F.col("_v")[1]
    inside = df.filter(F.col("gap_pct").between(lo_g, hi_g) & F.col("volume").between(lo_v, hi_v))
    bins = edges - 1
    return inside.groupBy(
        "symbol",
        _bin(F.col("gap_pct"), lo_g, hi_g, bins).alias("gap_bin"),
        _bin(F.col("volume"), lo_v, hi_v, bins).alias("volume_bin"),
    ).agg(F.count("*").alias("n"))


def describe(bars: DataFrame) -> DataFrame:
    """Count, mean, deviation, range and quartiles of close, volume and returns."""
    long = (
        bars.withColumn("returns", simple_return())
        .select("symbol", "close", F.col("volume").cast("double").alias("volume"), "returns")
        .unpivot(["symbol"], ["close", "volume", "returns"], "measure", "value")
    )
    spread = long.groupBy("symbol", "measure").agg(F.stddev_samp("value").alias("std"))
    return box_stats(long, "value", "symbol", "measure").join(spread, ["symbol", "measure"])


def load_summary(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Range, mean and count of columns of several loaded tables, and their date range."""
    out = None
    for name, (df, columns) in tables.items():
        typed = df.select("date", *[F.col(c).cast("double").alias(c) for c in columns])
        long = typed.unpivot(["date"], columns, "column", "value")
        one = long.groupBy("column").agg(
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            F.avg("value").alias("mean"),
            F.count("value").alias("n"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        ).withColumn("loader", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """NULLs of each column in one pass, as (column, nulls)."""
    sums = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return sums.unpivot([], columns, "column", "nulls")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def missingness(df: DataFrame, columns: list[str], keys=("symbol", "date")) -> DataFrame:
    """1 where a field is missing, per key and field; only keys with a missing field."""
    flags = df.select(*keys, *[F.col(c).isNull().cast("bigint").alias(c) for c in columns])
    some = flags.filter(sum((F.col(c) for c in columns[1:]), F.col(columns[0])) > 0)
    return some.unpivot(list(keys), columns, "field", "missing")


def outlier_counts(bars: DataFrame, columns=("open", "high", "low", "close", "volume")) -> DataFrame:
    """|z| > 3 per symbol and column with the sample deviation, taken as 1 where it is not positive."""
    cols = {}
    for c in columns:
        v = F.col(c).cast("double")
        sd = F.stddev_samp(v).over(whole())
        cols[f"_{c}"] = F.abs((v - F.avg(v).over(whole())) / F.when(sd > 0, sd).otherwise(1.0)) > 3
    flagged = bars.withColumns(cols)
    return flagged.groupBy("symbol").agg(*[F.count_if(f"_{c}").alias(f"{c}_outliers") for c in columns])


def outlier_report(df: DataFrame, column: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean, population deviation, count and share of values beyond three deviations.

    Two hash aggregations; the statistics of a key come back by a join on it.
    """
    v = F.col(column).cast("double")
    src = df.filter(v.isNotNull()).select(*keys, v.alias("v"))
    stats = src.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std_dev"), F.count("v").alias("n"))
    if keys:
        joined = src.join(stats, list(keys))
    else:
        one = stats.agg(F.struct(*[F.first(c).alias(c) for c in ("mean", "std_dev", "n")])).scalar()
        joined = src.withColumn("one", one).select("v", "one.*")
    out = joined.groupBy(*keys, "mean", "std_dev", "n").agg(
        F.count_if(F.abs(F.col("v") - F.col("mean")) > 3 * F.col("std_dev")).alias("outlier_count")
    )
    return out.select(
        *keys, "mean", "std_dev", "outlier_count", (F.col("outlier_count") / F.col("n") * 100).alias("outlier_percentage")
    )


def ecdf(df: DataFrame, value: str) -> DataFrame:
    """Sorted values with rank over count; ties take distinct ranks in date order."""
    ranked = Window.partitionBy("symbol").orderBy(value, "date")
    df = df.filter(F.col(value).isNotNull())
    return df.select(
        "symbol", "date", value, (F.row_number().over(ranked) / F.count("*").over(whole())).alias("ecdf")
    )


def latest_dates(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.groupBy(key).agg(F.max("date").alias("latest_date"))


def oldest_latest(df: DataFrame, key: str = "symbol") -> DataFrame:
    """Smallest of the per-key latest dates: the point up to which every key is loaded."""
    return latest_dates(df, key).agg(F.min("latest_date").alias("latest_date"))


def month_order(bars: DataFrame) -> DataFrame:
    """Month labels of each series with their chronological rank and how many rows they hold."""
    months = bars.groupBy("symbol", F.trunc("date", "month").alias("m")).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy("m")).cast("long")
    return months.select("symbol", F.date_format("m", "MMM yyyy").alias("label"), rank.alias("month_rank"), "n")
