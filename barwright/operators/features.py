"""Feature columns by formula, their fit to a target, splits, sequences and targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import by_date, log_return, prev, rolling, simple_return, trailing, whole
from barwright.operators import indicators as ind, volatility as vol


def add_formulas(bars: DataFrame, formulas: dict[str, str]) -> DataFrame:
    """Named SQL expressions over the panel columns; the analyser rejects unknown names."""
    return bars.withColumns({name: F.expr(text) for name, text in formulas.items()})


def technical(bars: DataFrame) -> DataFrame:
    return ind.bollinger(ind.moving_averages(bars))


def volatility_set(bars: DataFrame) -> DataFrame:
    return vol.parkinson(vol.rolling_volatility(bars))


FEATURE_SETS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "technical": technical,
    "volatility": volatility_set,
    "volume": ind.volume_metrics,
    "market_regime": lambda df: vol.regimes(vol.rolling_volatility(df, [vol.REGIME_HORIZON])),
    "price_action": ind.candle_metrics,
    "momentum": ind.rate_of_change,
    "returns": ind.return_metrics,
}


def _with_sector(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    return bars.join(sector_strength(bars, stocks), ["symbol", "date"], "left")


def _with_yield_curve(bars: DataFrame, yields: DataFrame) -> DataFrame:
    return bars.join(yield_curve(yields), "date", "left")


# Sets that need a table beside the bars, and that table.
JOINED_SETS: dict[str, tuple[str, Callable[[DataFrame, DataFrame], DataFrame]]] = {
    "sector": ("stocks", _with_sector),
    "yield_curve": ("yields", _with_yield_curve),
}


def feature_set(bars: DataFrame, *names: str, **tables: DataFrame) -> DataFrame:
    """Compose feature sets by name; unknown names, and tables not given, raise."""
    for name in names:
        if name in FEATURE_SETS:
            bars = bars.transform(FEATURE_SETS[name])
        elif name in JOINED_SETS:
            table, join = JOINED_SETS[name]
            if table not in tables:
                raise ValueError(f"feature set {name} needs the table {table}")
            bars = join(bars, tables[table])
        else:
            raise ValueError(f"unknown feature set {name}")
    return bars


def sector_strength(bars: DataFrame, stocks: DataFrame) -> DataFrame:
    """Return of each stock over the mean return of its sector on the day."""
    r = bars.select("symbol", "date", simple_return().alias("ret")).filter("ret IS NOT NULL")
    r = r.join(stocks.select("symbol", "sector"), "symbol")
    mean = r.groupBy("sector", "date").agg(F.avg("ret").alias("sector_ret"))
    return r.join(mean, ["sector", "date"]).select("symbol", "date", (F.col("ret") - F.col("sector_ret")).alias("strength"))


def yield_curve(yields: DataFrame) -> DataFrame:
    """Slopes between maturities."""
    return yields.select(
        "date", (F.col("yr10") - F.col("yr2")).alias("slope_10y_2y"), (F.col("yr10") - F.col("mo3")).alias("slope_10y_3m"),
        (F.col("yr30") - F.col("yr5")).alias("slope_30y_5y"),
    )


def feature_correlations(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Pearson correlation of each feature with the target in one pass."""
    agg = df.agg(*[F.corr(f, target).alias(f) for f in features])
    return agg.unpivot([], features, "feature", "correlation")


def quantiles(df: DataFrame, columns: list[str], cuts: list[float]) -> DataFrame:
    """(feature, edges): exact interpolated quantiles of whole columns, no task holding a column.

    Values are counted in bins of even width on a logarithmic scale, at most some ten
    thousand; running counts of the bins say which bins hold the wanted places, and only
    the different values of those are put in order.
    """
    values = df.unpivot([], columns, "feature", "value").filter(F.col("value").isNotNull())
    values = values.groupBy("feature", "value").agg(F.count("*").alias("n"))
    values = values.withColumn("bin", F.floor(F.asinh(F.col("value") * 1e6) * 64))
    bins = values.groupBy("feature", "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy("feature").orderBy("bin")
    bins = bins.withColumns({"until": F.sum("n").over(up), "all": F.sum("n").over(Window.partitionBy("feature"))})
    place = F.col("cut") * (F.col("all") - 1)
    wanted = bins.select("feature", "bin", "until", "n", "all", F.explode(F.array(*[F.lit(float(c)) for c in cuts])).alias("cut"))
    wanted = wanted.select("feature", "bin", "cut", (F.col("until") - F.col("n")).alias("before"), "until", place.alias("place"), F.explode(F.array(F.floor(place), F.ceil(place))).alias("k"))
    wanted = wanted.filter((F.col("k") >= F.col("before")) & (F.col("k") < F.col("until"))).distinct()
    held = values.join(wanted.select("feature", "bin").distinct(), ["feature", "bin"])
    inside = Window.partitionBy("feature", "bin").orderBy("value")
    held = held.withColumn("upto", F.sum("n").over(inside))
    at = held.join(wanted, ["feature", "bin"]).filter(
        (F.col("k") >= F.col("before") + F.col("upto") - F.col("n")) & (F.col("k") < F.col("before") + F.col("upto"))
    )
    low, high = F.min("value"), F.max("value")
    edge = low + (high - low) * (F.max("place") - F.floor(F.max("place")))
    edges = at.groupBy("feature", "cut").agg(edge.alias("edge"))
    return edges.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("cut", "edge"))), lambda e: e["edge"]).alias("edges"))


def binned_information(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of each feature and the target over quantile bins.

    Bin edges are exact percentiles of each column (:func:`quantiles`); counts of the
    joint bins are at most ``bins`` squared rows per feature. A nearest-neighbour
    estimate would differ by design.
    """
    cuts = [i / bins for i in range(1, bins)]
    ok = df.dropna(subset=[*features, target]).select(*[F.col(c).cast("double").alias(c) for c in [*features, target]])
    edges = quantiles(ok, [*features, target], cuts)
    table = edges.agg(F.map_from_entries(F.collect_list(F.struct("feature", "edges")))).scalar()

    def bin_of(c: str) -> Column:
        return F.size(F.filter(F.col("_edges")[c], lambda e: e < F.col(c)))

    binned = ok.withColumn("_edges", table).select(bin_of(target).alias("y"), *[bin_of(c).alias(c) for c in features])
    joint = binned.unpivot(["y"], features, "feature", "x").groupBy("feature", "x", "y").agg(F.count("*").alias("n"))
    wf = Window.partitionBy("feature")
    p = joint.select(
        "feature", "n", F.sum("n").over(wf).alias("all"), F.sum("n").over(Window.partitionBy("feature", "x")).alias("nx"),
        F.sum("n").over(Window.partitionBy("feature", "y")).alias("ny"),
    )
    return p.groupBy("feature").agg(
        F.sum(F.col("n") / F.col("all") * F.log(F.col("n") * F.col("all") / (F.col("nx") * F.col("ny")))).alias("information")
    )


def compare_sets(df: DataFrame, sets: dict[str, list[str]], target: str) -> DataFrame:
    """Feature count, strongest and mean absolute correlation of each feature set."""
    names = sorted({f for fs in sets.values() for f in fs})
    member = F.array(*[F.struct(F.lit(s).alias("feature_set"), F.lit(f).alias("f")) for s, fs in sets.items() for f in fs])
    corr = feature_correlations(df, names, target)
    picked = corr.withColumn("m", F.explode(F.filter(member, lambda m: m["f"] == F.col("feature"))))
    return picked.groupBy(F.col("m.feature_set").alias("feature_set")).agg(
        F.count("*").alias("features"), F.max(F.abs("correlation")).alias("best"), F.avg(F.abs("correlation")).alias("mean")
    )


def chronological_split(df: DataFrame, share: float = 0.7) -> DataFrame:
    """Mark the first ``share`` of each series as training rows, without shuffling."""
    n = F.count("*").over(whole())
    return df.withColumn("part", F.when(F.row_number().over(by_date()) <= F.floor(n * share), "train").otherwise("test"))


def sequences(df: DataFrame, features: list[str], length: int = 20) -> DataFrame:
    """The last ``length`` feature rows of every row that has as many before it."""
    rows = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(trailing(length))
    return df.select("symbol", "date", rows.alias("sequence")).filter(F.size("sequence") == length)


def target_column(df: DataFrame, named: str | None = None, primary: str | None = None, targets: list[str] | None = None) -> str:
    """The named target, else the configured primary one, else the first."""
    for name in [named, primary, *(targets or [])]:
        if name and name in df.columns:
            return name
    raise ValueError("no target column")


def split_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """Features without the target, and the target, both keyed."""
    return df.drop(target), df.select("symbol", "date", target)


def targets(bars: DataFrame, horizon: int = 5, bins: int = 4) -> DataFrame:
    """Forward return, its bin, drawdown, volatility, largest jump and worst return over the horizon."""
    ahead = by_date().rowsBetween(1, horizon)
    df = bars.withColumn("_lr", log_return())
    full = F.count("close").over(ahead) == horizon
    cols = {
        "target_return": F.lead("close", horizon).over(by_date()) / F.col("close") - 1,
        "target_drawdown": F.min("low").over(ahead) / F.col("close") - 1,
        "target_volatility": F.stddev_samp("_lr").over(ahead),
        "target_jump": F.max(F.abs("_lr")).over(ahead),
        "target_tail": F.min("_lr").over(ahead),
    }
    df = df.withColumns({k: F.when(full, v) for k, v in cols.items()})
    known = df.filter("target_return IS NOT NULL")
    ranked = Window.partitionBy("symbol").orderBy("target_return", "date")
    return known.withColumn("target_bin", F.ntile(bins).over(ranked)).drop("_lr")


def alpha_target(bars: DataFrame, market: DataFrame, horizon: int = 5, threshold: float = 0.0, vol_adjust: bool = False) -> DataFrame:
    """(symbol, date, target_alpha, beats): forward return over that of the market (date, close).

    ``vol_adjust`` divides by the deviation of the last 21 log returns; ``beats`` is whether
    the target passes ``threshold``. Dates the market lacks are left out.
    """
    ahead = lambda c, spec: F.lead(c, horizon).over(spec) / F.col(c) - 1
    both = bars.join(market.select("date", F.col("close").alias("_m")), "date")
    alpha = ahead("close", by_date()) - ahead("_m", by_date())
    df = both.withColumns({"target_alpha": alpha, "_lr": log_return()})
    if vol_adjust:
        spread = rolling(F.stddev_samp("_lr"), "_lr", 21)
        df = df.withColumn("target_alpha", F.try_divide(F.col("target_alpha"), spread))
    df = df.filter("target_alpha IS NOT NULL")
    return df.select("symbol", "date", "target_alpha", (F.col("target_alpha") > threshold).alias("beats"))


def signals(predictions: DataFrame, buy: float = 0.02, sell: float = -0.02, stop: float = 0.05) -> DataFrame:
    """BUY, SELL or HOLD by predicted return, with target and stop prices."""
    p, c = F.col("predicted"), F.col("close")
    action = F.when(p >= buy, "BUY").when(p <= sell, "SELL").otherwise("HOLD")
    df = predictions.withColumn("action", action)
    side = F.when(F.col("action") == "BUY", 1.0).when(F.col("action") == "SELL", -1.0)
    return df.withColumns({"target_price": F.when(side.isNotNull(), c * (1 + p)), "stop_price": c * (1 - side * stop)})


def basic_market_columns(bars: DataFrame) -> DataFrame:
    """Daily, log and cumulative return, and the price relatives."""
    df = bars.withColumns({"daily_return": simple_return(), "log_return": log_return()})
    return df.withColumns(
        {
            "cumulative_return": F.exp(F.sum("log_return").over(by_date().rowsBetween(Window.unboundedPreceding, 0))) - 1,
            "open_close": F.col("close") - F.col("open"),
            "high_low": F.col("high") - F.col("low"),
            "close_prev_close": F.try_divide(F.col("close"), prev("close")),
        }
    )
