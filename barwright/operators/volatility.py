"""Rolling volatility, Parkinson range volatility, regimes and the volatility cone."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from barwright.functions.blocks import deviation, each_series, in_order, values_of
from barwright.functions.series import by_date, by_date_desc, log_return, rolling, whole

# Horizons, annualisation, regime quantiles and labels.
HORIZONS = [5, 10, 21, 42, 63, 126, 252]
TRADING_DAYS = 252
REGIME_HORIZON = 21
REGIME_QUANTILES = [0.0, 0.25, 0.75, 0.95, 1.0]
REGIME_LABELS = ["Low", "Normal", "High", "Extreme"]


def rolling_volatility(bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Annualised deviation of log returns over the last n non-null returns."""
    df = bars.withColumn("log_return", log_return())
    names = {f"vol_{n}d": n for n in horizons}

    def rolled(table: pa.Table) -> dict:
        x = values_of(table, "log_return")
        has = ~np.isnan(x)
        out = {}
        for name, n in names.items():
            out[name] = np.full(len(x), np.nan)
            out[name][has] = deviation(x[has], n) * np.sqrt(float(TRADING_DAYS))
        return out

    return each_series(df, rolled, list(names))


def parkinson(bars: DataFrame, window: int = 21) -> DataFrame:
    """Range volatility; a bar without a positive range empties every window it is in."""
    square = F.when((F.col("high") > F.col("low")) & (F.col("low") > 0), F.pow(F.log(F.col("high") / F.col("low")), F.lit(2.0)))
    df = bars.withColumn("_sq", square)
    scale = 4 * window * F.log(F.lit(2.0))
    total = rolling(F.sum("_sq"), "_sq", window)
    return df.withColumn(f"parkinson_{window}d", F.sqrt(total / scale) * F.sqrt(F.lit(float(TRADING_DAYS)))).drop("_sq")


def regimes(vols: DataFrame, column: str = f"vol_{REGIME_HORIZON}d") -> DataFrame:
    """Cut a volatility column at its own quantiles, right-closed, lowest included.

    Needs more points than quantiles, else Unknown; equal quantiles drop a class;
    one distinct quantile gives Normal. Rows without a value take the next class,
    then the previous one, then the most common.
    """
    v = F.col(column)
    labels = F.array(*[F.lit(x) for x in REGIME_LABELS])
    edges = F.array_distinct(F.percentile(v, F.array(*[F.lit(q) for q in REGIME_QUANTILES])).over(whole()))
    df = vols.withColumns({"_edges": edges, "_n": F.count(v).over(whole())})
    rank = F.greatest(F.size(F.filter("_edges", lambda e: e < v)), F.lit(1))
    df = df.withColumn("_cut", F.when(v.isNotNull(), F.get(labels, rank - 1)))
    fill = F.coalesce(
        F.last("_cut", True).over(by_date_desc().rowsBetween(Window.unboundedPreceding, 0)),
        F.last("_cut", True).over(by_date().rowsBetween(Window.unboundedPreceding, 0)),
        F.mode("_cut", True).over(whole()),
    )
    regime = (
        F.when(F.col("_n") <= len(REGIME_QUANTILES), "Unknown")
        .when(F.size("_edges") < 2, "Normal")
        .otherwise(fill)
    )
    return df.withColumn("vol_regime", regime).drop("_edges", "_n", "_cut")


def term_structure(vols: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Long (symbol, date, horizon, vol); horizons without a value are left out."""
    names = [f"vol_{n}d" for n in horizons]
    long = vols.unpivot(["symbol", "date"], names, "name", "vol").filter("vol IS NOT NULL")
    return long.select("symbol", "date", F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("horizon"), "vol")


def _quantiles(values: np.ndarray, shares: list[float]) -> list[float]:
    """Quantiles between neighbours of sorted values, as Spark's percentile blends them."""
    out = []
    for share in shares:
        at = (len(values) - 1) * share
        low, high = math.floor(at), math.ceil(at)
        out.append(values[low] if low == high or values[low] == values[high] else (high - at) * values[low] + (at - low) * values[high])
    return out


def cone(vols: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Smallest, quartiles, largest and latest volatility for each symbol and horizon."""
    names = {f"vol_{n}d": n for n in horizons}
    doubles = ["min", "q25", "median", "q75", "max", "current"]
    schema = T.StructType([vols.schema["symbol"], T.StructField("horizon", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in doubles]])

    def summed_up(table: pa.Table) -> pa.Table:
        table = in_order(table)
        dated = table["date"].is_valid().to_numpy()
        rows = []
        for name, n in names.items():
            v = values_of(table, name)
            has = ~np.isnan(v)
            if has.any():
                order, last = np.sort(v[has]), v[has & dated][-1:]
                rows.append((n, order[0], *_quantiles(order, [0.25, 0.5, 0.75]), order[-1], last[0] if len(last) else None))
        symbol = pa.array([table["symbol"][0].as_py()] * len(rows), table["symbol"].type)
        columns = list(zip(*rows, strict=True)) or [()] * (len(doubles) + 1)
        return pa.table({"symbol": symbol, "horizon": pa.array(columns[0], pa.int64()), **{c: pa.array(x, pa.float64()) for c, x in zip(doubles, columns[1:], strict=True)}})

    return vols.select("symbol", "date", *names).groupBy("symbol").applyInArrow(summed_up, schema)
