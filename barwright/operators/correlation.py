"""Returns of each stock beside the market series, and correlations among them.

The market side is one row per date with eight values, whatever the number of
stocks, so the join on date moves only that small table when Spark's own size
check allows and shuffles on date otherwise.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barwright.functions.blocks import centred, each_series, values_of, windows
from barwright.functions.series import by_date, log_ratio, whole

STOCK = "STOCK"


def combined(bars: DataFrame, market: DataFrame) -> DataFrame:
    """Stock close and all market series on the dates they share, without NULLs."""
    assets = [c for c in market.columns if c != "date"]
    out = bars.select("symbol", "date", F.col("close").alias(STOCK)).join(market.dropna(subset=assets), "date")
    return out.select("symbol", "date", STOCK, *assets).dropna(subset=[STOCK])


def joint_returns(joint: DataFrame) -> DataFrame:
    """Log return of every column between consecutive shared dates of a stock."""
    assets = [c for c in joint.columns if c not in ("symbol", "date")]
    out = joint.select(
        "symbol", "date", *[log_ratio(F.col(a), F.lag(a).over(by_date())).alias(a) for a in assets]
    )
    return out.dropna(subset=assets)


def correlation_matrix(returns: DataFrame) -> DataFrame:
    """Every pair of columns per symbol, both ways round, with a two-decimal label.

    Cases are complete, so each column is centred once and a pair costs one sum of products,
    where a correlation aggregate of each pair would keep six buffers.
    """
    assets = [c for c in returns.columns if c not in ("symbol", "date")]
    pairs = list(combinations_with_replacement(assets, 2))
    centred = returns.select("symbol", *[(F.col(a) - F.avg(a).over(whole())).alias(a) for a in assets])
    agg = centred.groupBy("symbol").agg(
        F.count("*").alias("n"), *[F.sum(F.col(a) * F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]
    )
    own = {a: F.col(f"p{i}") for i, (a, b) in enumerate(pairs) if a == b}
    cells = []
    for i, (a, b) in enumerate(pairs):
        value = F.when(F.col("n") > 1, F.try_divide(F.col(f"p{i}"), F.sqrt(own[a]) * F.sqrt(own[b])))
        for x, y in {(a, b), (b, a)}:
            cells.append(F.struct(F.lit(x).alias("asset_x"), F.lit(y).alias("asset_y"), value.alias("correlation")))
    out = agg.select("symbol", "n", F.inline(F.array(*cells)))
    return out.withColumn("label", F.round("correlation", 2).cast("decimal(4,2)").cast("string"))


def rolling_correlations(returns: DataFrame, window: int = 63) -> DataFrame:
    """Rolling correlation of the stock with each market series, in long form; none where either does not move."""
    assets = [c for c in returns.columns if c not in ("symbol", "date", STOCK)]

    def correlated(table: pa.Table) -> dict:
        stock = values_of(table, STOCK)
        out = {}
        for a in assets:
            other, out[f"r_{a}"] = values_of(table, a), np.full(len(stock), np.nan)
            paired = np.where(np.isnan(other), np.nan, stock)
            for (at, w), (_, s), (_, v) in zip(windows(stock, window), windows(paired, window), windows(np.where(np.isnan(stock), np.nan, other), window), strict=True):
                (x, _), (y, _) = centred(s), centred(v)
                spread = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                full = ~np.isnan(w).any(axis=1) & (spread > 0)
                out[f"r_{a}"][at] = np.where(full, (x * y).sum(axis=1) / np.where(full, spread, 1.0), np.nan)
        return out

    wide = each_series(returns.select("symbol", "date", *[F.col(c).cast("double").alias(c) for c in (STOCK, *assets)]), correlated, [f"r_{a}" for a in assets])
    wide = wide.select("symbol", "date", *[F.col(f"r_{a}").alias(a) for a in assets])
    return wide.unpivot(["symbol", "date"], assets, "asset", "correlation").filter("correlation IS NOT NULL")
