"""Multi-level wavelet transform of each series, as a fold over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.functions.series import by_date
from barwright.operators.solver import bound
from barwright.operators.spectral import detrended

# The low-pass taps for analysis of the Daubechies wavelet with four vanishing moments.
LOW = [
    -0.010597401784997278, 0.032883011666982945, 0.030841381835986965, -0.18703481171888114,
    -0.02798376941698385, 0.6308807679295904, 0.7148465705525415, 0.23037781330885523,
]
#: The high-pass taps are the low-pass ones backwards with alternating signs.
HIGH = [tap if j % 2 else -tap for j, tap in enumerate(reversed(LOW))]


def _filtered(x: Column, taps: list[float]) -> Column:
    """Every second value of ``x`` run through ``taps``, edges mirrored with the edge value repeated."""
    n = F.size(x)
    mirrored = lambda i: F.when(i < 0, -1 - i).when(i >= n, 2 * n - 1 - i).otherwise(i).cast("int")
    one = lambda k: sum((F.get(x, mirrored(2 * k + 1 - j)) * tap for j, tap in enumerate(taps[1:], 1)), F.get(x, mirrored(2 * k + 1)) * taps[0])
    return F.transform(F.sequence(F.lit(0), F.floor((n + len(taps) - 1) / 2).cast("int") - 1), one)


def most_levels(n: Column, taps: int = len(LOW)) -> Column:
    """How often ``n`` values can be halved while the filter still fits; 0 where it does not fit once."""
    return F.greatest(F.coalesce(F.floor(F.log2(n / (taps - 1))), F.lit(0)), F.lit(0)).cast("int")


def discrete_wavelet(returns: DataFrame, level: int | None = None, detrend: bool = True) -> DataFrame:
    """(symbol, level, part, k, coefficient) of the returns (symbol, date, r) of each series.

    Details come from level 1, the finest, to ``level`` or as deep as the filter fits; the
    approximation is that of the deepest level. Each step reads what the one before left. A
    series too short for one level gives one row with NULLs.
    """
    df = returns.select("symbol", "date", "r", (F.row_number().over(by_date()) - 1).alias("t"))
    x = detrended(df, "r", "t") if detrend else F.col("r")
    rows = df.withColumn("x", x).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("rows"))
    most = most_levels(F.size("rows"))
    rows = rows.select("symbol", F.col("rows.x").alias("x"), (most if level is None else F.least(most, F.lit(level))).alias("levels"))

    def halved(state: Column, _: Column) -> Column:
        return F.struct(_filtered(state.left, LOW).alias("left"), F.concat(state.details, F.array(_filtered(state.left, HIGH))).alias("details"))

    start = F.struct(F.col("x").alias("left"), F.array().cast("array<array<double>>").alias("details"))

    def table(state: Column) -> Column:
        cells = lambda part, depth, values: F.transform(
            values, lambda v, k: F.struct(depth.cast("int").alias("level"), F.lit(part).alias("part"), k.alias("k"), v.alias("coefficient"))
        )
        return F.concat(cells("approximation", F.col("levels"), state.left), F.flatten(F.transform(state.details, lambda d, i: cells("detail", i + 1, d))))

    # A sequence up to zero would run backwards, so that short series are kept apart.
    found = bound(F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("levels"), F.lit(1))), start, halved), table)
    null = lambda kind: F.lit(None).cast(kind)
    none = F.array(F.struct(null("int").alias("level"), null("string").alias("part"), null("int").alias("k"), null("double").alias("coefficient")))
    return rows.select("symbol", F.inline(F.when(F.col("levels") >= 1, found).otherwise(none)))
