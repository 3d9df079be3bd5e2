"""Momentum, mean reversion and autocorrelation of each series."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.blocks import centred, each_series, values_of, windows
from barwright.functions.series import by_date, rolling, simple_return, whole
from barwright.operators.indicators import rate_of_change_percent

# Default parameters of the indicators.
FAST, SLOW, SIGNAL = 12, 26, 9
RSI_WINDOW = 14
# Rows of a series folded at a time.
PIECE = 64
ANALYSIS_WINDOW = 120
LAGS = 30
HURST_WINDOW = 100
HURST_SIZES = [10, 17, 31, 56, 100]
# Rows beside each other that are summed together; longer windows are put together from such pieces.
HURST_PIECE = 9


def folded(bars: DataFrame, value: Column, start: Column, step: Callable[[Column, Column], Column], names: list[str]) -> DataFrame:
    """A recursion along each series, inside the generated plan: (symbol, date, names).

    ``step`` takes the state and the next value; the fields ``names`` of the state are
    published at every row. A series is one array, bounded by the calendar. It is folded in
    pieces of ``PIECE`` rows, each appended once, so the work stays in proportion to the rows.
    """
    rows = F.array_sort(F.collect_list(F.struct("date", value.cast("double").alias("v"))))
    series = bars.filter(value.isNotNull()).groupBy("symbol").agg(rows.alias("rows"))
    n = F.size("rows")
    pieces = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / PIECE)), lambda k: F.slice("rows", (k * PIECE + 1).cast("int"), PIECE))
    shown = lambda s: F.struct(*[s[x].alias(x) for x in names])
    nothing = F.filter(F.array(shown(start)), lambda _: F.lit(False))

    def one(acc: Column, row: Column) -> Column:
        state = step(acc["state"], row["v"])
        return F.struct(state.alias("state"), F.concat(acc["out"], F.array(shown(state))).alias("out"))

    def piece(acc: Column, part: Column) -> Column:
        inner = F.struct(acc["state"].alias("state"), nothing.alias("out"))
        return F.reduce(part, inner, one, lambda r: F.struct(r["state"].alias("state"), F.concat(acc["out"], r["out"]).alias("out")))

    out = F.reduce(pieces, F.struct(start.alias("state"), nothing.alias("out")), piece, lambda r: r["out"])
    each = series.select("symbol", "rows", out.alias("out")).select("symbol", F.inline(F.arrays_zip("rows", "out")))
    return each.select("symbol", F.col("rows.date").alias("date"), *[F.col(f"out.{x}").alias(x) for x in names])


def _average(before: Column, value: Column, weight: float, first: Column) -> Column:
    """One step of a recursive average that starts with its first value."""
    return F.when(first, value).otherwise(before * (1 - weight) + value * weight)


def macd(bars: DataFrame, fast: int = FAST, slow: int = SLOW, signal: int = SIGNAL) -> DataFrame:
    """Difference of two exponential averages, its own average, and their difference.

    Every row of every series is given; a measure is NULL until it has its full window.
    """
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("n"), *[zero.alias(x) for x in ("quick", "steady", "line", "smooth")])

    def step(s: Column, v: Column) -> Column:
        n = s["n"] + 1
        quick = _average(s["quick"], v, 2 / (fast + 1), n == 1)
        steady = _average(s["steady"], v, 2 / (slow + 1), n == 1)
        line = quick - steady
        smooth = F.when(n >= slow, _average(s["smooth"], line, 2 / (signal + 1), n == slow)).otherwise(zero)
        return F.struct(n.alias("n"), quick.alias("quick"), steady.alias("steady"), line.alias("line"), smooth.alias("smooth"))

    out = folded(bars, F.col("close"), start, step, ["n", "line", "smooth"])
    line = F.when(F.col("n") >= slow, F.col("line"))
    smooth = F.when(F.col("n") >= slow + signal - 1, F.col("smooth"))
    return out.select("symbol", "date", line.alias("macd"), smooth.alias("macd_signal"), (line - smooth).alias("macd_diff"))


def rsi(bars: DataFrame, window: int = RSI_WINDOW) -> DataFrame:
    """Relative strength index with recursive averages; 100 where nothing fell, NULL until the window is full."""
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).alias("n"), *[zero.alias(x) for x in ("last", "gain", "loss")])

    def step(s: Column, v: Column) -> Column:
        n, w = s["n"] + 1, 1 / window
        move = F.when(n == 1, zero).otherwise(v - s["last"])
        gain = _average(s["gain"], F.greatest(move, zero), w, n == 1)
        loss = _average(s["loss"], F.greatest(-move, zero), w, n == 1)
        return F.struct(n.alias("n"), v.alias("last"), gain.alias("gain"), loss.alias("loss"))

    out = folded(bars, F.col("close"), start, step, ["n", "gain", "loss"])
    value = F.coalesce(100 - 100 / (1 + F.try_divide(F.col("gain"), F.col("loss"))), F.lit(100.0))
    return out.select("symbol", "date", F.when(F.col("n") >= window, value).alias("rsi"))


def rolling_autocorrelation(bars: DataFrame, window: int = ANALYSIS_WINDOW, lag: int = 1) -> DataFrame:
    """Correlation of returns with their own lag over the last rows where both exist."""
    df = bars.select("symbol", "date", simple_return().alias("r"))
    df = df.withColumn("rl", F.lag("r", lag).over(by_date())).filter("r IS NOT NULL AND rl IS NOT NULL")
    corr = rolling(F.corr("r", "rl"), "r", window)
    return df.select("symbol", "date", corr.alias("autocorrelation")).filter("autocorrelation IS NOT NULL")


def _series(bars: DataFrame, absolute: bool) -> DataFrame:
    r = simple_return()
    return bars.select("symbol", "date", (F.abs(r) if absolute else r).alias("x")).filter("x IS NOT NULL")


def rolling_acf(bars: DataFrame, window: int = ANALYSIS_WINDOW, lags: int = LAGS, absolute: bool = False) -> DataFrame:
    """Autocorrelations of the ``window`` rows before each row, one column per lag.

    Windows of almost no variance are left out, as are series too short for one window.
    """
    names = [f"acf_{k}" for k in range(1, lags + 1)]

    def rolled(table: pa.Table) -> dict:
        x = values_of(table, "x")
        kept, values = np.zeros(len(x), dtype=bool), np.full((lags, len(x)), np.nan)
        if len(x) >= window + lags + 1:
            # The window before a row is the one that ends a row earlier.
            for at, w in windows(x[:-1], window):
                d, _ = centred(w)
                spread = np.einsum("ij,ij->i", d, d)
                moves = spread / (window - 1) >= 1e-10
                here = np.arange(at.start + 1, at.stop + 1)[moves]
                kept[here] = True
                d = d[moves]
                for k in range(1, lags + 1):
                    values[k - 1, here] = np.einsum("ij,ij->i", d[:, k:], d[:, :-k]) / spread[moves]
        return {"kept": kept, **dict(zip(names, values, strict=True))}

    return each_series(_series(bars, absolute), rolled, names).drop("x")


def acf(bars: DataFrame, lags: int = LAGS, absolute: bool = False) -> DataFrame:
    """Autocorrelation by lag with the half width of its 95 % band."""
    df = _series(bars, absolute)
    df = df.withColumns({"d": F.col("x") - F.avg("x").over(whole()), "n": F.count("*").over(whole())})
    df = df.filter(F.col("n") >= lags + 2)
    df = df.withColumns({f"d{k}": F.lag("d", k).over(by_date()) for k in range(1, lags + 1)})
    agg = df.groupBy("symbol").agg(
        F.count("*").alias("n"),
        F.sum(F.col("d") * F.col("d")).alias("v"),
        *[F.sum(F.col("d") * F.col(f"d{k}")).alias(f"c{k}") for k in range(1, lags + 1)],
    )
    cells = [F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("acf"))] + [
        F.struct(F.lit(k).alias("lag"), F.try_divide(F.col(f"c{k}"), F.col("v")).alias("acf")) for k in range(1, lags + 1)
    ]
    long = agg.select("symbol", "n", F.inline(F.array(*cells)))
    before = Window.partitionBy("symbol").orderBy("lag").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.coalesce(F.sum(F.when(F.col("lag") > 0, F.col("acf") * F.col("acf"))).over(before), F.lit(0.0))
    half = F.when(F.col("lag") == 0, 0.0).otherwise(F.lit(NORMAL_975) * F.sqrt((1 + 2 * grown) / F.col("n")))
    return long.select("symbol", "lag", "acf", half.alias("band"))


# Fixed value: 97.5 % quantile of the standard normal.
NORMAL_975 = 1.959963984540054


def last_rows(bars: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows of each series, numbered from 0 in date order."""
    back = Window.partitionBy("symbol").orderBy(F.col("date").desc())
    kept = bars.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n)
    return kept.withColumn("pos", F.row_number().over(by_date()) - 1).drop("_back")


def hurst(bars: DataFrame) -> DataFrame:
    """Hurst exponent of the last 100 closes by simplified rescaled ranges, in plain SQL terms."""
    df = last_rows(bars.select("symbol", "date", "close"), HURST_WINDOW)
    df = df.withColumn("n", F.count("*").over(whole())).filter(F.col("n") == HURST_WINDOW)
    df = df.withColumn("size", F.explode(F.array(*[F.lit(s) for s in HURST_SIZES])))
    df = df.withColumn("chunk", F.floor(F.col("pos") / F.col("size"))).filter(
        (F.col("chunk") + 1) * F.col("size") <= HURST_WINDOW
    )
    inside = Window.partitionBy("symbol", "size", "chunk").orderBy("date")
    df = df.withColumn("step", F.col("close") / F.lag("close").over(inside) - 1)
    rs = df.groupBy("symbol", "size", "chunk").agg(
        F.try_divide(F.max("close") / F.min("close") - 1, F.stddev_samp("step")).alias("rs")
    )
    mean = rs.filter("rs > 0").groupBy("symbol", "size").agg(F.avg("rs").alias("rs"))
    return mean.groupBy("symbol").agg(F.regr_slope(F.log10("rs"), F.log10("size")).alias("hurst"))


def _pieces(ends: list[int]) -> tuple[list[tuple[int, int]], dict[int, int]]:
    """([(rows back, rows)] of pieces of up to ``HURST_PIECE`` rows, how many of them are the e - 1 rows up to each end)."""
    pieces, count, back = [], {}, 0
    for e in ends:
        rows = e - 1 - back
        n = -(-rows // HURST_PIECE)
        for j in range(n):
            size = rows // n + (j < rows % n)
            pieces.append((back, size))
            back += size
        count[e] = len(pieces)
    return pieces, count


def _total(columns: list[Column]) -> Column:
    return sum(columns[1:], columns[0])


def _ranges(df: DataFrame, window: int, sizes, kept: list[str]) -> DataFrame:
    """(kept, rs of each size, still) of the rows up to each row, from ``close`` and ``step``.

    No frame is evaluated anew for a row: some rows beside each other make a piece, and pieces
    lagged by what lies between are put together to one size after the other. A piece has its
    extremes, and its count, sum and squares from its first value; they are moved to the first
    value of all, so that what never moves deviates by nothing, as when summed from its mean.
    """
    pieces, count = _pieces(sorted({*sizes, window}))
    most, n_pieces, both = max(size for _, size in pieces), len(pieces), ("close", "step")
    lag = lambda c, n: F.lag(c, n).over(by_date()) if n else F.col(c)
    zero = F.lit(0.0)

    df = df.select(*kept, F.struct(*both).alias("z"))
    df = df.select(*kept, *[lag("z", k).alias(f"z{k}") for k in range(most)])
    df = df.select("*", *[F.coalesce(*[F.col(f"z{k}.{c}") for k in range(most)]).alias(f"{c}_from") for c in both])
    off = [F.coalesce(F.col(f"z{k}.{c}") - F.col(f"{c}_from"), zero).alias(f"{c}_d{k}") for c in both for k in range(most)]
    there = [F.col(f"z{k}.{c}").isNotNull().cast("double").alias(f"{c}_n{k}") for c in both for k in range(most)]
    df = df.select("*", *off, *there)

    def piece(size: int) -> Column:
        closes = [F.col(f"z{k}.close") for k in range(size)]
        cells = [closes[0].alias("close")]
        cells += [f(*closes, closes[0]).alias(x) for f, x in ((F.greatest, "high"), (F.least, "low"))]
        for c in both:
            d = [F.col(f"{c}_d{k}") for k in range(size)]
            n = _total([F.col(f"{c}_n{k}") for k in range(size)])
            cells += [n.alias(f"{c}_n"), F.col(f"{c}_from"), _total(d).alias(f"{c}_s"), _total([x * x for x in d]).alias(f"{c}_q")]
        return F.struct(*cells)

    df = df.select(*kept, F.col("z0.close").alias("close"), *[piece(size).alias(f"piece{size}") for size in sorted({size for _, size in pieces})])
    df = df.select(*kept, *[lag(f"piece{size}", back).alias(f"p{k}") for k, (back, size) in enumerate(pieces)], lag("close", max(*sizes, window) - 1).alias("last"))
    df = df.select("*", *[F.coalesce(*[F.col(f"p{k}.{c}_from") for k in range(n_pieces)]).alias(f"{c}_from") for c in both])
    moved = []
    for c in both:
        for k in range(n_pieces):
            moved.append(F.coalesce(F.col(f"p{k}.{c}_from") - F.col(f"{c}_from"), zero).alias(f"{c}_d{k}"))
            moved += [F.coalesce(F.col(f"p{k}.{c}_{x}"), zero).alias(f"{c}_{x}{k}") for x in "nsq"]
    df = df.select("*", *moved)

    def sums(c: str, k: int) -> tuple[Column, Column, Column]:
        n, d, s, q = ([F.col(f"{c}_{x}{j}") for j in range(k)] for x in "ndsq")
        return _total(n), _total([y + x * z for x, z, y in zip(n, d, s, strict=True)]), _total([v + z * (y + y + x * z) for x, z, y, v in zip(n, d, s, q, strict=True)])

    # The pieces of a size leave out its last close, as it has a step less.
    end = lambda e: F.col(f"p{count[e]}.close") if count[e] < n_pieces else F.col("last")

    def rescaled(size: int) -> Column:
        n, s, q = sums("step", count[size])
        spread = F.when(n > 1, F.sqrt(F.greatest(q - s * s / n, zero) / (n - 1)))
        high, low = (f(*[F.col(f"p{j}.{x}") for j in range(count[size])], end(size)) for f, x in ((F.greatest, "high"), (F.least, "low")))
        return F.nullif(F.try_divide(F.try_divide(high, low) - 1, spread), zero)

    n, s, q = sums("close", count[window])
    d = F.coalesce(end(window) - F.coalesce("close_from", end(window)), zero)
    n, s, q = n + end(window).isNotNull().cast("double"), s + d, q + d * d
    still = F.when(n > 0, F.sqrt(F.greatest(q - s * s / n, zero) / n)) < 1e-9
    return df.select(*kept, *[rescaled(size).alias(f"rs{size}") for size in sorted({*sizes})], still.alias("still"))


def rolling_hurst(bars: DataFrame, window: int = HURST_WINDOW, sizes=tuple(HURST_SIZES), kept: tuple[str, ...] = ()) -> DataFrame:
    """Hurst exponent of the ``window`` closes before each row, as in :func:`hurst`, beside the columns ``kept``.

    The rescaled range of each chunk is that of the chunk's size at its last row; the chunks
    of a window are then fixed lags of those columns, and the slope is a closed form, as the
    sizes never change. Windows of constant closes are left out; the exponent is NULL where a
    size has no chunk that moves.
    """
    step = (F.try_divide(F.col("close"), F.lag("close").over(by_date())) - 1).alias("step")
    df = bars.select("symbol", "date", "close", *kept, step, F.row_number().over(by_date()).alias("i"))
    names = ["symbol", "date", *kept, "i"]
    df = _ranges(df, window, sizes, names)
    lag = lambda c, n: F.lag(c, n).over(by_date())
    lagged = [lag(f"rs{s}", window + 1 - (j + 1) * s).alias(f"rs{s}_{j}") for s in sizes for j in range(window // s)]
    df = df.select(*names, lag("still", 1).alias("still"), *lagged).filter((F.col("i") > window) & ~F.col("still"))
    xs = [math.log10(s) for s in sizes]
    mean = sum(xs) / len(xs)
    total = sum((x - mean) ** 2 for x in xs)

    def level(s: int) -> Column:
        chunks = [F.col(f"rs{s}_{j}") for j in range(window // s)]
        n = sum((c.isNotNull().cast("double") for c in chunks), F.lit(0.0))
        return F.log10(F.try_divide(sum((F.coalesce(c, F.lit(0.0)) for c in chunks), F.lit(0.0)), n))

    slope = sum((level(s) * ((x - mean) / total) for s, x in zip(sizes, xs, strict=True)), F.lit(0.0))
    return df.select("symbol", "date", *kept, slope.alias("hurst"))


def phase_table(bars: DataFrame, momentum: str = "roc", reversion: str = "rsi", window: int = 20) -> DataFrame:
    """Momentum against mean reversion on the rows where both exist, with days since the first."""
    if momentum == "roc":
        m = rate_of_change_percent(bars, window).withColumnRenamed(f"roc_pct_{window}d", "momentum")
    elif momentum == "macd":
        m = macd(bars).select("symbol", "date", F.col("macd").alias("momentum"))
    else:
        raise ValueError(f"unknown momentum measure {momentum}")
    if reversion == "rsi":
        both = m.select("symbol", "date", "momentum").join(rsi(bars).select("symbol", "date", F.col("rsi").alias("reversion")), ["symbol", "date"])
    elif reversion == "hurst" and momentum == "roc":
        # Both are windows of the same rows: what is known of a row goes along, and nothing is joined.
        both = rolling_hurst(m, kept=("momentum",)).withColumnRenamed("hurst", "reversion").dropna(subset=["symbol", "date"])
    elif reversion == "hurst":
        both = m.join(rolling_hurst(bars).select("symbol", "date", F.col("hurst").alias("reversion")), ["symbol", "date"])
    else:
        raise ValueError(f"unknown reversion measure {reversion}")
    both = both.dropna(subset=["momentum", "reversion"])
    return both.withColumn("elapsed", F.datediff("date", F.min("date").over(whole())))
