"""Spectra of each series as trigonometric sums: a hash aggregate over (symbol, frequency).

Both grids are bounded by the calendar, as a series has at most one row a trading day. The
sums need no shuffle beyond the one by symbol that the windows before them make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import by_date, log_return, whole
from barwright.operators.solver import bound

#: Least prominence of a peak, and how many are reported.
PROMINENCE, PEAKS = 0.1, 5
TWO_PI = 6.283185307179586


def spectral_returns(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "date", log_return().alias("r")).filter("r IS NOT NULL")


def detrended(df: DataFrame, value: str, time: str) -> Column:
    """``value`` less its straight line over ``time``, within each series."""
    spec = whole()
    slope = F.coalesce(F.regr_slope(value, time).over(spec), F.lit(0.0))
    return F.col(value) - F.avg(value).over(spec) - slope * (F.col(time) - F.avg(time).over(spec))


def amplitude_spectrum(returns: DataFrame, detrend: bool = True) -> DataFrame:
    """(symbol, k, frequency, amplitude) of the detrended, windowed returns; frequency in cycles per day.

    ``returns`` is (symbol, date, r). A series of fewer than two rows has no frequencies.
    """
    df = returns.select("symbol", "date", "r", (F.row_number().over(by_date()) - 1).cast("long").alias("t"), F.count("*").over(whole()).alias("n"))
    x = detrended(df, "r", "t") if detrend else F.col("r")
    df = df.withColumn("x", x * (0.5 - 0.5 * F.cos(TWO_PI * F.col("t") / F.col("n")))).filter("n > 1")
    # Eight rows stand beside each other, so that a frequency takes its angles and its place in the sums once for all of them.
    values = {f"x{i}": F.coalesce(F.lead("x", i).over(by_date()), F.lit(0.0)) for i in range(1, 8)}
    df = df.withColumns(values).filter("t % 8 = 0")
    df = df.select("symbol", "t", "n", F.col("x").alias("x0"), *values, F.explode(F.expr("sequence(0L, n div 2 - 1)")).alias("k"))
    # The angle is reduced in whole numbers, so that late rows lose no digits.
    angle = TWO_PI * ((F.col("k") * F.col("t")) % F.col("n")) / F.col("n")
    step = TWO_PI * F.col("k") / F.col("n")
    c, s, x = ([F.col(f"{v}{i}") for i in range(8)] for v in "csx")
    df = df.withColumns({"c0": F.cos(angle), "s0": F.sin(angle), "c1": F.cos(step), "s1": F.sin(step)})
    df = df.withColumns({"c2": c[1] * c[1] - s[1] * s[1], "s2": 2 * c[1] * s[1]})
    df = df.withColumns({"c3": c[1] * c[2] - s[1] * s[2], "s3": s[1] * c[2] + c[1] * s[2], "c4": c[2] * c[2] - s[2] * s[2], "s4": 2 * c[2] * s[2]})
    four = lambda v, at: x[at + 1] * v[1] + x[at + 2] * v[2] + x[at + 3] * v[3]
    df = df.select("symbol", "n", "k", "c0", "s0", "c4", "s4", *[e.alias(k) for k, e in {"a": x[0] + four(c, 0), "b": four(s, 0), "p": x[4] + four(c, 4), "q": four(s, 4)}.items()])
    cos, sin = F.col("a") + F.col("c4") * F.col("p") - F.col("s4") * F.col("q"), F.col("b") + F.col("s4") * F.col("p") + F.col("c4") * F.col("q")
    df = df.select("symbol", "n", "k", "c0", "s0", cos.alias("cos"), sin.alias("sin"))
    sums = df.groupBy("symbol", "n", "k").agg(
        F.sum(F.col("c0") * F.col("cos") - F.col("s0") * F.col("sin")).alias("c"), F.sum(F.col("s0") * F.col("cos") + F.col("c0") * F.col("sin")).alias("s")
    )
    return sums.select("symbol", "k", (F.col("k") / F.col("n")).alias("frequency"), (2 / F.col("n") * F.sqrt(F.col("c") * F.col("c") + F.col("s") * F.col("s"))).alias("amplitude"))


def _lowest(values: Column) -> Column:
    """At each place, the least value back to the nearest higher one, or to the start.

    A fold over a stack of falling heights, each with the least value since the one below it.
    """

    def step(state: Column, h: Column) -> Column:
        gone = F.filter(state.stack, lambda s: s.h <= h)

        def pushed(low: Column) -> Column:
            left = F.filter(state.stack, lambda s: s.h > h)
            return F.struct(F.concat(left, F.array(F.struct(h.alias("h"), low.alias("low")))).alias("stack"), F.concat(state.out, F.array(low)).alias("out"))

        return bound(F.coalesce(F.least(h, F.array_min(F.transform(gone, lambda s: s.low))), h), pushed)

    none = F.array().cast("array<struct<h: double, low: double>>")
    return F.aggregate(values, F.struct(none.alias("stack"), F.array().cast("array<double>").alias("out")), step, lambda s: s.out)


def spectral_peaks(spectrum: DataFrame, prominence: float = PROMINENCE, peaks: int = PEAKS) -> DataFrame:
    """(symbol, rank, k, frequency, period, amplitude, prominence): the most prominent peaks of each series.

    A peak is higher than the values on both sides; a level one counts once, at its middle.
    Its prominence is how far it stands above the higher of the two lowest values between it
    and the nearest higher one on either side. Equal prominences go by frequency.
    """
    rows = spectrum.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("k", "frequency", "amplitude"))).alias("rows"))
    a = F.col("rows.amplitude")
    rows = rows.select("symbol", "rows", a.alias("a"), bound(a, _lowest).alias("before"), F.reverse(bound(F.reverse(a), _lowest)).alias("after"))
    each = rows.select("symbol", F.inline(F.arrays_zip("rows", "before", "after"))).select("symbol", "rows.*", "before", "after")
    order = Window.partitionBy("symbol").orderBy("k")
    # Runs of equal values: a run is a peak if both neighbours exist and are lower.
    each = each.withColumn("run", F.sum(F.coalesce((F.col("amplitude") != F.lag("amplitude").over(order)).cast("int"), F.lit(0))).over(order))
    run = each.groupBy("symbol", "run").agg(F.min("k").alias("low"), F.max("k").alias("high"), F.first("amplitude").alias("height"))
    runs = Window.partitionBy("symbol").orderBy("run")
    run = run.withColumns({"left": F.lag("height").over(runs), "right": F.lead("height").over(runs)}).filter("left < height AND right < height")
    tops = run.select("symbol", F.expr("(low + high) div 2").alias("k"))
    found = each.join(tops, ["symbol", "k"]).withColumn("prominence", F.col("amplitude") - F.greatest("before", "after"))
    best = Window.partitionBy("symbol").orderBy(F.col("prominence").desc(), "k")
    found = found.filter(F.col("prominence") >= prominence).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= peaks)
    return found.select("symbol", "rank", "k", "frequency", F.try_divide(F.lit(1.0), F.col("frequency")).alias("period"), "amplitude", "prominence")


def uneven_periodogram(bars: DataFrame, value: str = "close", least_period: float = 2.0, samples: int = 10) -> DataFrame:
    """(symbol, j, frequency, period, power) of unevenly dated values, power from 0 to 1.

    Values are detrended by rows, as they come, and centred; times are days since the first
    row. Frequencies run evenly from two cycles over the whole span to one over
    ``least_period``, ``samples`` for each cycle of the span. At each frequency the phase is
    found at which sine and cosine are independent, then the share of all variation that both
    explain beside a free mean: one aggregate over (symbol, frequency). Series of fewer than three rows, or
    too short for one frequency, have none.
    """
    df = bars.filter(F.col(value).isNotNull()).select(
        "symbol", "date", F.col(value).alias("v"), F.datediff("date", F.min("date").over(whole())).alias("t"),
        (F.row_number().over(by_date()) - 1).alias("i"), F.count("*").over(whole()).alias("n"),
    )
    df = df.withColumns({"x": detrended(df, "v", "i"), "span": F.max("t").over(whole())}).filter("n >= 3 AND span > 0")
    low, high = 2.0 / F.col("span"), F.lit(1.0 / least_period)
    df = df.withColumns({"low": low, "count": F.floor(samples * F.col("span") * (high - low)).cast("long")}).filter("count > 1")
    # Eight rows stand beside each other, so that a frequency takes its place in the sums once for all of them; where
    # a series ends their share is zero.
    later = {f"t{i}": F.lead("t", i).over(by_date()) for i in range(1, 8)} | {f"x{i}": F.coalesce(F.lead("x", i).over(by_date()), F.lit(0.0)) for i in range(1, 8)}
    df = df.withColumns(later).filter("i % 8 = 0").withColumn("rows", F.least(F.col("n") - F.col("i"), F.lit(8)))
    grid = F.explode(F.expr("sequence(0L, count - 1)"))
    df = df.select("symbol", "rows", F.col("t").alias("t0"), F.col("x").alias("x0"), *later, "low", "count", grid.alias("j"))
    frequency = F.col("low") + F.col("j") * (high - F.col("low")) / (F.col("count") - 1)
    df = df.withColumn("w", TWO_PI * frequency)
    t, x, c, s = ([F.col(f"{v}{i}") for i in range(8)] for v in "txcs")
    cos, sin = ([F.coalesce(f(F.col("w") * t[i]), F.lit(0.0)).alias(f"{v}{i}") for i in range(8)] for v, f in (("c", F.cos), ("s", F.sin)))
    # Co-moments of value, sine and cosine give the power at any phase; a free mean is taken out of all three.
    df = df.select("symbol", "j", "w", "rows", *x, *cos, *sin)
    pairs = [("x", "c"), ("x", "s"), ("c", "c"), ("s", "s"), ("c", "s"), ("x", "x")]
    part = {"x": x, "c": c, "s": s}
    eight = lambda vs: sum(vs[1:], vs[0])
    sums = df.groupBy("symbol", "j", "w").agg(
        F.sum("rows").alias("n"), *[F.sum(eight(part[a])).alias(a) for a in "xcs"],
        *[F.sum(eight([u * v for u, v in zip(part[a], part[b], strict=True)])).alias(a + b) for a, b in pairs],
    )
    sums = sums.select("symbol", "j", "w", *[(F.col(a + b) - F.col(a) * F.col(b) / F.col("n")).alias(a + b) for a, b in pairs])
    phase = 0.5 * F.atan2(2 * F.col("cs"), F.col("cc") - F.col("ss"))
    cos, sin = F.cos(phase), F.sin(phase)
    even, odd = F.col("xc") * cos + F.col("xs") * sin, F.col("xs") * cos - F.col("xc") * sin
    cross = 2 * cos * sin * F.col("cs")
    long, short = cos * cos * F.col("cc") + cross + sin * sin * F.col("ss"), cos * cos * F.col("ss") - cross + sin * sin * F.col("cc")
    power = (F.coalesce(F.try_divide(even * even, long), F.lit(0.0)) + F.coalesce(F.try_divide(odd * odd, short), F.lit(0.0))) / F.nullif(F.col("xx"), F.lit(0.0))
    return sums.select("symbol", "j", (F.col("w") / TWO_PI).alias("frequency"), (TWO_PI / F.col("w")).alias("period"), power.alias("power"))
