"""Partial autocorrelation and the unit-root test of each series, by least squares in the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import by_date, simple_return, whole
from barwright.operators.momentum import ANALYSIS_WINDOW, LAGS, NORMAL_975, last_rows
from barwright.operators.solver import bound, cross_products, dot, normal_share, reduced


def returns_of(bars: DataFrame, absolute: bool = False) -> DataFrame:
    """(symbol, date, x): daily returns, or their sizes as a measure of volatility."""
    r = simple_return()
    return bars.select("symbol", "date", (F.abs(r) if absolute else r).alias("x")).filter("x IS NOT NULL")


def _products(series: DataFrame, lags: int) -> DataFrame:
    """(symbol, date, x, s0 .., total): running sums of x times x lagged by 0 .. ``lags``, and of x.

    The series is centred first, which changes no partial correlation and keeps the sums small.
    """
    df = series.withColumn("x", F.col("x") - F.avg("x").over(whole()))
    upto = by_date().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({f"x{d}": F.coalesce(F.lag("x", d).over(by_date()), F.lit(0.0)) for d in range(1, lags + 1)})
    products = [F.col("x") * F.col("x")] + [F.col("x") * F.col(f"x{d}") for d in range(1, lags + 1)]
    return df.select("symbol", "date", "x", *[F.sum(p).over(upto).alias(f"s{d}") for d, p in enumerate(products)], F.sum("x").over(upto).alias("total"))


def _partial(lags: int, n: Column, total, product, head, tail) -> Column:
    """Partial autocorrelations of lag 1 .. ``lags`` of the ``n`` values x[0] .. x[n-1] of each row, as an array.

    That of lag k is the last coefficient of the regression of a value on the k values before it
    and a constant, over all values that have so many before them. ``product(d, j)`` is the sum
    of x[t] x[t-d] over all t < n - j, ``total(j)`` that of x[t]; ``head(i)`` is x[i] and ``tail(i)`` x[n-1-i].

    Each lag follows from the one before by the fast covariance recursion: kept are the
    regressions forwards (a) and backwards (b) over t >= m on a constant and the m values
    between, what they leave (f, g), and the gains (c, d) and leverages (hc, hd) by which the
    first and the last t leave the sums. A lag m costs m steps, where an elimination costs m cubed.
    """
    one, zero = F.lit(1.0), F.array(F.lit(0.0))
    # Places: the constant, then the value itself and those 1 .. m back.
    steps = F.array(*[
        F.struct(
            F.array(one, *[head(m - j) for j in range(m + 1)]).alias("first"),
            F.array(one, *[tail(j) for j in range(m + 1)]).alias("last"),
            F.array(total(m + 1), *[product(m + 1 - j, j) for j in range(m + 1)]).alias("met"),
        )
        for m in range(lags)
    ])
    plus = lambda x, y, by: F.zip_with(x, y, lambda u, v: u + v * by)
    less = lambda x, y, by: F.zip_with(x, y, lambda u, v: u - v * by)
    parted = lambda x: F.concat(F.slice(x, 1, 1), zero, F.slice(x, F.lit(2), F.size(x)))
    named = lambda **parts: F.struct(*[v.alias(k) for k, v in parts.items()])

    def step(s: Column, z: Column) -> Column:
        met = named(
            ef=dot(s.a, z.first), eb=dot(s.b, z.last), wd=dot(s.d, z.first), wb=dot(s.b, z.first), ag=dot(s.a, z.met), cg=dot(s.c, z.met),
        )

        def shares(w: Column) -> Column:
            return named(w=w, alpha=F.try_divide(w.ef, 1 - s.hc), beta=F.try_divide(w.eb, 1 - s.hd), pf=F.try_divide(w.ef, s.f), qg=F.try_divide(w.eb, s.g))

        def ends(r: Column) -> Column:
            w = r.w
            return named(
                cross=w.ag + w.cg * r.alpha, f=s.f - w.ef * r.alpha, g=s.g - w.eb * r.beta,
                hp=s.hc + w.ef * r.pf, hq=s.hd + w.eb * r.qg, hpq=w.wd + w.wb * r.qg,
                # Without the first t forwards, without the last one backwards and then a row on.
                ahead=F.concat(plus(s.a, s.c, r.alpha), zero), behind=bound(plus(s.b, s.d, r.beta), parted), p=plus(s.c, s.a, r.pf), q=plus(s.d, s.b, r.qg),
            )

        def following(e: Column) -> Column:
            by = named(forth=F.try_divide(e.cross, e.g), back=F.try_divide(e.cross, e.f), up=F.try_divide(e.hpq, 1 - e.hq), uq=F.try_divide(e.hpq, 1 - e.hp))
            return bound(by, lambda k: named(
                a=less(e.ahead, e.behind, k.forth), b=less(e.behind, e.ahead, k.back), c=bound(plus(e.p, e.q, k.up), parted), d=F.concat(plus(e.q, e.p, k.uq), zero),
                f=e.f - k.forth * e.cross, g=e.g - k.back * e.cross, hc=e.hp + e.hpq * k.up, hd=e.hq + e.hpq * k.uq, out=F.concat(s.out, F.array(k.forth)),
            ))

        return bound(met, lambda w: bound(shares(w), lambda r: bound(ends(r), following)))

    mean = F.try_divide(total(0), n)
    share = F.try_divide(one, n)
    left = product(0, 0) - total(0) * mean
    gain = F.array(share, F.lit(0.0))
    start = named(a=F.array(-mean, one), b=F.array(-mean, one), c=gain, d=gain, f=left, g=left, hc=share, hd=share, out=F.array().cast("array<double>"))
    return F.aggregate(steps, start, step, lambda s: s.out)


def pacf(series: DataFrame, lags: int = LAGS) -> DataFrame:
    """(symbol, lag, pacf, band): partial autocorrelation by lag with the half width of its 95 % band.

    ``series`` is (symbol, date, x). Series of fewer than two rows a lag get one row with NULLs
    for lag 0, so that none is lost unseen. Of a series only its ends are put together, with
    the running sums at the later one: what is held and sent does not grow with its length.
    """
    df = _products(series, lags).withColumns({"i": F.row_number().over(by_date()), "n": F.count("*").over(whole())})
    late = F.col("n") - F.col("i")
    df = df.withColumn("late", late).filter((F.col("i") <= lags) | (F.col("late") <= lags))
    sums = F.struct("late", "x", F.array(*[f"s{d}" for d in range(lags + 1)]).alias("s"), "total")
    df = df.groupBy("symbol").agg(
        F.max("n").alias("n"),
        F.array_sort(F.collect_list(F.when(F.col("i") <= lags, F.struct("i", "x")))).alias("early"),
        F.array_sort(F.collect_list(F.when(F.col("late") <= lags, sums))).alias("late"),
    )
    at = lambda i: F.get("late", F.lit(i))
    enough = df.filter(F.col("n") >= 2 * lags).select(
        "symbol", "n",
        *[at(i)["x"].alias(f"_tail{i}") for i in range(lags)], *[F.get("early", F.lit(i))["x"].alias(f"_head{i}") for i in range(lags)],
        *[at(j)["total"].alias(f"_total{j}") for j in range(lags + 1)], F.col("late.s").alias("_s"),
    )
    v = _partial(
        lags, F.col("n"), lambda j: F.col(f"_total{j}"), lambda d, j: F.get(F.get("_s", F.lit(j)), F.lit(d)),
        lambda i: F.col(f"_head{i}"), lambda i: F.col(f"_tail{i}"),
    )
    band = F.lit(NORMAL_975) / F.sqrt(F.col("n"))
    cells = F.concat(
        F.array(F.struct(F.lit(0).alias("lag"), F.lit(1.0).alias("pacf"), F.lit(0.0).alias("band"))),
        F.transform("v", lambda x, i: F.struct((i + 1).alias("lag"), x.alias("pacf"), band.alias("band"))),
    )
    none = F.lit(None).cast("double")
    short = df.filter(F.col("n") < 2 * lags).select("symbol", F.lit(0).alias("lag"), none.alias("pacf"), none.alias("band"))
    return enough.select("symbol", "n", v.alias("v")).select("symbol", F.inline(cells)).unionByName(short)


def rolling_pacf(series: DataFrame, window: int = ANALYSIS_WINDOW, lags: int = LAGS) -> DataFrame:
    """Partial autocorrelations of the ``window`` rows before each row, one column per lag.

    Windows of almost no variance are left out, as are series too short for one window. All
    windows of a series read the same running sums, so a window costs the same whatever its length.
    """
    if window < 2 * lags:
        raise ValueError("a window needs two rows a lag")
    df = _products(series, lags).withColumns({"i": F.row_number().over(by_date()) - 1, "n": F.count("*").over(whole())})
    ago = lambda c, rows: F.lag(c, rows).over(by_date())
    ends = {f"_s{d}_{j}": ago(f"s{d}", j + 1) for d in range(lags + 1) for j in range(lags + 1 - d)}
    ends |= {f"_u{j}": ago("total", j + 1) for j in range(lags + 1)}
    # Sums up to the rows before a window; there are none before the first.
    starts = {f"_s{d}": F.coalesce(ago(f"s{d}", window - d + 1), F.lit(0.0)) for d in range(lags + 1)}
    starts["_u"] = F.coalesce(ago("total", window + 1), F.lit(0.0))
    values = {f"_x{i}": ago("x", i) for i in sorted({*range(1, lags + 1), *range(window - lags + 1, window + 1)})}
    df = df.withColumns(ends | starts | values).filter((F.col("n") >= window + lags + 1) & (F.col("i") >= window))
    between = [(F.col(e) - F.col("_u" if e.startswith("_u") else e.rsplit("_", 1)[0])).alias(e) for e in ends]
    df = df.select("symbol", "date", *values, *between)
    n = F.lit(float(window))
    df = df.filter((F.col("_s0_0") - F.col("_u0") * F.col("_u0") / n) / (window - 1) >= 1e-10)
    v = _partial(
        lags, n, lambda j: F.col(f"_u{j}"), lambda d, j: F.col(f"_s{d}_{j}"), lambda i: F.col(f"_x{window - i}"), lambda i: F.col(f"_x{i + 1}"),
    )
    out = df.select("symbol", "date", v.alias("v"))
    return out.select("symbol", "date", *[F.get("v", F.lit(k - 1)).alias(f"pacf_{k}") for k in range(1, lags + 1)])


# Published response surface of the test's distribution with a constant, one series:
# its bounds, the value where its two polynomials meet, and their coefficients from the lowest power.
TAU_LEAST, TAU_MOST, TAU_MEET = -18.83, 2.74, -1.61
TAU_LOW = [2.1659, 1.4412, 0.038269]
TAU_HIGH = [1.7339, 0.93202, -0.12745, -0.010368]


def unit_root_share(stat: Column) -> Column:
    """Approximate p-value of the unit-root statistic with a constant."""
    poly = lambda cs: sum((F.lit(c) * F.pow(stat, F.lit(i)) for i, c in enumerate(cs)), F.lit(0.0))
    z = F.when(stat <= TAU_MEET, poly(TAU_LOW)).otherwise(poly(TAU_HIGH))
    inner = F.when(stat > TAU_MOST, 1.0).when(stat < TAU_LEAST, 0.0).otherwise(bound(z, normal_share))
    return F.when(stat.isNotNull(), inner)


def _design(y: Column, dy: Column, cut: Column, lags: Column, level_last: bool) -> Column:
    """Variables of the test regression on the rows behind the first ``cut`` differences.

    A constant, the level before, ``lags`` earlier differences and the difference itself; with
    ``level_last`` the level stands next to last.
    """
    m = F.size(dy) - cut
    level = F.array(F.slice(y, cut + 1, m))
    earlier = F.transform(F.filter(F.sequence(F.lit(0), lags), lambda j: j > 0), lambda j: F.slice(dy, cut - j + 1, m))
    one = F.array(F.array_repeat(F.lit(1.0), m))
    own = F.array(F.slice(dy, cut + 1, m))
    return F.concat(one, earlier, level, own) if level_last else F.concat(one, level, earlier, own)


def unit_root(bars: DataFrame, window: int = ANALYSIS_WINDOW) -> DataFrame:
    """(symbol, n, lags, stat, p_value, reason): test for a unit root on the last ``window`` closes.

    The differences are regressed on the level before, a constant and earlier differences.
    How many of these is chosen by the information criterion of Akaike on the rows that all
    choices share; the regression is then run on all rows that the choice allows. Where it
    cannot be run the numbers are NULL and ``reason`` says why: too few rows, or a constant
    series.
    """
    rows = last_rows(bars.filter("close IS NOT NULL").select("symbol", "date", "close"), window)
    df = rows.groupBy("symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "close"))), lambda r: r["close"].cast("double")).alias("raw"))
    n = F.size("raw")
    mean = F.aggregate("raw", F.lit(0.0), lambda a, x: a + x) / n
    df = df.select("symbol", n.alias("n"), (F.array_max("raw") == F.array_min("raw")).alias("flat"), bound(mean, lambda m: F.transform("raw", lambda x: x - m)).alias("y"))
    most = F.least(F.ceil(12 * F.pow(F.col("n") / 100, F.lit(0.25))), F.floor(F.col("n") / 2) - 2).cast("int")
    df = df.withColumn("most", most).withColumn("dy", F.zip_with(F.slice("y", F.lit(2), F.greatest(F.col("n") - 1, F.lit(0))), F.slice("y", F.lit(1), F.greatest(F.col("n") - 1, F.lit(0))), lambda b, a: b - a))
    # With one row more than coefficients at the longest choice.
    usable = (F.col("n") - 1 - F.col("most") > F.col("most") + 2) & (F.col("most") >= 0) & ~F.col("flat")
    m = F.col("n") - 1 - F.col("most")

    # The last place of the eliminated system is what the variables so far leave unexplained.
    def chosen(system: Column) -> Column:
        left = F.transform(F.sequence(F.lit(0), F.col("most")), lambda p: F.struct((m * F.log(F.element_at(F.element_at(reduced(system, p + 2), -1), -1)) + 2 * p).alias("criterion"), p.alias("p")))
        return F.array_min(left)["p"]

    best = bound(cross_products(_design(F.col("y"), F.col("dy"), F.col("most"), F.col("most"), False)), chosen)
    df = df.withColumn("usable", usable).withColumn("lags", F.when(F.col("usable"), best))

    def tested(rest: Column) -> Column:
        slope = F.try_divide(rest[0][1], rest[0][0])
        error = F.sqrt(F.try_divide(rest[1][0] - slope * rest[0][1], (F.col("n") - 2 * F.col("lags") - 3) * rest[0][0]))
        return F.try_divide(slope, error)

    system = bound(_design(F.col("y"), F.col("dy"), F.col("lags"), F.col("lags"), True), cross_products)
    stat = F.when(F.col("usable"), bound(reduced(system, F.col("lags") + 1), tested))
    df = df.withColumn("stat", F.when(~F.isnan(stat), stat))
    reason = F.when(F.col("flat"), "constant").when(~F.col("usable"), "too few rows")
    return df.select("symbol", "n", "lags", "stat", unit_root_share(F.col("stat")).alias("p_value"), reason.alias("reason"))
