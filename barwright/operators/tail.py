"""Value at risk, expected shortfall and extreme-value estimates of each series."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.blocks import each_series, values_of, windows
from barwright.functions.series import log_return, whole
from barwright.operators.solver import bound, highest, log_gamma

# Confidence 95 %, its normal quantile, and the return periods in days.
CONFIDENCE = 0.95
Z_05 = -1.6448536269514729
RETURN_PERIODS = [2, 5, 10, 20, 50, 100, 252]


def tail_returns(bars: DataFrame) -> DataFrame:
    """Log returns where both prices are above 1e-9."""
    return bars.select("symbol", "date", log_return(floor=1e-9).alias("r")).filter("r IS NOT NULL")


def historical_var(returns: DataFrame, alpha: float = 1 - CONFIDENCE) -> DataFrame:
    """Empirical quantile and the mean of the returns at or below it."""
    df = returns.withColumn("var", F.percentile("r", F.lit(alpha)).over(whole()))
    return df.groupBy("symbol").agg(
        F.first("var").alias("var"), F.avg(F.when(F.col("r") <= F.col("var"), F.col("r"))).alias("cvar")
    )


def normal_var(returns: DataFrame, alpha: float = 1 - CONFIDENCE, z: float = Z_05) -> DataFrame:
    density = math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    agg = returns.groupBy("symbol").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("s")).filter("s > 0")
    return agg.select(
        "symbol", (F.col("m") + z * F.col("s")).alias("var"), (F.col("m") - F.col("s") * density / alpha).alias("cvar")
    )


#: Bounds of the degrees of freedom that are looked at; at the upper one the distribution is as good as normal.
FREEDOM = (1.0, 1000.0)
REWEIGHTINGS = 30


def _reweighted(x: Column, freedom: Column) -> Column:
    """struct(m, s2): location and squared scale of most likelihood for given degrees of freedom, by reweighting."""

    def step(state: Column, _: Column) -> Column:
        def new(w: Column) -> Column:
            total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
            mean = total(F.zip_with(w, x, lambda a, v: a * v)) / total(w)
            return bound(mean, lambda m: F.struct(m.alias("m"), (total(F.zip_with(w, x, lambda a, v: a * (v - m) * (v - m))) / F.size(x)).alias("s2")))

        return bound(F.transform(x, lambda v: (freedom + 1) / (freedom + (v - state.m) * (v - state.m) / state.s2)), new)

    return F.aggregate(F.sequence(F.lit(1), F.lit(REWEIGHTINGS)), F.struct(F.lit(0.0).alias("m"), F.lit(1.0).alias("s2")), step)


def _likelihood(x: Column, freedom: Column, fit: Column) -> Column:
    n = F.size(x)
    spread = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.log(1 + (v - fit.m) * (v - fit.m) / (fit.s2 * freedom)))
    # Fixed value: pi.
    each = log_gamma((freedom + 1) / 2) - log_gamma(freedom / 2) - 0.5 * F.log(3.141592653589793 * freedom * fit.s2)
    return n * each - (freedom + 1) / 2 * spread


def student_quantile(freedom: Column, alpha: float) -> Column:
    """The quantile of Student's distribution for ``freedom`` of 1 or more and ``alpha`` below a half.

    With t = sqrt(freedom) tan(phi) the share between 0 and t is an integral of powers of a
    cosine, taken by Simpson's rule; the angle is found by halving.
    """
    steps = 200
    scale = F.exp(log_gamma((freedom + 1) / 2) - log_gamma(freedom / 2)) / 1.7724538509055159  # root of pi, a fixed value

    def share(angle: Column) -> Column:
        weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
        total = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda a, i: a + weight(i) * F.pow(F.cos(angle * i / steps), freedom - 1))
        return total * angle / steps / 3

    def halve(s: Column, _: Column) -> Column:
        return bound((s.a + s.b) / 2, lambda m: F.when(share(m) * s.scale < 0.5 - alpha, F.struct(m.alias("a"), s.b.alias("b"), s.scale.alias("scale"))).otherwise(F.struct(s.a.alias("a"), m.alias("b"), s.scale.alias("scale"))))

    # Fixed value: half of pi.
    start = F.struct(F.lit(0.0).alias("a"), F.lit(1.5707963267948966).alias("b"), scale.alias("scale"))
    return -F.sqrt(freedom) * F.aggregate(F.sequence(F.lit(1), F.lit(52)), start, halve, lambda s: F.tan(s.a))


def student_var(returns: DataFrame, alpha: float = 1 - CONFIDENCE) -> DataFrame:
    """(symbol, n, freedom, location, scale, var, cvar, at_bound): Student's distribution fitted by likelihood.

    The degrees of freedom are those of the highest profile likelihood: for each that is
    tried, location and scale are found by reweighting. ``at_bound`` says that the best lies
    at an end of ``FREEDOM``, as for tails no heavier than normal ones. Series without spread
    or of fewer than two returns have no row, as for the normal distribution.
    """
    rows = returns.groupBy("symbol").agg(F.sort_array(F.collect_list("r")).alias("r"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("std"), F.count("r").alias("n")).filter("std > 0")
    # The rows are few but each costs much: a stated number of partitions is not merged by size.
    spark = returns.sparkSession
    rows = rows.repartition(2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "symbol")
    x = F.transform("r", lambda v: (v - F.col("mean")) / F.col("std"))
    low, high = (F.lit(math.log(b)) for b in FREEDOM)

    def fitted(x: Column) -> Column:
        profile = lambda s: bound(F.exp(s), lambda f: bound(_reweighted(x, f), lambda fit: _likelihood(x, f, fit)))
        return bound(F.exp(highest(profile, low, high).at), lambda f: bound(_reweighted(x, f), lambda fit: F.struct(f.alias("freedom"), fit.m.alias("m"), F.sqrt(fit.s2).alias("s"))))

    # Inlined arrays of one: what is worked out there is not worked out again in later expressions or filters.
    df = rows.select("symbol", "n", "mean", "std", F.inline(F.array(bound(x, fitted))))
    df = df.select("symbol", "n", "freedom", (F.col("mean") + F.col("std") * F.col("m")).alias("location"), (F.col("std") * F.col("s")).alias("scale"))
    df = df.select("*", F.explode(F.array(student_quantile(F.col("freedom"), alpha))).alias("q"))
    f, q = F.col("freedom"), F.col("q")
    density = F.exp(log_gamma((f + 1) / 2) - log_gamma(f / 2)) / F.sqrt(3.141592653589793 * f) * F.pow(1 + q * q / f, -(f + 1) / 2)
    shortfall = F.when(f > 1, F.col("location") - F.col("scale") * (f + q * q) / (f - 1) * density / alpha)
    edge = (f < FREEDOM[0] * 1.001) | (f > FREEDOM[1] * 0.999)
    return df.select("symbol", "n", "freedom", "location", "scale", (F.col("location") + F.col("scale") * q).alias("var"), shortfall.alias("cvar"), edge.alias("at_bound"))


def var_comparison(returns: DataFrame, student: bool = False) -> DataFrame:
    """Loss in percent by method; ``student`` adds the fit of Student's distribution."""
    parts = [("Historical", historical_var(returns)), ("Parametric (Normal)", normal_var(returns))]
    parts += [("Parametric (t)", student_var(returns))] if student else []
    out = None
    for name, df in parts:
        one = df.select("symbol", F.lit(name).alias("method"), (-F.col("var") * 100).alias("loss_pct")).dropna()
        out = one if out is None else out.unionByName(one)
    return out


def rolling_var(returns: DataFrame, window: int = 63, alpha: float = 1 - CONFIDENCE) -> DataFrame:
    """Quantile and shortfall of the last ``window`` returns as positive percentages."""
    # The quantile lies between two places of the one sorted window.
    at = (window - 1) * alpha
    low, high = math.floor(at), math.ceil(at)

    def rolled(table: pa.Table) -> dict:
        x = values_of(table, "r")
        v, mean = np.full(len(x), np.nan), np.full(len(x), np.nan)
        for place, w in windows(x, window):
            w = np.sort(w, axis=1)
            q = w[:, low] + (w[:, high] - w[:, low]) * (at - low)
            below = w <= q[:, None]
            with np.errstate(invalid="ignore"):
                v[place], mean[place] = q, np.cumsum(np.where(below, w, 0.0), axis=1)[:, -1] / below.sum(axis=1)
            # NULLs sort last.
            v[place] = np.where(np.isnan(w[:, -1]), np.nan, v[place])
        return {"kept": ~np.isnan(v), "var_pct": -v * 100, "cvar_pct": -mean * 100}

    return each_series(returns.select("symbol", "date", F.col("r").cast("double").alias("r")), rolled, ["var_pct", "cvar_pct"]).drop("r")


def exceedances(returns: DataFrame, quantile: float = 0.95, tail: str = "loss") -> DataFrame:
    """Amounts by which losses pass their own quantile, with the threshold and the counts.

    ``tail="gain"`` looks at the other side of the distribution.
    """
    sign = -1.0 if tail == "loss" else 1.0
    df = returns.select("symbol", "date", (F.col("r") * sign).alias("loss"))
    df = df.withColumns({"threshold": F.percentile("loss", F.lit(quantile)).over(whole()), "n": F.count("*").over(whole())})
    return df.filter(F.col("loss") > F.col("threshold")).select(
        "symbol", "date", "threshold", (F.col("loss") - F.col("threshold")).alias("excess"), "n"
    )


def pareto_fit(over: DataFrame) -> DataFrame:
    """Generalised Pareto shape and scale by the method of moments; NULL under ten exceedances or without spread.

    With the mean m and variance v of the excesses, the shape is (1 - m^2 / v) / 2 and the
    scale m (1 + m^2 / v) / 2: one aggregation for all series.
    """
    fit = over.groupBy("symbol").agg(
        F.max("threshold").alias("threshold"), F.count("*").alias("n_over"), F.max("n").alias("n"),
        F.avg("excess").alias("_m"), F.var_samp("excess").alias("_v"),
    )
    ratio = F.when(F.col("n_over") >= 10, F.try_divide(F.col("_m") * F.col("_m"), F.col("_v")))
    return fit.select(
        "symbol", "threshold", "n_over", "n", ((1 - ratio) / 2).alias("shape"), (F.col("_m") * (1 + ratio) / 2).alias("scale")
    )


def pareto_likelihood(over: DataFrame) -> DataFrame:
    """The columns of :func:`pareto_fit` by most likelihood, and ``log_likelihood``.

    For a given ratio of shape to scale the shape is the mean of log(1 + ratio * excess), which
    leaves one number to search. Shapes of -1 and below are left out, where the likelihood has
    no bound. NULL under ten exceedances or three different ones.
    """
    rows = over.groupBy("symbol").agg(
        F.max("threshold").alias("threshold"), F.count("*").alias("n_over"), F.max("n").alias("n"), F.sort_array(F.collect_list("excess")).alias("x")
    )
    usable = (F.col("n_over") >= 10) & (F.size(F.array_distinct("x")) >= 3)
    most = F.array_max("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")

    def shape_of(x: Column, ratio: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + F.log1p(ratio * v)) / F.size(x)

    def fitted(s: Column) -> Column:
        # The ratio times the largest excess runs from just above -1 to far beyond what data can tell; its scale is logarithmic.
        ratio = lambda u: (F.exp(u) - 1) / s.most

        def worth(u: Column) -> Column:
            def value(shape: Column) -> Column:
                inner = -(F.log(F.when(F.abs(shape) < 1e-12, s.mean).otherwise(shape / ratio(u))) + shape + 1) * F.size(s.x)
                return F.when(shape > -1, inner)

            return bound(shape_of(s.x, ratio(u)), value)

        def result(best: Column) -> Column:
            def parts(shape: Column) -> Column:
                scale = F.when(F.abs(shape) < 1e-12, s.mean).otherwise(shape / ratio(best.at))
                return F.struct(shape.alias("shape"), scale.alias("scale"), best.value.alias("log_likelihood"))

            return bound(shape_of(s.x, ratio(best.at)), parts)

        return bound(highest(worth, F.lit(-12.0), F.lit(8.0), 41, 40), result)

    fit = F.when(usable, bound(F.struct(F.col("x").alias("x"), most.alias("most"), mean.alias("mean")), fitted))
    # An exploded array of one: the fit is not worked out again in later expressions or filters.
    df = rows.select("symbol", "threshold", "n_over", "n", F.explode(F.array(fit)).alias("fit"))
    return df.select("symbol", "threshold", "n_over", "n", "fit.shape", "fit.scale", "fit.log_likelihood")


def return_levels(fit: DataFrame, periods=RETURN_PERIODS) -> DataFrame:
    """Loss in percent expected once in each period."""
    df = fit.filter("shape IS NOT NULL AND scale > 0").withColumn("period", F.explode(F.array(*[F.lit(p) for p in periods])))
    term = F.col("n_over") / F.col("n") * F.col("period")
    level = F.when(F.abs("shape") < 1e-6, F.col("threshold") + F.col("scale") * F.log(term)).otherwise(
        F.col("threshold") + F.col("scale") / F.col("shape") * (F.pow(term, F.col("shape")) - 1)
    )
    return df.select("symbol", "period", (level * 100).alias("level_pct"))


def hill(returns: DataFrame, start: int = 10, cap: int | None = None) -> DataFrame:
    """Tail index against the number of order statistics of absolute returns.

    k stops at min(n - 2, max(start, n // 10)), and at ``cap`` where the caller sets one.
    """
    down = Window.partitionBy("symbol").orderBy(F.col("a").desc(), "date")
    df = returns.withColumn("a", F.abs("r")).withColumns({"n": F.count("*").over(whole()), "rank": F.row_number().over(down)})
    last = F.least(F.col("n") - 2, F.greatest(F.lit(start), F.floor(F.col("n") / 10)))
    if cap is not None:
        last = F.least(last, F.lit(cap))
    df = df.filter(F.col("rank") <= last + 1).withColumn("ln", F.when(F.col("a") > 1e-12, F.log("a")))
    top = down.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"mean": F.avg("ln").over(top), "next": F.lead("ln").over(down)})
    df = df.filter((F.col("rank") >= start) & (F.col("rank") <= last) & F.col("next").isNotNull())
    xi = F.col("mean") - F.col("next")
    return df.filter(F.abs(xi) >= 1e-9).select("symbol", F.col("rank").alias("k"), xi.alias("xi"))
