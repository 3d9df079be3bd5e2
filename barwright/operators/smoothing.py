"""Local regression of each series on time, with passes that weigh outliers down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.operators.solver import bound

#: Share of a series that a local line is fitted to, and how often outliers are weighed down.
FRACTION, PASSES = 0.25, 3


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _starts(x: Column, k: Column) -> Column:
    """For each place the start of its ``k`` nearest neighbours: the frame moves on while the next value is nearer than its first."""

    def step(state: Column, v: Column) -> Column:
        # From where it stands the frame moves past every start that is farther away than the value that would come in.
        ahead = F.filter(F.sequence(state.at, F.size(x) - k), lambda a: (a == F.size(x) - k) | (v <= (F.get(x, a) + F.get(x, (a + k).cast("int"))) / 2))
        return bound(F.array_min(ahead), lambda a: F.struct(a.alias("at"), F.concat(state.out, F.array(a)).alias("out")))

    return F.aggregate(x, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), step, lambda s: s.out)


def _line(x: Column, y: Column, weights: Column, start: Column, k: Column, here: Column, own: Column) -> Column:
    """Value at ``here`` of the line through ``k`` neighbours, weighed by nearness and by ``weights``."""

    def with_frame(f: Column) -> Column:
        radius = F.greatest(here - F.get(f.x, F.lit(0)), F.element_at(f.x, -1) - here)
        near = lambda v, r: bound(F.abs(v - here) / r, lambda d: bound(1 - d * d * d, lambda c: c * c * c))
        w = bound(radius, lambda r: F.zip_with(f.x, f.w, lambda v, own_w: near(v, r) * own_w))
        return F.when(radius > 0, bound(w, lambda w: with_weights(f, w))).otherwise(own)

    def with_weights(f: Column, w: Column) -> Column:
        total, used = _total(w), F.size(F.filter(w, lambda v: v > 0))
        return F.when((total > 0) & (used > 1), bound(F.struct(total.alias("t"), (_total(F.zip_with(w, f.x, lambda a, v: a * v)) / total).alias("m")), lambda c: fitted(f, w, c))).otherwise(own)

    def fitted(f: Column, w: Column, c: Column) -> Column:
        spread = _total(F.zip_with(w, f.x, lambda a, v: a * (v - c.m) * (v - c.m)))
        mean = _total(F.zip_with(w, f.y, lambda a, v: a * v)) / c.t
        tilt = F.zip_with(F.zip_with(w, f.x, lambda a, v: a * (v - c.m)), f.y, lambda a, v: a * v)
        return mean + (here - c.m) * F.coalesce(F.try_divide(_total(tilt), spread), F.lit(0.0))

    cut = lambda a: F.slice(a, start + 1, k)
    return bound(F.struct(cut(x).alias("x"), cut(y).alias("y"), cut(weights).alias("w")), with_frame)


def _median(values: Column) -> Column:
    n = F.size(values)
    return bound(F.array_sort(values), lambda s: (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def _reweighted(y: Column, line: Column) -> Column:
    """Weights that fall to zero at six times the median distance from the line."""

    def weigh(far: Column) -> Column:
        def one(m: Column) -> Column:
            share = lambda v: F.when(m > 0, F.least(v / (6 * m), F.lit(1.0))).otherwise((v > 0).cast("double"))
            return F.transform(far, lambda v: bound(share(v), lambda u: (1 - u * u) * (1 - u * u)))

        return bound(_median(far), one)

    return bound(F.zip_with(y, line, lambda a, b: F.abs(a - b)), weigh)


def lowess(series: DataFrame, fraction: float = FRACTION, passes: int = PASSES) -> DataFrame:
    """(symbol, date, x, trend): a local line through the nearest ``fraction`` of each series (symbol, date, x).

    Nearness is in days and counts by the cube; after each of ``passes`` passes values far from
    the line count less. Rows without a value are left out. Where fewer than two neighbours
    belong to a line the trend is NULL; where all weight lies on one the trend is the value.
    A series is one row while it is worked on, bounded by the calendar.
    """
    day = F.datediff("date", F.lit("1970-01-01").cast("date")).cast("double")
    rows = series.filter("x IS NOT NULL").groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", day.alias("day"), F.col("x").cast("double").alias("x")))).alias("rows"))
    # The rows are few but each costs much: a stated number of partitions is not merged by size.
    spark = series.sparkSession
    rows = rows.repartition(2 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "symbol")
    k = F.floor(F.size("rows") * fraction + 1e-10).cast("int")
    frame = F.struct(F.transform("rows", lambda r: r.day).alias("x"), F.transform("rows", lambda r: r.x).alias("y"), k.alias("k"))

    def smooth(s: Column) -> Column:
        def with_starts(starts: Column) -> Column:
            def fit(weights: Column) -> Column:
                return F.transform(s.x, lambda here, i: _line(s.x, s.y, weights, F.get(starts, i), s.k, here, F.get(s.y, i)))

            def again(line: Column, _: Column) -> Column:
                return bound(_reweighted(s.y, line), fit)

            even = F.transform(s.x, lambda _: F.lit(1.0))
            first = bound(even, fit)
            return F.aggregate(F.sequence(F.lit(1), F.lit(passes)), first, again) if passes else first

        return bound(_starts(s.x, s.k), with_starts)

    trend = F.when(k >= 2, bound(frame, smooth)).otherwise(F.transform("rows", lambda _: F.lit(None).cast("double")))
    out = rows.select("symbol", F.explode(F.arrays_zip(F.col("rows"), trend.alias("trend"))).alias("z"))
    return out.select("symbol", "z.rows.date", "z.rows.x", "z.trend")
