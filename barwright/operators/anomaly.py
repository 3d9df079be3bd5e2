"""Z-scores and density noise of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import by_date, log_return, rolling, simple_return, whole
from barwright.operators import calendar as cal
from barwright.operators.alignment import interpolate, reindex
from barwright.operators.solver import bound

# Thresholds and model parameters.
Z_LIMIT, MODIFIED_LIMIT = 3.0, 3.5
MAD_SCALE = 0.6744897501960817
EPS, MIN_POINTS = 0.5, 5
FEATURES = ["log_return", "volatility", "volume_pct_change"]


def z_scores(df: DataFrame, value: str, spec=None, scale: float = 0.6745) -> DataFrame:
    """Population z-score and the modified z-score about the median.

    The median absolute deviation is normal-scaled and the result is multiplied by
    ``scale`` once more, as users of the measure expect; pass 1.0 to leave that out.
    """
    v, spec = F.col(value), spec or whole()
    df = df.withColumns(
        {"_m": F.avg(v).over(spec), "_s": F.stddev_pop(v).over(spec), "_med": F.percentile(v, F.lit(0.5)).over(spec)}
    )
    df = df.withColumn("_mad", F.percentile(F.abs(v - F.col("_med")), F.lit(0.5)).over(spec) / MAD_SCALE)
    return df.withColumns(
        {
            "z": F.try_divide(v - F.col("_m"), F.col("_s")),
            "mod_z": F.lit(scale) * F.try_divide(v - F.col("_med"), F.col("_mad")),
        }
    ).drop("_m", "_s", "_med", "_mad")


def is_z_anomaly() -> Column:
    return F.coalesce(F.abs("z") > Z_LIMIT, F.lit(False)) | F.coalesce(F.abs("mod_z") > MODIFIED_LIMIT, F.lit(False))


def z_anomalies(bars: DataFrame) -> DataFrame:
    """Scores and flag of close, volume and log return in long form."""
    df = bars.select("symbol", "date", "close", F.col("volume").cast("double").alias("volume"), log_return().alias("log_return"))
    long = df.unpivot(["symbol", "date"], ["close", "volume", "log_return"], "measure", "value").filter("value IS NOT NULL")
    scored = z_scores(long, "value", Window.partitionBy("symbol", "measure"))
    return scored.withColumn("is_anomaly", is_z_anomaly())


def features(bars: DataFrame) -> DataFrame:
    """Log return, 21-day volatility and volume change; rows with all three."""
    df = bars.withColumn("_v", F.nullif(F.col("volume"), F.lit(0))).select(
        "symbol", "date", log_return().alias("log_return"), simple_return("_v").alias("volume_pct_change")
    )
    vol = rolling(F.stddev_samp("log_return"), "log_return", 21) * F.sqrt(F.lit(252.0))
    return df.withColumn("volatility", vol).select("symbol", "date", *FEATURES).dropna(subset=FEATURES)


def density_noise(feats: DataFrame, eps: float = EPS, min_points: int = MIN_POINTS) -> DataFrame:
    """Flag the points of each series that density clustering leaves as noise.

    Points fall into cells whose diagonal is ``eps``: in a cell of ``min_points`` all are
    dense, without looking at a pair. Only points of thinner cells are compared with those of
    their series, which the calendar bounds; a point that is not dense is noise unless a dense
    one is in reach. Rows are dealt by symbol once: pairs are met in a hash table where they
    lie and counted as they are met, so that none is stored.
    """
    spec = whole()
    at = [F.coalesce(F.try_divide(F.col(c) - F.avg(c).over(spec), F.stddev_pop(c).over(spec)), F.lit(0.0)) for c in FEATURES]
    axes = [f"x{i}" for i in range(len(FEATURES))]
    points = feats.select("symbol", "date", *[x.alias(n) for n, x in zip(axes, at, strict=True)], F.row_number().over(by_date()).alias("i"))
    side = eps / len(FEATURES) ** 0.5
    points = points.withColumn("held", F.count("*").over(Window.partitionBy("symbol", *[F.floor(F.col(n) / side) for n in axes])))

    def beside(some: DataFrame, looking: Column, others: DataFrame) -> DataFrame:
        """``some`` with how many of ``others`` lie within ``eps`` of each row that is ``looking``."""
        there = others.select(F.col("symbol").alias("there"), *[F.col(n).alias(f"y{n}") for n in axes]).hint("shuffle_hash")
        far = sum(((F.col(f"y{n}") - F.col(n)) ** 2 for n in axes), F.lit(0.0))
        close = (F.col("symbol") == F.col("there")) & looking & F.col("date").isNotNull() & (F.abs(F.col("yx0") - F.col("x0")) <= 2 * eps) & (far <= eps * eps)
        return some.join(there, close, "left").groupBy(*some.columns).agg(F.count("there").alias("near"))

    counted = beside(points, F.col("held") < min_points, points)
    points = counted.withColumn("dense", (F.col("held") >= min_points) | (F.col("near") >= min_points)).drop("near", "held")
    out = beside(points, ~F.col("dense"), points.filter("dense"))
    return out.select("symbol", "date", (~F.col("dense") & (F.col("near") == 0)).alias("dbscan_anomaly"))


# Fixed value: pairs of axes of one sweep of rotations; a symmetric matrix of three is diagonal long before ten sweeps.
ROTATIONS = [(0, 1), (0, 2), (1, 2)] * 10


def _times(a: Column, b: Column, flip: bool = False) -> Column:
    """Product of two matrices of three, as arrays of nine; ``flip`` takes the first one's transpose."""
    at = lambda i, k: F.get(a, F.lit(3 * k + i if flip else 3 * i + k))
    return F.array(*[sum((at(i, k) * F.get(b, F.lit(3 * k + j)) for k in range(1, 3)), at(i, 0) * F.get(b, F.lit(j))) for i in range(3) for j in range(3)])


def principal_axes(matrix: Column) -> Column:
    """array<struct<value, axis>> of a symmetric matrix of three (an array of nine), largest value first.

    Jacobi's rotations, a fixed number of them. The largest loading of an axis is positive.
    """
    one = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])

    def rotated(state: Column, pair: Column) -> Column:
        def turn(angle: Column) -> Column:
            tan = F.when(angle.off == 0, 0.0).otherwise(F.try_divide(F.when(angle.tau >= 0, 1.0).otherwise(-1.0), F.abs(angle.tau) + F.sqrt(1 + angle.tau * angle.tau)))
            return bound(F.coalesce(tan, F.lit(0.0)), lambda t: bound(1 / F.sqrt(1 + t * t), lambda c: plane(c, t * c)))

        def plane(c: Column, s: Column) -> Column:
            cell = lambda i, j: F.when((pair.p == i) & (pair.p == j) | (pair.q == i) & (pair.q == j), c).when(
                (pair.p == i) & (pair.q == j), s).when((pair.q == i) & (pair.p == j), -s).otherwise(1.0 if i == j else 0.0)
            return F.array(*[cell(i, j) for i in range(3) for j in range(3)])

        def applied(r: Column) -> Column:
            return F.struct(bound(_times(r, state.m, True), lambda x: _times(x, r)).alias("m"), _times(state.v, r).alias("v"))

        off = F.get(state.m, 3 * pair.p + pair.q)
        tau = F.coalesce(F.try_divide(F.get(state.m, 4 * pair.q) - F.get(state.m, 4 * pair.p), 2 * off), F.lit(0.0))
        return bound(bound(F.struct(off.alias("off"), tau.alias("tau")), turn), applied)

    pairs = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p, q in ROTATIONS])

    def ordered(s: Column) -> Column:
        axes = F.array(*[F.struct(F.get(s.m, F.lit(4 * i)).alias("value"), F.array(*[F.get(s.v, F.lit(3 * k + i)) for k in range(3)]).alias("axis")) for i in range(3)])
        most = lambda a: F.array_max(F.transform(a, lambda x: F.abs(x)))
        sign = lambda a: F.when(F.get(F.filter(a, lambda x: F.abs(x) == most(a)), F.lit(0)) < 0, -1.0).otherwise(1.0)
        return F.transform(F.reverse(F.array_sort(axes)), lambda x: F.struct(x.value.alias("value"), F.transform(x.axis, lambda y: y * sign(x.axis)).alias("axis")))

    return bound(F.aggregate(pairs, F.struct(matrix.alias("m"), one.alias("v")), rotated), ordered)


def projected(feats: DataFrame) -> DataFrame:
    """(symbol, date, pca_1, pca_2): the features of each series on their two main axes.

    Features are standardised first, so the axes are those of the correlations: one aggregate
    a series. A feature that does not vary is zero everywhere.
    """
    pairs = [(a, b) for a in range(3) for b in range(3)]
    corr = lambda a, b: F.lit(1.0) if a == b else F.coalesce(F.corr(FEATURES[min(a, b)], FEATURES[max(a, b)]), F.lit(0.0))
    moments = [f(c).alias(f"{k}_{c}") for c in FEATURES for k, f in (("mean", F.avg), ("spread", F.stddev_pop))]
    axes = feats.groupBy("symbol").agg(*moments, F.array(*[corr(a, b) for a, b in pairs]).alias("matrix"))
    axes = axes.withColumn("axes", principal_axes(F.col("matrix"))).select("*", F.col("axes")[0]["axis"].alias("first"), F.col("axes")[1]["axis"].alias("second"))
    df = feats.join(axes, "symbol")
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"mean_{c}"), F.col(f"spread_{c}")), F.lit(0.0)) for c in FEATURES]
    on = lambda axis: sum((z[i] * F.get(axis, F.lit(i)) for i in range(1, 3)), z[0] * F.get(axis, F.lit(0)))
    return df.select("symbol", "date", on("first").alias("pca_1"), on("second").alias("pca_2"))


def clustering_table(feats: DataFrame) -> DataFrame:
    """Both axes of every point with the flag of density clustering."""
    return projected(feats).join(density_noise(feats), ["symbol", "date"])


#: Trees of the isolation score and the share of days that is flagged.
TREES, SHARE = 100, 0.05
# Fixed value: Euler's constant.
EULER = 0.5772156649015329


def _expected_depth(n: Column) -> Column:
    """Mean depth of an unsuccessful search among ``n`` points, which a cut-off branch of that size would add."""
    return F.when(n > 2, 2 * (F.log((n - 1).cast("double")) + EULER) - 2 * (n - 1) / n).when(n == 2, 1.0).otherwise(0.0)


def _draw(what: str) -> Column:
    """A number from 0 to 1 that depends on series, tree and node alone, so that reruns agree."""
    text = F.concat_ws("/", F.lit(what), "symbol", F.col("tree").cast("string"), F.col("node").cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / 281474976710656.0


def isolation_scores(feats: DataFrame, trees: int = TREES, share: float = SHARE) -> DataFrame:
    """(symbol, date, score, isolated): how early random cuts set a day apart from the others of its series.

    Every tree holds all days of the series. It grows level by level: the days of a node are
    cut at a random place between the least and the largest value of a random feature, down to
    single days, to days that do not differ in that feature, or to the depth at which a
    balanced tree would be done. Scores near 1 are set apart early. Flagged are scores above the
    quantile that leaves ``share``. Nodes are windows within (symbol, tree), by which the rows
    are dealt once; a hot series is spread over its trees.
    """
    sizes = feats.groupBy("symbol").agg(F.count("*").alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    df = feats.join(sizes, "symbol").withColumn("limit", F.ceil(F.log2(F.greatest("n", F.lit(2)).cast("double"))))
    df = df.select("symbol", "date", "n", "limit", F.array(*FEATURES).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
    df = df.withColumns({"node": F.lit(1).cast("long"), "path": F.lit(None).cast("double")})
    spec = Window.partitionBy("symbol", "tree", "node")
    levels = max(most - 1, 1).bit_length()
    for depth in range(levels + 1):
        df = df.withColumn("v", F.get("x", F.floor(_draw("feature") * len(FEATURES)).cast("int")))
        df = df.withColumns({"held": F.count("*").over(spec), "low": F.min("v").over(spec), "high": F.max("v").over(spec)})
        ends = (F.col("held") == 1) | (F.col("low") == F.col("high")) | (F.col("limit") <= depth)
        path = F.coalesce("path", F.when(ends, depth + _expected_depth(F.col("held"))))
        cut = F.col("low") + _draw("place") * (F.col("high") - F.col("low"))
        node = F.when(path.isNotNull(), F.col("node")).otherwise(2 * F.col("node") + (F.col("v") >= cut).cast("long"))
        df = df.select("symbol", "date", "n", "limit", "x", "tree", node.alias("node"), path.alias("path"))
    scores = df.groupBy("symbol", "date", "n").agg(F.avg("path").alias("path"))
    score = F.when(F.col("n") > 1, F.pow(F.lit(2.0), -F.col("path") / _expected_depth(F.col("n"))))
    scores = scores.select("symbol", "date", score.alias("score"))
    scores = scores.withColumn("edge", F.percentile("score", F.lit(1 - share)).over(whole()))
    return scores.select("symbol", "date", "score", F.coalesce(F.col("score") > F.col("edge"), F.lit(False)).alias("isolated"))


def regular_closes(bars: DataFrame) -> DataFrame:
    """Closes on every trading day between the first and last bar, gaps blended by time."""
    closes = bars.select("symbol", "date", "close").filter("close IS NOT NULL")
    grid = cal.days(cal.span_of(closes, "symbol"), "trading")
    return interpolate(reindex(closes, grid), "close")
