"""Least squares as array expressions: small systems solved inside the generated plan, a row each."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, also where ``use`` reads it within a lambda."""
    return F.get(F.transform(F.array(value), lambda v: use(v)), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def reduced(system: Column, steps: Column) -> Column:
    """``system`` after elimination of its first ``steps`` columns without pivots.

    A symmetric system is an array of rows, each from its diagonal on. What is left are the
    rows behind: for the cross products of some variables, those of the later ones less what
    the first ``steps`` explain. A zero on the diagonal makes NULLs, and so a NULL result.
    """

    def step(rows: Column, _: Column) -> Column:
        def out(lead: Column) -> Column:
            def without(share: Column) -> Column:
                return F.transform(
                    F.slice(rows, F.lit(2), F.size(rows)),
                    lambda row, i: bound(F.get(lead, i + 1) * share, lambda by: F.zip_with(row, F.slice(lead, i + 2, F.size(lead)), lambda x, y: x - by * y)),
                )

            return bound(F.try_divide(F.lit(1.0), F.get(lead, F.lit(0))), without)

        return bound(F.get(rows, F.lit(0)), out)

    return F.aggregate(F.sequence(F.lit(1), steps), system, step)


def cross_products(columns: Column) -> Column:
    """Sums of products of ``columns``, an array of arrays of one length, each row from its diagonal on."""
    return F.transform(columns, lambda a, i: F.transform(F.slice(columns, i + 1, F.size(columns)), lambda b: dot(a, b)))


def normal_share(z: Column, terms: int = 120) -> Column:
    """Standard normal distribution function, by its series of terms of one sign; exact to some 1e-15 for |z| < 8."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.struct(F.abs(z).alias("term"), F.abs(z).alias("total")),
        lambda s, k: bound(s["term"] * z * z / (2 * k + 1), lambda t: F.struct(t.alias("term"), (s["total"] + t).alias("total"))),
        lambda s: s["total"],
    )
    # Fixed value: one over the root of two pi.
    half = series * F.exp(-z * z / 2) * 0.3989422804014327
    inner = F.when(z >= 0, 0.5 + half).otherwise(0.5 - half)
    return F.when(z <= -8, 0.0).when(z >= 8, 1.0).otherwise(F.greatest(inner, F.lit(0.0)))


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0: Stirling's series eight places up, and back down."""
    y = x + 8
    # Fixed value: half the logarithm of two pi.
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * F.pow(y, F.lit(5))) - 1 / (1680 * F.pow(y, F.lit(7)))
    down = x
    for i in range(1, 8):
        down = down * (x + i)
    return series - F.log(down)


def highest(f, low: Column, high: Column, grid: int = 10, steps: int = 25) -> Column:
    """struct(at, value): where ``f`` is highest between two bounds, by a grid and then the golden section.

    The grid finds the stretch that is searched, so that ``f`` may have several tops as long as
    the highest one shows on the grid. A NULL or NaN counts as lowest.
    """
    worth = lambda v: F.when(F.isnan(v), F.lit(float("-inf"))).otherwise(F.coalesce(v, F.lit(float("-inf"))))
    # Fixed value: the golden section.
    gold = 0.6180339887498949

    def search(found: Column) -> Column:
        width = (high - low) / grid
        a, b = F.greatest(found.at - width, low), F.least(found.at + width, high)

        def start(e: Column) -> Column:
            x, y = e.b - gold * (e.b - e.a), e.a + gold * (e.b - e.a)
            return F.struct(e.a.alias("a"), e.b.alias("b"), x.alias("x"), y.alias("y"), worth(f(x)).alias("fx"), worth(f(y)).alias("fy"))

        def step(s: Column, _: Column) -> Column:
            left = s.fx >= s.fy
            a, b = F.when(left, s.a).otherwise(s.x), F.when(left, s.y).otherwise(s.b)
            new = F.when(left, b - gold * (b - a)).otherwise(a + gold * (b - a))

            def put(z: Column) -> Column:
                return bound(worth(f(z)), lambda fz: F.struct(
                    a.alias("a"), b.alias("b"), F.when(left, z).otherwise(s.y).alias("x"), F.when(left, s.x).otherwise(z).alias("y"),
                    F.when(left, fz).otherwise(s.fy).alias("fx"), F.when(left, s.fx).otherwise(fz).alias("fy"),
                ))

            return bound(new, put)

        ends = bound(F.struct(a.alias("a"), b.alias("b")), start)
        best = lambda s: F.when(s.fx >= s.fy, F.struct(s.x.alias("at"), s.fx.alias("value"))).otherwise(F.struct(s.y.alias("at"), s.fy.alias("value")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), ends, step, best)

    places = F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda i: low + (high - low) * i / grid)
    tried = F.transform(places, lambda x: F.struct(worth(f(x)).alias("value"), x.alias("at")))
    return bound(F.array_max(tried), search)
