"""Fits by likelihood against searches in numpy and published values."""

import datetime as dt
import math

import numpy as np
from pyspark.sql import functions as F

from barwright.operators import solver, tail as ta

DAY = dt.date(2000, 1, 3)


def returns(spark, values):
    rows = [(s, DAY + dt.timedelta(days=i), float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, date date, r double")


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.5, 7.0, 60.0, 500.5]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", solver.log_gamma(F.col("x")).alias("g")).collect()
    assert all(math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-10, abs_tol=1e-10) for r in got)


def test_highest_of_a_function_with_two_tops(spark):
    got = spark.createDataFrame([(1.0,)], "c double").select(solver.highest(lambda x: F.sin(3 * x) * F.col("c") + x / 5, F.lit(0.0), F.lit(4.0), 10, 45).alias("h")).first().h
    xs = np.linspace(0, 4, 400001)
    ys = np.sin(3 * xs) + xs / 5
    assert abs(got.at - xs[ys.argmax()]) < 1e-5 and math.isclose(got.value, ys.max(), abs_tol=1e-9)


def test_student_quantiles_equal_published_ones(spark):
    # Published 5 % points of Student's distribution.
    known = {1.0: -6.313752, 2.0: -2.919986, 5.0: -2.015048, 30.0: -1.697261, 1000.0: -1.646379}
    got = spark.createDataFrame([(f,) for f in known], "f double").select("f", ta.student_quantile(F.col("f"), 0.05).alias("q")).collect()
    assert all(math.isclose(r.q, known[r.f], abs_tol=2e-6) for r in got)


def likelihood(x, f, m, s):
    z = (x - m) / s
    return len(x) * (math.lgamma((f + 1) / 2) - math.lgamma(f / 2) - 0.5 * math.log(math.pi * f) - math.log(s)) - (f + 1) / 2 * np.log1p(z * z / f).sum()


def test_student_fit_is_the_most_likely(spark):
    rng = np.random.default_rng(5)
    values = {"heavy": 0.01 * rng.standard_t(3, 500) + 0.002, "mild": 3 * rng.standard_t(8, 400), "light": rng.uniform(-1, 1, 300), "flat": np.ones(20), "one": [0.1]}
    df = ta.student_var(returns(spark, values))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    got = {r.symbol: r for r in df.collect()}
    assert set(got) == {"heavy", "mild", "light"} and got["light"].at_bound and not got["heavy"].at_bound
    for s in ("heavy", "mild"):
        r, x = got[s], np.array(values[s])
        best = likelihood(x, r.freedom, r.location, r.scale)
        for f in (0.98, 1.0, 1.02):
            for m in (-0.01, 0.0, 0.01):
                for g in (0.99, 1.0, 1.01):
                    assert likelihood(x, r.freedom * f, r.location + m * r.scale, r.scale * g) <= best + 1e-4
        draws = r.location + r.scale * np.random.default_rng(1).standard_t(r.freedom, 2_000_000)
        q = np.quantile(draws, 0.05)
        assert math.isclose(r["var"], q, rel_tol=0.01) and math.isclose(r.cvar, draws[draws <= q].mean(), rel_tol=0.05)
    x = np.array(values["light"])
    assert math.isclose(got["light"]["var"], x.mean() - 1.6449 * x.std(), rel_tol=0.02)
    methods = {(r.symbol, r.method) for r in ta.var_comparison(returns(spark, values), student=True).collect()}
    assert ("heavy", "Parametric (t)") in methods and ("flat", "Parametric (t)") not in methods


def test_pareto_fit_is_the_most_likely(spark):
    rng = np.random.default_rng(3)
    draw = lambda shape, scale, n: scale / shape * ((1 - rng.random(n)) ** -shape - 1)
    values = {"heavy": draw(0.4, 2.0, 300), "light": draw(-0.3, 1.0, 200), "even": rng.exponential(1.0, 250), "few": np.array([1.0] * 6), "same": np.array([1.0] * 30)}
    rows = [(s, 0.5, float(v), 1000) for s, vs in values.items() for v in vs]
    got = {r.symbol: r for r in ta.pareto_likelihood(spark.createDataFrame(rows, "symbol string, threshold double, excess double, n long")).collect()}
    assert got["few"].shape is None and got["same"].shape is None and got["heavy"].n_over == 300
    for s in ("heavy", "light", "even"):
        r, x = got[s], values[s]

        def worth(shape, scale):
            z = 1 + shape * x / scale
            return -np.inf if (z <= 0).any() else -len(x) * math.log(scale) - (1 + 1 / shape) * np.log(z).sum()

        assert math.isclose(worth(r.shape, r.scale), r.log_likelihood, abs_tol=1e-6)
        grid = [worth(a, b) for a in r.shape + np.linspace(-0.3, 0.3, 61) if abs(a) > 1e-9 for b in r.scale * np.linspace(0.7, 1.3, 61)]
        assert max(grid) <= r.log_likelihood + 1e-6
    assert abs(got["heavy"].shape - 0.4) < 0.15 and abs(got["light"].shape + 0.3) < 0.15 and abs(got["even"].shape) < 0.15
