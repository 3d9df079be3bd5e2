"""Least squares in the plan against numpy, and plans without Python workers."""

import datetime as dt
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barwright.operators import solver, stationarity as st
from barwright.sources import panel

DAY = dt.date(2000, 1, 3)


def series(spark, values):
    """(symbol, date, x) of {symbol: list}."""
    rows = [(s, DAY + dt.timedelta(days=i), float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, date date, x double")


def walk(n, seed, pull=0.0):
    rng = np.random.default_rng(seed)
    out = [10.0]
    for e in rng.normal(0, 1, n - 1):
        out.append(out[-1] - pull * (out[-1] - 10) + e)
    return np.array(out)


def partial(x, lags):
    out = []
    for k in range(1, lags + 1):
        rows = np.array([[1.0, *x[t - 1 :: -1][:k]] for t in range(k, len(x))])
        out.append(np.linalg.lstsq(rows, x[k:], rcond=None)[0][-1])
    return np.array(out)


def native(df):
    assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
    return df


def test_reduced_is_the_schur_complement(spark):
    rng = np.random.default_rng(3)
    a = rng.normal(size=(9, 6))
    a = a.T @ a
    rows = [a[i, i:].tolist() for i in range(6)]
    got = spark.createDataFrame([(rows,)], "m array<array<double>>").select(solver.reduced(F.col("m"), F.lit(4)).alias("r")).first().r
    want = a[4:, 4:] - a[4:, :4] @ np.linalg.solve(a[:4, :4], a[:4, 4:])
    assert np.allclose(got[0], want[0], rtol=1e-9) and np.allclose(got[1], want[1, 1:], rtol=1e-9)


def test_normal_share(spark):
    zs = [-9.0, -7.5, -3.2, -1.0, -1e-9, 0.0, 0.4, 2.5, 7.9, 8.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", solver.normal_share(F.col("z")).alias("p")).collect()
    for r in got:
        assert math.isclose(r.p, 0.5 * math.erfc(-r.z / math.sqrt(2)), abs_tol=2e-15)


def test_partial_autocorrelations(spark):
    values = {"a": walk(260, 1, 0.3), "b": np.diff(walk(301, 2)), "short": walk(15, 3), "flat": np.ones(80)}
    got = native(st.pacf(series(spark, values), 9)).collect()
    for s in ("a", "b"):
        rows = sorted((r.lag, r.pacf, r.band) for r in got if r.symbol == s)
        assert rows[0] == (0, 1.0, 0.0) and np.allclose([r[1] for r in rows[1:]], partial(values[s], 9), atol=1e-10)
        assert all(math.isclose(r[2], 1.959963984540054 / math.sqrt(len(values[s]))) for r in rows[1:])
    assert [(r.lag, r.pacf) for r in got if r.symbol == "short"] == [(0, None)]
    assert all(r.pacf is None for r in got if r.symbol == "flat" and r.lag)


def test_rolling_partial_autocorrelations(spark):
    values = {"a": walk(60, 1, 0.3), "b": np.concatenate([np.ones(35), walk(30, 2)]), "short": walk(36, 3)}
    got = native(st.rolling_pacf(series(spark, values), 30, 7)).collect()
    for s in ("a", "b"):
        x = values[s]
        want = {DAY + dt.timedelta(days=i): partial(x[i - 30 : i], 7) for i in range(30, len(x)) if x[i - 30 : i].var(ddof=1) >= 1e-10}
        rows = {r.date: r for r in got if r.symbol == s}
        assert set(rows) == set(want)
        for d, w in want.items():
            if np.isfinite(w).all() and len(set(x[(d - DAY).days - 30 : (d - DAY).days - 3])) > 8:
                assert np.allclose([rows[d][f"pacf_{k}"] for k in range(1, 8)], w, atol=1e-7)
    assert not [r for r in got if r.symbol == "short"]
    with pytest.raises(ValueError):
        st.rolling_pacf(series(spark, values), 10, 7)


def by_hand(y):
    """(lags, statistic) of the test regression with a constant."""
    n = len(y)
    dy = np.diff(y)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)

    def fit(cut, lags):
        t = np.arange(cut, n - 1)
        x = np.column_stack([np.ones(len(t)), y[t], *[dy[t - j] for j in range(1, lags + 1)]])
        beta, *_ = np.linalg.lstsq(x, dy[t], rcond=None)
        rest = ((dy[t] - x @ beta) ** 2).sum()
        return x, beta, rest, len(t)

    best = min((fit(most, p)[3] * math.log(fit(most, p)[2]) + 2 * p, p) for p in range(most + 1))[1]
    x, beta, rest, m = fit(best, best)
    error = math.sqrt(rest / (m - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1])
    return best, beta[1] / error


def test_unit_root(spark):
    values = {"walk": walk(300, 5), "pulled": walk(300, 6, 0.4), "lagged": np.cumsum(np.convolve(walk(300, 8, 0.9), [1, 0.6, 0.3])), "part": walk(70, 7), "tiny": walk(3, 2), "flat": np.full(130, 4.0)}
    bars = series(spark, values).withColumnRenamed("x", "close")
    got = {r.symbol: r for r in native(st.unit_root(bars)).collect()}
    for s in ("walk", "pulled", "lagged", "part"):
        lags, stat = by_hand(values[s][-120:])
        assert got[s].lags == lags and math.isclose(got[s].stat, stat, rel_tol=1e-7) and got[s].reason is None
    assert got["pulled"].p_value < 0.01 < 0.05 < got["walk"].p_value
    assert (got["tiny"].stat, got["tiny"].reason) == (None, "too few rows")
    assert (got["flat"].p_value, got["flat"].reason) == (None, "constant")


def test_published_points_of_the_surface(spark):
    """Five- and one-per-cent values of the test's distribution for long series with a constant."""
    got = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,), (5.0,), (-30.0,), (None,)], "t double").select("t", st.unit_root_share(F.col("t")).alias("p")).collect()
    p = {r.t: r.p for r in got}
    assert abs(p[-3.43] - 0.01) < 0.001 and abs(p[-2.86] - 0.05) < 0.002 and abs(p[-2.57] - 0.10) < 0.003
    assert (p[5.0], p[-30.0], p[None]) == (1.0, 0.0, None)


def test_registered_queries_agree_with_numpy(spark, sf_dir):
    from barwright.plans import load_all

    queries, _ = load_all()
    x = st.returns_of(panel.bars(spark, sf_dir)).toPandas().sort_values("date")
    symbol = x["symbol"].min()
    mine = x.loc[x["symbol"] == symbol, "x"].to_numpy()
    rows = queries["return_pacf"](spark, sf_dir).filter(F.col("symbol") == symbol).orderBy("lag").collect()
    assert np.allclose([r.pacf for r in rows[1:]], partial(mine, 30), atol=1e-6)


def test_principal_axes_equal_numpy(spark):
    from barwright.operators import anomaly as an

    rng = np.random.default_rng(4)
    mats = [m.T @ m for m in rng.normal(size=(12, 5, 3))] + [np.eye(3), np.zeros((3, 3)), np.diag([1.0, 3.0, 2.0])]
    got = spark.createDataFrame([(i, m.flatten().tolist()) for i, m in enumerate(mats)], "i int, m array<double>").select("i", an.principal_axes(F.col("m")).alias("a")).collect()
    for r in got:
        m = mats[r.i]
        assert np.allclose([x.value for x in r.a], np.linalg.eigvalsh(m)[::-1], atol=1e-9)
        axes = np.array([x.axis for x in r.a])
        assert np.allclose(axes @ axes.T, np.eye(3), atol=1e-9)
        assert np.allclose(m @ axes.T, axes.T * [x.value for x in r.a], atol=1e-8)
        assert all(a[np.abs(a).argmax()] > 0 for a in axes)


def test_peaks_by_definition(spark):
    from barwright.operators import spectral as sp

    rng = np.random.default_rng(9)
    values = {"r": rng.integers(0, 6, 60).astype(float), "flat": np.ones(9), "one": np.array([1.0]), "up": np.arange(7.0), "ends": np.array([5.0, 1, 3, 3, 3, 2, 9])}
    rows = [(s, k, k / 100, float(v)) for s, vs in values.items() for k, v in enumerate(vs)]
    got = native(sp.spectral_peaks(spark.createDataFrame(rows, "symbol string, k long, frequency double, amplitude double"), 0.0, 100)).collect()
    want = set()
    for s, vs in values.items():
        for low in range(1, len(vs) - 1):
            high = low
            while high + 1 < len(vs) and vs[high + 1] == vs[low]:
                high += 1
            if vs[low - 1] < vs[low] and high + 1 < len(vs) and vs[high + 1] < vs[low]:
                k = (low + high) // 2
                left = [i for i in range(k) if vs[i] > vs[k]]
                right = [i for i in range(k, len(vs)) if vs[i] > vs[k]]
                a = vs[(left[-1] if left else 0) : k + 1].min()
                b = vs[k : (right[0] if right else len(vs))].min()
                want.add((s, k, vs[k] - max(a, b)))
    assert {(r.symbol, r.k, r.prominence) for r in got} == want and ("ends", 3, 1.0) in want


def test_uneven_periodogram_is_a_least_squares_fit(spark):
    """Power is what a sine, a cosine and a free mean explain of the variation."""
    from barwright.operators import spectral as sp

    rng = np.random.default_rng(2)
    days = np.sort(rng.choice(200, 70, replace=False))
    days = days - days[0]
    y = np.sin(2 * np.pi * days / 17) + 0.3 * rng.normal(size=70)
    rows = [("a", DAY + dt.timedelta(days=int(d)), float(v)) for d, v in zip(days, y)] + [("b", DAY, 1.0), ("c", DAY, 2.0), ("c", DAY + dt.timedelta(days=400), 2.5)]
    got = native(sp.uneven_periodogram(spark.createDataFrame(rows, "symbol string, date date, close double"), samples=3)).orderBy("j").collect()
    i = np.arange(70)
    x = y - np.polyval(np.polyfit(i, y, 1), i)
    assert {r.symbol for r in got} == {"a"}
    for r in got:
        z = np.column_stack([np.ones(70), np.cos(2 * np.pi * r.frequency * days), np.sin(2 * np.pi * r.frequency * days)])
        fit = z @ np.linalg.lstsq(z, x, rcond=None)[0]
        assert math.isclose(r.power, 1 - ((x - fit) ** 2).sum() / ((x - x.mean()) ** 2).sum(), abs_tol=1e-9)
    best = max(got, key=lambda r: r.power)
    assert abs(best.period - 17) < 1 and len(got) == int(3 * days[-1] * (0.5 - 2 / days[-1]))


def test_spectra_and_projection_stay_in_the_plan(spark, sf_dir):
    from barwright.plans import load_all

    queries, _ = load_all()
    for name in ("amplitude_spectrum", "spectral_peaks", "uneven_periodogram", "clustering_table", "rolling_hurst", "phase_macd_hurst"):
        native(queries[name](spark, sf_dir))


def test_logistic_model_is_at_its_optimum(spark):
    """The learner behind ``model_holdout``: coefficients on scaled features against a descent in numpy."""
    from barwright.operators import models

    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2)) * [1.0, 5.0]
    y = (x[:, 0] - 0.2 * x[:, 1] + rng.normal(size=150) > 0).astype(float)
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, label double").coalesce(1)
    scaler, model = models.fit(df, ["a", "b"], "logistic_regression")
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w, b = np.zeros(2), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        w, b = w - 0.5 * (z.T @ (p - y) / 150 + 0.01 * w), b - 0.5 * (p - y).mean()
    assert np.allclose(model.coefficients.toArray(), w, atol=2e-3) and math.isclose(model.intercept, b, abs_tol=2e-3)
    predicted = models.predict(df, ["a", "b"], (scaler, model)).collect()
    assert [r.predicted for r in predicted] == [float(v) for v in (z @ w + b > 0)]
    with pytest.raises(ValueError):
        models.fit(df, ["a", "b"], "oracle")


def test_wavelet_gives_back_what_went_in(spark):
    from barwright.operators import wavelet as wv

    rng = np.random.default_rng(1)
    values = {"a": rng.normal(size=203), "b": rng.normal(size=56), "c": rng.normal(size=14), "tiny": rng.normal(size=9)}
    df = series(spark, values).withColumnRenamed("x", "r")
    got = native(wv.discrete_wavelet(df, detrend=False)).collect()
    assert [(r.level, r.coefficient) for r in got if r.symbol == "tiny"] == [(None, None)]
    low, high = np.array(wv.LOW)[::-1], np.array(wv.HIGH)[::-1]
    for s, levels in (("a", 4), ("b", 3), ("c", 1)):
        rows = [r for r in got if r.symbol == s]
        take = lambda part, level: np.array([r.coefficient for r in sorted(rows, key=lambda r: r.k or 0) if (r.part, r.level) == (part, level)])  # noqa: E731, B023
        assert {r.level for r in rows} == set(range(1, levels + 1))
        x = take("approximation", levels)
        for level in range(levels, 0, -1):
            d = take("detail", level)
            x = x[: len(d)]
            up = np.zeros((2, 2 * len(d)))
            up[0, ::2], up[1, ::2] = x, d
            x = np.convolve(up[0], low) + np.convolve(up[1], high)
            x = x[6 : 6 + 2 * len(d) - 6]
        assert np.allclose(x[: len(values[s])], values[s], atol=1e-10)
    assert {r.level for r in wv.discrete_wavelet(df, 2).filter("symbol = 'a'").collect()} == {1, 2}


def test_isolation_finds_planted_days_and_repeats_itself(spark):
    from barwright.operators import anomaly as an

    rng = np.random.default_rng(8)
    rows = [("a", DAY + dt.timedelta(days=i), *map(float, rng.normal(size=3) + (9.0 if i in (20, 77) else 0.0))) for i in range(120)]
    rows += [("one", DAY, 1.0, 2.0, 3.0)] + [("same", DAY + dt.timedelta(days=i), 1.0, 2.0, 3.0) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, date date, log_return double, volatility double, volume_pct_change double")
    got = native(an.isolation_scores(df, 30)).collect()
    assert len(got) == len(rows)
    mine = {(r.date - DAY).days: r for r in got if r.symbol == "a"}
    top = sorted(mine, key=lambda i: -mine[i].score)[:2]
    assert set(top) == {20, 77} and mine[20].isolated and mine[77].isolated
    assert sum(r.isolated for r in mine.values()) == 6 and all(0 < r.score < 1 for r in mine.values())
    assert not any(r.isolated for r in got if r.symbol != "a") and [r.score for r in got if r.symbol == "one"] == [None]
    again = an.isolation_scores(df.repartition(5), 30).collect()
    assert {(r.symbol, r.date): r.isolated for r in again} == {(r.symbol, r.date): r.isolated for r in got}
    assert an.isolation_scores(df.limit(0), 3).count() == 0


def test_partial_autocorrelations_send_no_running_sums(spark):
    """Thirty lags of long series against numpy; beside the deal by symbol nothing is sent."""
    values = {"a": walk(400, 11, 0.3), "b": np.diff(walk(90, 12)), "edge": walk(64, 13, 0.5)}
    for df in (st.pacf(series(spark, values), 30), st.rolling_pacf(series(spark, values), 60, 12)):
        plan = native(df)._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION" not in plan and "explode" not in plan
    got = {(r.symbol, r.lag): r.pacf for r in st.pacf(series(spark, values), 30).collect()}
    for s in ("a", "b"):
        assert np.allclose([got[s, k] for k in range(1, 31)], partial(values[s], 30), atol=1e-9)
    rows = {(r.symbol, r.date): r for r in st.rolling_pacf(series(spark, values), 60, 12).collect()}
    assert len(rows) == 340 + 29
    for s, i in (("a", 60), ("a", 399), ("b", 75)):
        r = rows[s, DAY + dt.timedelta(days=i)]
        assert np.allclose([r[f"pacf_{k}"] for k in range(1, 13)], partial(values[s][i - 60 : i], 12), atol=1e-9)


def test_spectrum_meets_frequencies_once_for_eight_rows(spark):
    from barwright.operators import spectral as sp

    rng = np.random.default_rng(21)
    values = {str(n): rng.normal(size=n) for n in (2, 7, 8, 9, 61)} | {"1": np.ones(1)}
    df = native(sp.amplitude_spectrum(series(spark, values).withColumnRenamed("x", "r")))
    assert re.search(r"t#\d+L? % 8", df._jdf.queryExecution().executedPlan().toString())
    got = {(r.symbol, r.k): r for r in df.collect()}
    want = 0
    for s, y in values.items():
        n, t = len(y), np.arange(len(y))
        if n > 1:
            x = (y - np.polyval(np.polyfit(t, y, 1), t)) * (0.5 - 0.5 * np.cos(2 * np.pi * t / n))
            amplitude = 2 / n * np.abs(np.fft.fft(x))[: n // 2]
            want += n // 2
            for k, a in enumerate(amplitude):
                assert math.isclose(got[s, k].amplitude, a, abs_tol=1e-12) and math.isclose(got[s, k].frequency, k / n)
    assert len(got) == want


def test_periodogram_meets_frequencies_once_for_eight_rows(spark):
    """Series of every rest modulo eight, dates with gaps, against least squares."""
    from barwright.operators import spectral as sp

    rng = np.random.default_rng(31)
    data = {}
    for n in (3, 8, 9, 15, 16, 29):
        days = np.cumsum(rng.integers(1, 6, n))
        data[str(n)] = (days - days[0], rng.normal(size=n) + 50.0)
    rows = [(s, DAY + dt.timedelta(days=int(d)), float(v)) for s, (x, y) in data.items() for d, v in zip(x, y)]
    df = native(sp.uneven_periodogram(spark.createDataFrame(rows, "symbol string, date date, close double"), least_period=2.7, samples=4))
    assert re.search(r"i#\d+L? % 8", df._jdf.queryExecution().executedPlan().toString())
    got = df.collect()
    for s, (days, y) in data.items():
        mine = [r for r in got if r.symbol == s]
        n, count = len(y), math.floor(4 * days[-1] * (1 / 2.7 - 2 / days[-1]))
        assert len(mine) == (count if count > 1 else 0)
        x = y - np.polyval(np.polyfit(np.arange(n), y, 1), np.arange(n))
        for r in mine if n > 3 else []:
            z = np.column_stack([np.ones(n), np.cos(2 * np.pi * r.frequency * days), np.sin(2 * np.pi * r.frequency * days)])
            fit = z @ np.linalg.lstsq(z, x, rcond=None)[0]
            assert math.isclose(r.power, 1 - ((x - fit) ** 2).sum() / ((x - x.mean()) ** 2).sum(), abs_tol=1e-8)
