"""The rolling Hurst exponent against numpy, and how its work grows with its window."""

import datetime as dt
import math
import re

import numpy as np

from barwright.operators import momentum as mo

DAY = dt.date(2024, 1, 1)


def exponents(close: list[float | None], window: int, sizes: list[int]) -> dict[int, float | None]:
    """Exponent before each row of one series, chunk by chunk."""
    c = np.array([np.nan if v is None else v for v in close], float)
    out = {}
    for i in range(window, len(c)):
        w = c[i - window : i]
        if np.isnan(w).all() or np.nanstd(w) < 1e-9:
            continue
        points = []
        for s in sizes:
            found = []
            for j in range(window // s):
                x = w[j * s : (j + 1) * s]
                steps = [b / a - 1 for a, b in zip(x, x[1:]) if a and not math.isnan(a) and not math.isnan(b)]
                x = x[~np.isnan(x)]
                if len(x) and x.min() and len(steps) > 1 and np.ptp(steps) and x.max() != x.min():
                    found.append((x.max() / x.min() - 1) / np.std(steps, ddof=1))
            points.append(math.log10(np.mean(found)) if found else None)
        out[i] = None if None in points else np.polyfit(np.log10(sizes), points, 1)[0]
    return out


def test_rolling_hurst_is_that_of_its_chunks(spark):
    rng = np.random.default_rng(5)
    walk = lambda n: (100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))).round(2).tolist()
    holes = walk(260)
    for k in rng.choice(260, 40, replace=False):
        holes[k] = None
    burst = walk(150)
    burst[20] = 1e7
    series = {
        "a": walk(240), "short": walk(100), "next": walk(101), "holes": holes, "burst": burst, "none": [None] * 130, "rest": [5.0] * 130,
        "stops": walk(60) + [7.25] * 130 + walk(60), "zero": [*walk(50), 0.0, *walk(99)], "doubles": [2.0**k for k in range(130)],
    }
    rows = [(s, DAY + dt.timedelta(days=k), v) for s, x in series.items() for k, v in enumerate(x)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    for window, sizes in ((100, mo.HURST_SIZES), (40, [10, 17, 31])):
        got = {(r.symbol, (r.date - DAY).days): r.hurst for r in mo.rolling_hurst(bars, window, tuple(sizes)).collect()}
        want = {(s, i): v for s, x in series.items() for i, v in exponents(x, window, sizes).items()}
        assert got.keys() == want.keys()
        for k, v in want.items():
            assert (got[k] is None) == (v is None) and (v is None or math.isclose(got[k], v, rel_tol=1e-7, abs_tol=1e-9)), k


def test_no_frame_of_rolling_hurst_is_evaluated_anew(spark):
    """lags only, whose cost does not follow the window; rate of change and exponent need no join."""
    bars = spark.createDataFrame([("a", DAY, 1.0)], "symbol string, date date, close double")
    plan = mo.rolling_hurst(bars)._jdf.queryExecution().executedPlan().toString()
    assert "lag(" in plan and not re.search("(stddev|max|min|avg|count|sum)\\w*\\(", plan)
    plan = mo.phase_table(bars, "roc", "hurst")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_phase_of_hurst_has_rows_that_have_both(spark):
    rng = np.random.default_rng(6)
    rows = [(s, DAY + dt.timedelta(days=k), float(v)) for s in ("a", "b", None) for k, v in enumerate(50 + np.cumsum(rng.normal(0, 0.1, 140)))]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    hurst = {(r.symbol, r.date): r.hurst for r in mo.rolling_hurst(bars).collect()}
    closes = {(s, d): v for s, d, v in rows}
    for momentum in ("roc", "macd"):
        got = mo.phase_table(bars, momentum, "hurst").collect()
        assert len(got) == 80 and {r.symbol for r in got} == {"a", "b"}
        for r in got:
            assert r.reversion == hurst[r.symbol, r.date] and r.elapsed == (r.date - DAY).days - 100
            if momentum == "roc":
                assert math.isclose(r.momentum, 100 * (closes[r.symbol, r.date] / closes[r.symbol, r.date - dt.timedelta(days=20)] - 1), abs_tol=1e-9)
