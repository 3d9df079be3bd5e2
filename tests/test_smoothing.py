"""Local regression against one written out in numpy."""

import datetime as dt

import numpy as np

from barwright.operators import smoothing as sm

DAY = dt.date(2000, 1, 3)


def by_hand(x, y, fraction, passes):
    n = len(x)
    k = int(fraction * n + 1e-10)
    weights = np.ones(n)
    for turn in range(passes + 1):
        fit, left = y.copy(), 0
        for i in range(n):
            while left + k < n and x[i] > (x[left] + x[left + k]) / 2:
                left += 1
            xs, ys = x[left : left + k], y[left : left + k]
            radius = max(x[i] - xs[0], xs[-1] - x[i])
            w = (1 - (np.abs(xs - x[i]) / radius) ** 3) ** 3 * weights[left : left + k]
            if w.sum() <= 0 or (w > 0).sum() < 2:
                continue
            a = np.column_stack([np.ones(k), xs - x[i]]) * np.sqrt(w)[:, None]
            fit[i] = np.linalg.lstsq(a, ys * np.sqrt(w), rcond=None)[0][0]
        far = np.abs(y - fit)
        m = np.median(far)
        u = np.minimum(far / (6 * m), 1) if m > 0 else (far > 0).astype(float)
        weights = (1 - u * u) ** 2
    return fit


def test_lowess_equals_numpy(spark):
    rng = np.random.default_rng(7)
    values = {}
    for s, n in (("a", 60), ("b", 41), ("short", 6)):
        days = np.sort(rng.choice(4 * n, n, replace=False)).astype(float)
        values[s] = (days, np.sin(days / 20) + 0.2 * rng.normal(size=n) + 3.0 * (rng.random(n) < 0.06))
    rows = [(s, DAY + dt.timedelta(days=int(d)), float(v)) for s, (x, y) in values.items() for d, v in zip(x, y)] + [("a", DAY - dt.timedelta(days=9), None)]
    df = spark.createDataFrame(rows, "symbol string, date date, x double")
    for fraction, passes in ((0.25, 3), (0.4, 0)):
        out = sm.lowess(df, fraction, passes)
        assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
        got = out.collect()
        for s in ("a", "b"):
            mine = [r.trend for r in sorted(got, key=lambda r: r.date) if r.symbol == s]
            assert np.allclose(mine, by_hand(*values[s], fraction, passes), atol=1e-8)
        assert len(got) == 107 and (fraction > 0.3 or all(r.trend is None for r in got if r.symbol == "short"))


def test_a_line_and_a_constant_stay_as_they_are(spark):
    rows = [("line", DAY + dt.timedelta(days=i), 2.0 + 0.5 * i) for i in range(40)] + [("flat", DAY + dt.timedelta(days=3 * i), 4.0) for i in range(30)]
    got = sm.lowess(spark.createDataFrame(rows, "symbol string, date date, x double")).collect()
    assert all(abs(r.trend - r.x) < 1e-9 for r in got) and len(got) == 70
