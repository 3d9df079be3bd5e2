"""Windows worked on as arrays, against numpy, and plans that keep no row for each pair or frame."""

import datetime as dt
import re

import numpy as np
import pytest

from barwright.operators import anomaly as an, correlation as cor, momentum as mo, tail as ta, volatility as vo
from barwright.plans import load_all

DAY = dt.date(2001, 1, 1)
QUERIES, _ = load_all()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def frame(spark, values, columns):
    """One series a key; every array is a column."""
    rows = [(s, DAY + dt.timedelta(days=i), *[None if v is None else float(v) for v in row]) for s, vs in values.items() for i, row in enumerate(zip(*vs))]
    return spark.createDataFrame(rows, "symbol string, date date, " + ", ".join(f"{c} double" for c in columns))


@pytest.mark.parametrize("name", ["density_noise", "clustering_table"])
def test_noise_is_counted_where_the_series_lies(spark, sf_dir, name):
    """No row is repeated for the cells in reach, and points are dealt by symbol alone."""
    text = plan(QUERIES[name](spark, sf_dir))
    assert "Generate explode" not in text and not re.search(r"Exchange hashpartitioning\(symbol#\d+, c0", text)


def test_noise_by_definition(spark):
    rng = np.random.default_rng(5)
    x = {s: rng.standard_t(2, size=(3, n)) for s, n in (("a", 200), ("b", 40), ("c", 1))}
    got = {(r.symbol, r.date): r.dbscan_anomaly for r in an.density_noise(frame(spark, x, an.FEATURES)).collect()}
    assert len(got) == 241 and len(set(got.values())) == 2
    for s, v in x.items():
        spread = v.std(axis=1, keepdims=True)
        z = np.where(spread > 0, (v - v.mean(axis=1, keepdims=True)) / np.where(spread > 0, spread, 1), 0).T
        near = ((z[:, None] - z[None]) ** 2).sum(axis=2) <= 0.25
        noise = ~(near & (near.sum(axis=1) >= 5)[None]).any(axis=1)
        assert [got[s, DAY + dt.timedelta(days=i)] for i in range(len(z))] == noise.tolist()


@pytest.mark.parametrize("name", ["rolling_correlations", "rolling_volatility", "volatility_cone", "volatility_term_structure", "rolling_var", "rolling_return_acf", "rolling_volatility_acf"])
def test_no_frame_is_worked_out_anew(spark, sf_dir, name):
    assert not re.search(r"(corr|stddev_samp|collect_list|sum)\([^\n]*windowspecdefinition", plan(QUERIES[name](spark, sf_dir)))


def test_correlations_of_what_does_not_move(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=(2, 1200))
    df = frame(spark, {"a": [a, b, np.ones(1200)], "still": [np.ones(70), b[:70], b[:70]], "short": [a[:5], b[:5], b[:5]]}, [cor.STOCK, "X", "Y"])
    got = {(r.symbol, r.date, r.asset): r.correlation for r in cor.rolling_correlations(df, 63).collect()}
    assert len(got) == 1200 - 62
    for i in (62, 500, 1199):
        assert np.isclose(got["a", DAY + dt.timedelta(days=i), "X"], np.corrcoef(a[i - 62 : i + 1], b[i - 62 : i + 1])[0, 1])


def test_volatility_skips_rows_without_a_return(spark):
    close = [10.0, 11.0, None, 12.0, 13.0, 15.0, 14.0, 14.0]
    df = vo.rolling_volatility(frame(spark, {"a": [close]}, ["close"]), [3])
    got = [r.vol_3d for r in df.orderBy("date").collect()]
    r = np.log([11 / 10, 13 / 12, 15 / 13, 14 / 15, 1.0])
    want = [None, None, None, None, None, *[np.std(r[i - 2 : i + 1], ddof=1) * 252**0.5 for i in (2, 3, 4)]]
    want = [None] * 5 + want[5:]
    assert [g is None for g in got] == [w is None for w in want] and np.allclose(got[5:], want[5:])
    assert df.columns == ["symbol", "date", "close", "log_return", "vol_3d"]
    cone = vo.cone(df, [3]).collect()
    assert len(cone) == 1 and np.isclose(cone[0].median, np.median(want[5:])) and np.isclose(cone[0].current, want[-1])


def test_shortfall_and_lags_of_long_series(spark):
    x = np.random.default_rng(7).normal(size=1300)
    got = {r.date: r for r in ta.rolling_var(frame(spark, {"a": [x]}, ["r"]), 63).collect()}
    assert len(got) == 1300 - 62
    w = x[1299 - 62 :]
    q = np.quantile(w, 0.05)
    last = got[DAY + dt.timedelta(days=1299)]
    assert np.isclose(last.var_pct, -q * 100) and np.isclose(last.cvar_pct, -w[w <= q].mean() * 100)
    close = np.concatenate([[100.0], 100 * np.cumprod(1 + x / 50)])
    acf = {r.date: r for r in mo.rolling_acf(frame(spark, {"a": [close]}, ["close"]), 40, 3).collect()}
    d = (x / 50)[1299 - 40 : 1299]
    d = d - d.mean()
    assert len(acf) == 1300 - 40 and np.isclose(acf[DAY + dt.timedelta(days=1300)].acf_2, (d[2:] * d[:-2]).sum() / (d @ d))


def test_missing_dates_are_not_grouped(spark, sf_dir):
    """One aggregate for the bars of either side and one for the spans, none behind the join."""
    text = plan(QUERIES["missing_date_difference"](spark, sf_dir))
    assert "HashAggregate" not in text[: text.index("LeftAnti")]
