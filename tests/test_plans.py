"""What plans must not hold, and rules checked against independent definitions."""

import datetime as dt

import numpy as np
import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from barwright.operators import calendar as cal, features as fe, momentum as mo, tail as ta, upsert as up
from barwright.plans import load_all

QUERIES, _ = load_all()
MERGES = ["bar_upsert", "daily_update", "historical_load", "insert_absent_bars", "metric_insert", "filing_write", "company_upsert", "yield_upsert", "latest_feed_wins"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", MERGES)
def test_merges_hold_no_sort_aggregate(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "SortAggregate" not in text and "WindowGroupLimit" not in text


@pytest.mark.parametrize("name", ["feature_information", "quality_checks"])
def test_no_nested_loop_join(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    assert "NestedLoop" not in text and "CartesianProduct" not in text


def test_keep_one_takes_first_and_last(spark):
    df = spark.createDataFrame([("a", 1, None, "x"), ("a", 1, 2, "y"), (None, 3, 1, "z"), (None, 3, 4, "w")], "k string, o int, p int, v string")
    last = {r.k: r.v for r in up.keep_one(df, ["k"], ["o", "p"]).collect()}
    first = {r.k: r.v for r in up.keep_one(df, ["k"], ["o", "p"], last=False).collect()}
    assert last == {"a": "y", None: "w"} and first == {"a": "x", None: "z"}


def test_good_friday_of_any_year(spark):
    got = spark.range(1583, 2600).select(F.col("id").cast("int").alias("y")).select("y", cal.good_friday(F.col("y")).alias("d")).collect()
    assert all(r.d == easter(r.y) - dt.timedelta(days=2) for r in got)


@pytest.mark.parametrize("year,closed", [
    (1975, ["1975-01-01", "1975-02-17", "1975-03-28", "1975-05-26", "1975-07-04", "1975-09-01", "1975-11-27", "1975-12-25"]),
    (1965, ["1965-01-01", "1965-02-22", "1965-04-16", "1965-05-31", "1965-07-05", "1965-09-06", "1965-11-25", "1965-12-24"]),
    (2120, ["2120-01-01", "2120-01-15", "2120-02-19", str(easter(2120) - dt.timedelta(days=2)), "2120-05-27", "2120-06-19", "2120-07-04", "2120-09-02", "2120-11-28", "2120-12-25"]),
])
def test_trading_days_of_a_year(spark, year, closed):
    span = spark.sql(f"SELECT DATE '{year}-01-01' AS first_date, DATE '{year}-12-31' AS last_date")
    got = {r.date.isoformat() for r in cal.days(span, "trading").collect()}
    every = [dt.date(year, 1, 1) + dt.timedelta(days=i) for i in range(366)]
    want = {d.isoformat() for d in every if d.year == year and d.weekday() < 5 and d.isoformat() not in closed}
    assert got == want


def test_hill_has_no_cap(spark):
    rng = np.random.default_rng(1)
    start = dt.date(1950, 1, 1)
    rows = [("A", start + dt.timedelta(days=i), float(x)) for i, x in enumerate(rng.standard_t(3, 8000))]
    got = ta.hill(spark.createDataFrame(rows, "symbol string, date date, r double"))
    assert got.agg(F.max("k")).first()[0] == 800


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = {"a": rng.normal(size=1001), "b": np.round(rng.exponential(size=1001), 1) - 0.3, "c": np.full(1001, 7.0)}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], "a double, b double, c double")
    cuts = [0.1, 0.25, 0.5, 0.9]
    got = {r.feature: r.edges for r in fe.quantiles(df, list(data), cuts).collect()}
    for name, x in data.items():
        assert np.allclose(got[name], np.quantile(x, cuts), rtol=1e-12, atol=1e-12)


def test_folds_list_every_row_of_short_series(spark):
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), 10.0 + i % 3) for i in range(5)]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    assert [r.macd for r in mo.macd(bars).collect()] == [None] * 5
    assert [r.rsi for r in mo.rsi(bars).collect()] == [None] * 5


def test_folds_over_many_pieces_equal_pandas(spark):
    import pandas as pd

    x = 50 + np.cumsum(np.random.default_rng(4).normal(size=300))
    rows = [("S", dt.date(2020, 1, 1) + dt.timedelta(days=i), float(v)) for i, v in enumerate(x)]
    got = mo.macd(spark.createDataFrame(rows, "symbol string, date date, close double")).orderBy("date").toPandas()
    s = pd.Series(x)
    line = s.ewm(span=12, adjust=False, min_periods=12).mean() - s.ewm(span=26, adjust=False, min_periods=26).mean()
    assert np.allclose(got["macd"], line, equal_nan=True)
    assert np.allclose(got["macd_signal"], line.ewm(span=9, adjust=False, min_periods=9).mean(), equal_nan=True)
