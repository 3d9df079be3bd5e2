"""Small fixtures with known answers, sinks and streams."""

import datetime as dt
import json
import math
import os
import time

import pytest
from pyspark.sql import functions as F

from barwright.operators import calendar as cal, features as fe, filings as fi, quality as q, upsert as up, volatility as vol
from barwright.streaming import filings as stream, quota


@pytest.fixture(scope="module")
def five(spark):
    rows = [
        ("X", dt.date(2022, 1, 1), 100.0, 102.0, 99.0, 101.0, 1000),
        ("X", dt.date(2022, 1, 2), 101.0, 103.0, 100.0, 102.0, 1100),
        ("X", dt.date(2022, 1, 3), 103.0, 105.0, 101.0, 104.0, 900),
        ("X", dt.date(2022, 1, 4), 102.0, 106.0, 101.0, 105.0, 1200),
        ("X", dt.date(2022, 1, 5), 105.0, 107.0, 103.0, 106.0, 1000),
    ]
    return spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double, volume long")


def test_first_two_rows_of_market_columns(five):
    a, b = fe.basic_market_columns(five).orderBy("date").limit(2).collect()
    assert a.daily_return is None and a.close_prev_close is None and a.open_close == 1.0 and a.high_low == 3.0
    assert math.isclose(b.daily_return, 1 / 101) and math.isclose(b.log_return, math.log(102 / 101))
    assert math.isclose(b.close_prev_close, 102 / 101)


def test_short_series_has_unknown_regime(five):
    out = vol.regimes(vol.rolling_volatility(five, [21])).select("vol_regime").distinct().collect()
    assert [r[0] for r in out] == ["Unknown"]


def test_known_holidays(spark):
    days = ["2021-01-01", "2021-12-31", "2023-04-07", "2022-06-20", "2021-06-18", "2021-12-24", "2018-12-05", "2024-03-28"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "date date")
    got = {str(r.date): r.h for r in df.select("date", cal.is_holiday().alias("h")).collect()}
    assert got == {
        "2021-01-01": True, "2021-12-31": False, "2023-04-07": True, "2022-06-20": True,
        "2021-06-18": False, "2021-12-24": True, "2018-12-05": True, "2024-03-28": False,
    }


def test_trading_days_per_year(spark):
    df = spark.createDataFrame([(dt.date(2023, 1, 1), dt.date(2023, 12, 31))], "first_date date, last_date date")
    assert cal.days(df, "trading").count() == 250


def test_saved_panel_keeps_other_years(spark, five, tmp_path):
    path, merged = str(tmp_path / "a"), str(tmp_path / "b")
    old = five.withColumn("date", F.add_months("date", -12))
    up.save_bars(old, path)
    up.save_bars(five, path)
    assert spark.read.parquet(path).count() == 10
    batch = five.filter("date = DATE '2022-01-01'").withColumn("close", F.lit(1.0))
    out = up.merge_bars(spark, path, batch, merged)
    assert out.count() == 10 and out.filter("close = 1.0").count() == 0


def test_upsert_replaces_only_idle_rows(spark, five):
    stored = five.withColumn("volume", F.when(F.dayofmonth("date") == 2, 0).otherwise(F.col("volume")).cast("long"))
    batch = five.withColumn("close", F.lit(7.0))
    got = {r.date.day: r.close for r in up.upsert_bars(stored, batch).collect()}
    assert got[2] == 7.0 and got[1] == 101.0


def test_infinities_leave_as_null(spark):
    df = spark.createDataFrame([(float("inf"), float("nan"), 1.5)], "a double, b double, c double")
    assert json.loads(up.json_records(df).first().record) == {"a": None, "b": None, "c": 1.5}


def test_frame_guards(five):
    with pytest.raises(ValueError):
        q.require_columns(five.drop("close"))
    row = q.frame_report(five.withColumn("close", F.when(F.dayofmonth("date") > 1, F.col("close")))).first()
    assert (row.rows, row.dates, row.closes, row.equal_lengths, row.empty) == (5, 5, 4, False, False)
    assert q.frame_report(five.filter("false")).first().empty
    assert q.close_column(five) == "close"


def test_unknown_formula_is_rejected(five):
    with pytest.raises(Exception, match="UNRESOLVED_COLUMN"):
        fe.add_formulas(five, {"x": "no_such_column + 1"})


def test_observed_metrics(five):
    df, seen = q.observed(five, "load", ["close"])
    df.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 5 and seen.get["nulls_close"] == 0


def _document(cik, accessions):
    n = len(accessions)
    recent = {"accessionNumber": accessions, "filingDate": [f"2024-01-{a[-2:]}" for a in accessions], "form": ["8-K"] * (n - 1)}
    return json.dumps({"cik": cik, "name": "n", "filings": {"recent": recent}})


def test_uneven_arrays_are_padded(spark):
    docs = spark.createDataFrame([(_document("1", ["a01", "a02"]),)], "doc string")
    rows = fi.filings(fi.submissions(docs)).orderBy("accession_number").collect()
    assert [r.form_type for r in rows] == ["8-K", None]


def _poll(spark, tmp_path, order, high_water):
    landed = tmp_path / "in"
    landed.mkdir()
    for i, name in enumerate(order):
        path = landed / f"{i}.json"
        path.write_text(_document("1", name) + "\n")
        os.utime(path, (time.time() - 100 + i, time.time() - 100 + i))
    rows = stream.filing_stream(stream.landed_documents(spark, str(landed), 1))
    rows = stream.above_mark(rows) if high_water else stream.without_repeats(rows, "3650 days")
    target = str(tmp_path / "out")
    stream.poll(rows, target, str(tmp_path / "state")).awaitTermination()
    return sorted(r.accession_number for r in spark.read.parquet(target).collect())


def test_poll_drops_repeats_and_keeps_late_rows(spark, tmp_path):
    got = _poll(spark, tmp_path, [["a03", "a04"], ["a01", "a02"], ["a03"]], high_water=False)
    assert got == ["a01", "a02", "a03", "a04"]


def test_high_water_poll_needs_order(spark, tmp_path):
    assert _poll(spark, tmp_path, [["a03", "a04"], ["a01", "a05"]], high_water=True) == ["a03", "a04", "a05"]


def test_quota_on_a_table(spark):
    rows = [("a", dt.datetime(2024, 1, 1, 0, 0, s)) for s in range(3)] + [("b", dt.datetime(2024, 1, 1, 0, 0, 1))]
    out = quota.over_quota(spark.createDataFrame(rows, "client string, ts timestamp"), limit=2).collect()
    assert [(r.client, r.n) for r in out] == [("a", 3)]


def test_guard_report_of_empty_and_all_missing_frames(spark):
    rows = [("a", 1.0, float("nan")), ("a", None, float("inf")), ("b", 2.0, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, x double, y double")
    got = {r.symbol: (r.rows, r.values_x, r.values_y, r.status) for r in q.guard_report(df, ["x", "y"], "symbol").collect()}
    assert got == {"a": (2, 1, 0, "all missing: y"), "b": (1, 1, 1, "ok")}
    assert q.guard_report(df.limit(0), ["x", "y"]).first().status == "empty"
    assert q.guard_report(df.filter("symbol = 'a'").drop("x").withColumn("x", F.lit(None).cast("double")), ["x", "y"]).first().status == "all missing: x,y"


def test_surplus_elements_of_parallel_arrays_are_counted(spark):
    doc = json.dumps({"cik": "1", "name": "n", "filings": {"recent": {"accessionNumber": ["a"], "filingDate": ["2020-01-01", "2020-01-02", "x"], "form": ["8-K"]}}})
    subs = fi.submissions(spark.createDataFrame([(doc,)], "doc string"))
    assert [(r.cik, r.column, r.surplus) for r in fi.surplus_elements(subs).collect()] == [("1", "filing_date", 2)]
    rows = fi.filings(subs)
    directory = spark.createDataFrame([("bb", "1"), ("aa", "1"), ("cc", "2")], "ticker string, cik string")
    kept = fi.filing_records(rows, directory, F.lit("2020-01-03").cast("timestamp")).collect()
    assert [(r.cik, r.symbol, r.fetched_at.year) for r in kept] == [("1", "AA", 2020)]


def test_outliers_of_a_whole_column_need_no_join(spark):
    from barwright.operators import distribution as dist

    df = spark.createDataFrame([(1.0,)] * 30 + [(50.0,)], "v double")
    out = dist.outlier_report(df, "v")
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.first().outlier_count == 1 and out.count() == 1
