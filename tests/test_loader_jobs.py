"""Jobs over all loaders: what fails stays by itself."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from barwright.operators import jobs
from barwright.session import run_folder

D = dt.date
BARS = "symbol string, date date, close double, volume long"


def bars(spark, *rows):
    return spark.createDataFrame([(s, D(2020, 1, d), c, v) for s, d, c, v in rows], BARS)


def test_failing_loaders_give_their_error_and_stop_none(spark, tmp_path):
    good = bars(spark, ("A", 1, 1.0, 5), ("A", 3, 2.0, None))
    # Files that can be listed and have a schema, but break when they are read.
    broken = str(tmp_path / "broken")
    good.coalesce(1).write.parquet(broken)
    schema = spark.read.parquet(broken).schema
    for f in os.listdir(broken):
        if f.startswith("part"):
            data = open(f"{broken}/{f}", "rb").read()
            open(f"{broken}/{f}", "wb").write(b"junk" + data[4:-200] + b"x" * 200)
    spec = lambda df: (df, ["symbol", "date"], "close", ["volume"])

    def raises():
        raise KeyError("no settings")

    loaders = {
        "gone": lambda: spec(spark.read.parquet(str(tmp_path / "none"))), "broken": lambda: spec(spark.read.schema(schema).parquet(broken)),
        "raises": raises, "column": lambda: spec(good.drop("close")), "good": lambda: spec(good),
    }
    got = jobs.checks_of_each(spark, loaders).collect()
    errors = {r.loader: r.error for r in got if r.error}
    assert set(errors) == {"gone", "broken", "raises", "column"} and errors["gone"] == "PATH_NOT_FOUND" and errors["raises"] == "KeyError"
    values = {r.item: r.value for r in got if r.loader == "good"}
    assert values["missing_dates"] == 1 and values["nulls_volume"] == 1 and values["mean"] == 1.5
    assert jobs.checks_of_each(spark, {}).count() == 0


def test_gaps_are_filled_by_key_from_whatever_day(spark):
    stored = bars(spark, ("A", 3, 1.0, 1), ("B", 9, 1.0, 1))
    landed = bars(spark, ("A", 2, 9.0, 9), ("A", 3, 9.0, 9), ("A", 4, 9.0, 9), ("A", 20, 9.0, 9), ("B", 5, 9.0, 9), ("C", 1, 9.0, 9))
    got = {(r.symbol, r.date.day, r.close) for r in jobs.filled(jobs.Landing(stored, landed)).collect()}
    assert got == {("A", 3, 1.0), ("B", 9, 1.0), ("A", 4, 9.0), ("C", 1, 9.0)}
    none = jobs.Landing(stored.limit(0), landed)
    assert jobs.filled(none).count() == 5 and jobs.filled(jobs.Landing(stored.limit(0), landed, ())).count() == 5
    assert jobs.filled(jobs.Landing(stored, landed.limit(0))).count() == 2
    one = jobs.Landing(stored, landed, ())
    assert {(r.symbol, r.date.day) for r in jobs.filled(one, F.lit("2020-01-31").cast("date")).collect()} == {("A", 3), ("B", 9), ("A", 20)}


def test_last_days_are_replaced(spark):
    stored = bars(spark, ("A", 1, 1.0, 1), ("A", 8, 1.0, 1), ("A", 10, 1.0, 1))
    landed = bars(spark, ("A", 1, 9.0, 9), ("A", 9, 9.0, 9), ("A", 10, 9.0, 9), ("A", 11, 9.0, 9))
    got = {(r.date.day, r.close) for r in jobs.reloaded(jobs.Landing(stored, landed), 3).collect()}
    assert got == {(1, 1.0), (9, 9.0), (10, 9.0)}
    assert jobs.reloaded(jobs.Landing(stored.limit(0), landed), 3).count() == 0


def test_checks_follow_a_write(spark):
    path = run_folder(spark, "checked")
    got = jobs.write_checked(bars(spark, ("A", 1, 1.0, 5), ("A", 1, 3.0, 5), ("A", 4, 2.0, None)), path, "stock", ["symbol", "date"], "close", ["volume"])
    values = {r.item: r.value for r in got.collect()}
    assert values["rows"] == 3 and values["duplicate_keys"] == 1 and values["nulls_volume"] == 1 and values["last_day"] - values["first_day"] == 3
    assert spark.read.parquet(path).count() == 3
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        jobs.write_checked(bars(spark, ("A", 1, 1.0, 5)), path, "stock", ["symbol", "date"], "close", ["volume"])
