"""The loader registry and the data source behind it."""

import datetime as dt
import sys

import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from barwright.session import run_folder
from barwright.sources import loaders, panel


@pytest.fixture(scope="module")
def folder(spark, sf_dir):
    path = run_folder(spark, "landed-test")
    loaders.land("stock", panel.bars(spark, sf_dir).repartition(3), path)
    return path


def test_unknown_names_and_classes_raise(spark):
    with pytest.raises(ValueError, match="unknown loader nowhere; known: index, stock, treasury"):
        loaders.load(spark, "nowhere", "/tmp")
    with pytest.raises(TypeError):
        loaders.register_loader("bad", object())
    assert loaders.loader_names() == ["index", "stock", "treasury"]


def test_files_are_partitions_and_years_are_pruned(spark, sf_dir, folder):
    whole = loaders.load(spark, "stock", folder)
    bars = panel.bars(spark, sf_dir)
    assert whole.exceptAll(bars).isEmpty() and whole.count() == bars.count()
    assert whole.rdd.getNumPartitions() > 3
    part = loaders.load(spark, "stock", folder, "1996-03-01", "1996-03-31")
    assert part.rdd.getNumPartitions() <= 3 < whole.rdd.getNumPartitions()
    assert part.exceptAll(bars.filter("date BETWEEN '1996-03-01' AND '1996-03-31'")).isEmpty()
    assert part.count() == bars.filter("date BETWEEN '1996-03-01' AND '1996-03-31'").count() > 0
    assert loaders.load(spark, "stock", folder, "2050-01-01").count() == 0


def test_filters_that_the_source_takes_and_leaves(spark, sf_dir, folder):
    bars = panel.bars(spark, sf_dir)
    symbol = bars.agg(F.min("symbol")).first()[0]
    for test in (
        f"symbol = '{symbol}' AND date > '1995-06-30'", f"symbol IN ('{symbol}', 'none') AND date < '1995-06-30'", "close > 10 AND date = '1996-05-14'",
        "date > '1996-01-01' AND date < '1995-01-01'", "date IS NULL OR symbol LIKE '%1'",
    ):
        got = loaders.load(spark, "stock", folder).filter(test)
        want = bars.filter(test)
        assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_pushed_filters_are_kept_apart():
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

    reader = loaders.LandedReader("/x", loaders.StockLoader())
    rest = list(reader.pushFilters([IsNotNull(("date",)), GreaterThan(("date",), dt.date(1996, 1, 1)), LessThan(("date",), dt.date(1996, 3, 1)), EqualTo(("symbol",), "A"), EqualTo(("close",), 1.0)]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull", "EqualTo"]
    assert (reader.first, reader.last, reader.symbols) == (dt.date(1996, 1, 2), dt.date(1996, 2, 29), frozenset(["A"]))


class PipeLoader(loaders.Loader):
    schema = "date date, note string"
    written = ("text", {})

    def batches(self, stream):
        lines = stream.read().decode().splitlines()
        parts = [line.split("|") for line in lines]
        yield pa.RecordBatch.from_arrays([pa.array([dt.date.fromisoformat(p[0]) for p in parts]), pa.array([p[1] for p in parts])], names=["date", "note"])


def test_a_loader_of_ones_own(spark):
    path = run_folder(spark, "pipes")
    spark.createDataFrame([("1999-01-04|a",), ("1999-02-05|b",)], "v string").write.text(path)
    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers cannot import this file
    loaders.register_loader("pipe", PipeLoader())
    try:
        assert sorted(r.note for r in loaders.load(spark, "pipe", path).collect()) == ["a", "b"]
        assert [r.note for r in loaders.load(spark, "pipe", path, "1999-02-01").collect()] == ["b"]
    finally:
        del loaders._LOADERS["pipe"]
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_missing_text_is_null_and_missing_volume_zero(spark):
    path = run_folder(spark, "gaps")
    spark.createDataFrame([("Symbol,Date,Open,High,Low,Close,Volume",), ("A,1999-01-04 00:00:00,1.5,,N/A,2,",)], "v string").coalesce(1).write.text(path)
    assert [tuple(r) for r in loaders.load(spark, "stock", path).collect()] == [("A", dt.date(1999, 1, 4), 1.5, None, None, 2.0, 0)]
