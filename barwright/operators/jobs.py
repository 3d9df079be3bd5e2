"""Loader jobs that run over every loader, one failing loader apart from the others.

A loader is named and made when its turn comes, so that an unreadable folder fails there and
nowhere else. What a job makes of a loader is written to the shared folder before the next one
runs: a file that turns out broken while it is read fails its own loader too. The result holds
a row with the error for each loader that failed, and all rows of those that did not.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.operators.quality import quality_checks
from barwright.session import run_folder


@dataclass
class Landing:
    """What is stored of a loader, what has landed, and what identifies a row beside its date."""

    stored: DataFrame
    landed: DataFrame
    keys: tuple[str, ...] = ("symbol",)


def error_of(error: Exception) -> str:
    """A name of what went wrong that does not change from run to run: the condition that Spark gives, else the class."""
    if isinstance(error, PySparkException) and error.getCondition():
        return error.getCondition()
    text = str(error)
    start = text.find("[")
    if text and start >= 0 and "]" in text[start:] and text[start + 1 : text.index("]", start)].replace("_", "").replace(".", "").isupper():
        return text[start + 1 : text.index("]", start)]
    return type(error).__name__


def each_loader(spark: SparkSession, loaders: dict[str, Callable], job: Callable[..., DataFrame], schema: str) -> DataFrame:
    """(loader, columns of ``schema``, error): ``job(name, made)`` of every loader, each by itself.

    ``schema`` are the columns of a job's result; they are NULL in the row of a loader that
    failed. Every loader is tried, in the order given. No loaders, no rows.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    whole = f"loader string, {schema}, error string"
    out = spark.createDataFrame([], whole)
    for name, make in loaders.items():
        path = run_folder(spark, f"loader-{name}")
        try:
            made = job(name, make())
            made.select(F.lit(name).alias("loader"), *columns, F.lit(None).cast("string").alias("error")).write.parquet(path)
            part = spark.read.schema(whole).parquet(path)
        except Exception as error:  # noqa: BLE001  whatever a loader meets is its own
            part = spark.createDataFrame([(name, *[None] * len(columns), error_of(error))], whole)
        out = out.unionByName(part)
    return out


def checks_of_each(spark: SparkSession, loaders: dict[str, Callable[[], tuple]]) -> DataFrame:
    """(loader, item, value, error): the quality checks of every loader, see :func:`quality_checks`."""
    return each_loader(spark, loaders, lambda name, made: quality_checks({name: made}), "item string, value double")


def first_wanted(landing: Landing) -> DataFrame:
    """(keys, first_date): the day after the latest stored row of each key; NULL where nothing is stored."""
    latest = landing.stored.groupBy(*landing.keys).agg(F.max("date").alias("latest"))
    return latest.select(*landing.keys, F.date_add("latest", 1).alias("first_date"))


def filled(landing: Landing, until: Column | None = None) -> DataFrame:
    """Stored rows and all landed ones after the latest stored date of their key, up to ``until``.

    ``until`` is the day before the last one that has landed, as that one may still change. A
    key of which nothing is stored is loaded from its first landed day, whenever that was.
    """
    if until is None:
        until = F.date_sub(landing.landed.agg(F.max("date")).scalar(), 1)
    fresh = landing.landed.filter(F.col("date") <= until)
    if landing.keys:
        fresh = fresh.join(first_wanted(landing), list(landing.keys), "left")
        fresh = fresh.filter(F.col("first_date").isNull() | (F.col("date") >= F.col("first_date")))
    else:
        latest = landing.stored.agg(F.max("date")).scalar()
        fresh = fresh.filter(latest.isNull() | (F.col("date") > latest))
    return landing.stored.unionByName(fresh.select(*landing.stored.columns))


def reloaded(landing: Landing, days: int) -> DataFrame:
    """Stored rows with those of the last ``days`` stored days replaced by what has landed for them."""
    end = landing.stored.agg(F.max("date")).scalar()
    inside = (F.col("date") > F.date_sub(end, days)) & (F.col("date") <= end)
    return landing.stored.filter(~inside | end.isNull()).unionByName(landing.landed.filter(inside).select(*landing.stored.columns))


def long_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(symbol, date, item, value) of ``columns``; a table without symbols has NULL there."""
    if "symbol" not in df.columns:
        df = df.withColumn("symbol", F.lit(None).cast("string"))
    cells = F.array(*[F.struct(F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in columns])
    return df.select("symbol", "date", F.inline(cells))


def write_checked(df: DataFrame, path: str, name: str, keys: list[str], measure: str, columns: list[str]) -> DataFrame:
    """Write ``df`` and give the checks of what was written: (loader, item, value, error).

    The checks read the files, so they see what a reader will see. A check that fails does not
    undo the write. The number of rows and the first and last date stand beside the checks.
    """
    spark = df.sparkSession
    df.write.parquet(path)

    def job(_: str, written: DataFrame) -> DataFrame:
        days = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
        ends = written.agg(F.count("*").cast("double").alias("n"), days(F.min("date")).alias("a"), days(F.max("date")).alias("b"))
        cells = F.array(*[F.struct(F.lit(i).alias("item"), F.col(c).alias("value")) for i, c in (("rows", "n"), ("first_day", "a"), ("last_day", "b"))])
        checks = quality_checks({name: (written, keys, measure, columns)}).select("item", "value")
        return ends.select(F.inline(cells)).unionByName(checks)

    return each_loader(spark, {name: lambda: spark.read.schema(df.schema).parquet(path)}, job, "item string, value double")
