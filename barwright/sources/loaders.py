"""Loaders of landed provider files, looked up by name, behind one data source.

A loader says what its files look like: their columns and how a file becomes record batches.
``register_loader`` adds one; each has a data source ``landed_<name>`` that reads a folder, a
partition for each file. Folders are laid out by year, and filters on ``date`` and
``symbol`` are pushed to the source: whole years are never opened, other rows are dropped
batch by batch before they reach Spark. Files are opened through Arrow's file systems, so the
folder must be one of those (local, hdfs, s3, gs); of a store that Spark alone can open, the
same files can be read with Spark's own readers and given to ``sources.readers``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv
import pyarrow.fs
import pyarrow.json
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual,
)

from barwright.schema import TENORS

SOURCE = "landed"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class Loader:
    """Base of all loaders: subclasses name their columns and parse a file."""

    #: Columns of the result, as a schema string; one of them is ``date``.
    schema: str

    def batches(self, stream) -> Iterator[pa.RecordBatch]:
        """Record batches of one file, columns in the order of ``schema``."""
        raise NotImplementedError

    def landed(self, df: DataFrame) -> DataFrame:
        """Rows of ``schema`` as the provider would send them: the other way round."""
        raise NotImplementedError

    #: Format and options of the landed files, and the column whose first digits are the year.
    written = ("csv", {"header": "true"})
    stamp = "date"


_BARS = "symbol string, date date, open double, high double, low double, close double, volume bigint"


class StockLoader(Loader):
    """Title-case CSV with a timestamp; a missing volume is 0."""

    schema = _BARS
    stamp = "Date"
    names = ["Symbol", "Date", "Open", "High", "Low", "Close", "Volume"]

    def batches(self, stream) -> Iterator[pa.RecordBatch]:
        types = dict(zip(self.names, [pa.string(), pa.string(), *[pa.float64()] * 4, pa.int64()], strict=True))
        options = pa.csv.ConvertOptions(column_types=types, include_columns=self.names, null_values=["", "N/A"], strings_can_be_null=True)
        for batch in pa.csv.open_csv(stream, convert_options=options):
            columns = list(batch.columns)
            columns[1] = pc.utf8_slice_codeunits(columns[1], 0, 10).cast(pa.date32())
            columns[6] = pc.fill_null(columns[6], 0)
            yield pa.RecordBatch.from_arrays(columns, names=["symbol", "date", "open", "high", "low", "close", "volume"])

    def landed(self, df: DataFrame) -> DataFrame:
        stamp = F.concat(F.col("date").cast("string"), F.lit(" 00:00:00"))
        return df.select(F.col("symbol").alias("Symbol"), stamp.alias("Date"), *[F.col(c.lower()).alias(c) for c in self.names[2:]])


class IndexLoader(Loader):
    """A line of JSON for each bar: symbol and ``{t,o,h,l,c,v}`` with an ISO time."""

    schema = _BARS
    written = ("json", {})
    stamp = "t"

    def batches(self, stream) -> Iterator[pa.RecordBatch]:
        bar = pa.schema([("s", pa.string()), ("t", pa.string()), *[(k, pa.float64()) for k in "ohlc"], ("v", pa.int64())])
        table = pa.json.read_json(stream, parse_options=pa.json.ParseOptions(explicit_schema=bar, unexpected_field_behavior="ignore"))
        for batch in table.to_batches():
            columns = [batch.column(k) for k in bar.names]
            columns[1] = pc.utf8_slice_codeunits(columns[1], 0, 10).cast(pa.date32())
            yield pa.RecordBatch.from_arrays(columns, names=["symbol", "date", "open", "high", "low", "close", "volume"])

    def landed(self, df: DataFrame) -> DataFrame:
        stamp = F.concat(F.col("date").cast("string"), F.lit("T00:00:00Z"))
        short = dict(zip("ohlcv", ["open", "high", "low", "close", "volume"], strict=True))
        return df.select(F.col("symbol").alias("s"), stamp.alias("t"), *[F.col(c).alias(k) for k, c in short.items()])


class TreasuryLoader(Loader):
    """CSV of yields by maturity as text; blank and N/A are NULL."""

    schema = "date date, " + ", ".join(f"{t} double" for t in TENORS)

    def batches(self, stream) -> Iterator[pa.RecordBatch]:
        types = {"date": pa.date32(), **{t: pa.float64() for t in TENORS}}
        options = pa.csv.ConvertOptions(column_types=types, include_columns=list(types), null_values=["", "N/A"])
        yield from pa.csv.open_csv(stream, convert_options=options)

    def landed(self, df: DataFrame) -> DataFrame:
        return df.select(F.col("date").cast("string").alias("date"), *[F.coalesce(F.col(t).cast("string"), F.lit("N/A")).alias(t) for t in TENORS])


_LOADERS: dict[str, Loader] = {}


def register_loader(name: str, loader: Loader) -> None:
    """Make ``loader`` known under ``name``; a later one of the same name takes its place."""
    if not isinstance(loader, Loader):
        raise TypeError(f"{type(loader).__name__} is no Loader")
    _LOADERS[name] = loader


def loader(name: str) -> Loader:
    """The loader of that name; an unknown name raises and lists those that are known."""
    if name not in _LOADERS:
        raise ValueError(f"unknown loader {name}; known: {', '.join(sorted(_LOADERS))}")
    return _LOADERS[name]


def loader_names() -> list[str]:
    return sorted(_LOADERS)


for _name, _one in (("stock", StockLoader()), ("index", IndexLoader()), ("treasury", TreasuryLoader())):
    register_loader(_name, _one)


@dataclass
class LandedFile(InputPartition):
    path: str
    #: Earliest and latest wanted date, wanted symbols; None where no filter was pushed.
    first: dt.date | None = None
    last: dt.date | None = None
    symbols: frozenset | None = None


@dataclass
class LandedReader(DataSourceReader):
    folder: str
    loader: Loader
    first: dt.date | None = None
    last: dt.date | None = None
    symbols: frozenset | None = None

    def pushFilters(self, filters: list[Filter]):
        """Take ranges of dates and lists of symbols; all others go back to Spark."""
        day = dt.timedelta(days=1)
        for f in filters:
            column, value = getattr(f, "attribute", ()), getattr(f, "value", None)
            if column == ("date",) and isinstance(value, dt.date) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = value + day if isinstance(f, GreaterThan) else value
                    self.first = low if self.first is None else max(self.first, low)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = value - day if isinstance(f, LessThan) else value
                    self.last = high if self.last is None else min(self.last, high)
            elif column == ("symbol",) and isinstance(f, (EqualTo, In)):
                wanted = frozenset([value] if isinstance(f, EqualTo) else value)
                self.symbols = wanted if self.symbols is None else self.symbols & wanted
            else:
                yield f

    def partitions(self) -> list[LandedFile]:
        store, root = pa.fs.FileSystem.from_uri(self.folder)
        out = []
        for info in store.get_file_info(pa.fs.FileSelector(root, recursive=True)):
            name = info.path.rsplit("/", 1)[-1]
            if info.type != pa.fs.FileType.File or not info.size or name.startswith(("_", ".")):
                continue
            year = next((p.removeprefix("year=") for p in info.path.split("/") if p.startswith("year=")), "")
            if year.isdigit() and (self.first and int(year) < self.first.year or self.last and int(year) > self.last.year):
                continue
            out.append(LandedFile(info.path, self.first, self.last, self.symbols))
        # A folder without a wanted file is an empty table.
        return sorted(out, key=lambda f: f.path) or [LandedFile("")]

    def read(self, partition: LandedFile) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = pa.fs.FileSystem.from_uri(self.folder)
        with store.open_input_stream(partition.path) as stream:
            for batch in self.loader.batches(stream):
                keep = None
                date = batch.column(batch.schema.get_field_index("date"))
                tests = []
                if partition.first is not None:
                    tests.append(pc.greater_equal(date, pa.scalar(partition.first)))
                if partition.last is not None:
                    tests.append(pc.less_equal(date, pa.scalar(partition.last)))
                if partition.symbols is not None:
                    symbol = batch.column(batch.schema.get_field_index("symbol"))
                    tests.append(pc.is_in(symbol, pa.array(sorted(partition.symbols), pa.string())))
                for t in tests:
                    keep = t if keep is None else pc.and_(keep, t)
                yield batch if keep is None else batch.filter(keep)


def source_of(name: str) -> type[DataSource]:
    """The data source of a registered loader; it carries the loader to every worker process."""
    one = loader(name)

    class LandedSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return f"{SOURCE}_{name}"

        def schema(self) -> str:
            return one.schema

        def reader(self, schema) -> LandedReader:
            return LandedReader(self.options["path"], one)

    return LandedSource


def land(name: str, df: DataFrame, folder: str) -> None:
    """Write ``df`` (the loader's columns) as the provider's files, laid out by year."""
    one = loader(name)
    kind, options = one.written
    rows = one.landed(df).withColumn("year", F.substring(one.stamp, 1, 4))
    rows.write.partitionBy("year").options(**options).format(kind).save(folder)


def load(spark: SparkSession, name: str, folder: str, start=None, end=None, symbol: str | None = None) -> DataFrame:
    """Landed rows of a loader in an inclusive date range, of one symbol or all. An unknown loader raises."""
    one = loader(name)
    spark.dataSource.register(source_of(name))
    if spark.conf.get(PUSHDOWN, "false") != "true":
        spark.conf.set(PUSHDOWN, "true")
    out = spark.read.format(f"{SOURCE}_{name}").load(folder)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    if symbol is not None and "symbol" in [c.split()[0] for c in one.schema.split(", ")]:
        out = out.filter(F.col("symbol") == symbol)
    return out
