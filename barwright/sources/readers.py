"""Scans and normalisation of landed provider data."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from barwright.schema import BARS, INDEX_SYMBOLS, TENORS

# The index series handed to feature jobs (one of the seven is left out).
FEATURE_INDICES = ["SPX", "NDX", "DJI", "RUT", "VIX", "SOX"]


def scan_bars(bars: DataFrame, start=None, end=None, symbol: str | None = None) -> DataFrame:
    """Bars of an inclusive date range, of one symbol or of all."""
    out = bars
    if symbol is not None:
        out = out.filter(F.col("symbol") == symbol)
    if start is not None:
        out = out.filter(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        out = out.filter(F.col("date") <= F.lit(end).cast("date"))
    return out.select("symbol", "date", "open", "high", "low", "close", "volume")


def load_bars(bars: DataFrame, start=None, end=None, symbol: str | None = None) -> DataFrame:
    """Scan with the declared types; NULL stays NULL."""
    out = scan_bars(bars, start, end, symbol)
    return out.select(*[F.col(f.name).cast(f.dataType) for f in BARS.fields])


def load_index(index_bars: DataFrame, symbol: str, start=None, end=None) -> DataFrame:
    """One index series; an unknown name gives an empty frame, not an error."""
    known = F.lit(symbol in INDEX_SYMBOLS)
    return load_bars(index_bars.filter(known), start, end, symbol)


def series_column(table: DataFrame, close: str, name: str, symbol: str | None = None) -> DataFrame:
    """One column of a date-keyed table under the name of its series."""
    out = table if symbol is None else table.filter(F.col("symbol") == symbol)
    return out.select("date", F.col(close).alias(name))


def market_series(index_bars: DataFrame, yields: DataFrame) -> DataFrame:
    """The seven indices and the ten-year yield as one long table (asset, date, value)."""
    return index_bars.select(F.col("symbol").alias("asset"), "date", F.col("close").alias("value")).unionByName(
        yields.select(F.lit("US10Y").alias("asset"), "date", F.col("yr10").alias("value"))
    )


def market_wide(index_bars: DataFrame, yields: DataFrame) -> DataFrame:
    return (
        market_series(index_bars, yields)
        .groupBy("date")
        .pivot("asset", INDEX_SYMBOLS + ["US10Y"])
        .agg(F.first("value"))
    )


def feature_indices(index_bars: DataFrame, start=None, end=None) -> DataFrame:
    return scan_bars(index_bars.filter(F.col("symbol").isin(FEATURE_INDICES)), start, end)


def load_yields(yields: DataFrame, start, end) -> DataFrame:
    day = F.col("date")
    return yields.filter(day.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).select("date", *TENORS)


def active_stocks(stocks: DataFrame) -> DataFrame:
    return stocks.filter("is_active").select("symbol", F.col("company_name").alias("name"))


def provider_table(landed: DataFrame) -> DataFrame:
    """Title-case provider columns with a timestamp index; missing volume is 0."""
    return landed.select(
        F.col("Symbol").alias("symbol"),
        F.to_date("Date").alias("date"),
        *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.coalesce(F.col("Volume").cast("bigint"), F.lit(0)).alias("volume"),
    )


SHORT_BAR = T.StructType(
    [
        T.StructField("t", T.StringType()),
        T.StructField("o", T.DoubleType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("l", T.DoubleType()),
        T.StructField("c", T.DoubleType()),
        T.StructField("v", T.LongType()),
    ]
)


def provider_json(landed: DataFrame) -> DataFrame:
    """JSON bars ``{t,o,h,l,c,v}`` with an ISO time in UTC."""
    bar = landed.select("symbol", F.from_json("payload", SHORT_BAR).alias("b"))
    return bar.select(
        "symbol",
        F.to_date(F.to_timestamp("b.t", "yyyy-MM-dd'T'HH:mm:ssX")).alias("date"),
        F.col("b.o").alias("open"),
        F.col("b.h").alias("high"),
        F.col("b.l").alias("low"),
        F.col("b.c").alias("close"),
        F.col("b.v").alias("volume"),
    )


# Position of each maturity among the cells of a yield row.
YIELD_CELLS = {"mo1": 12, "mo2": 14, "mo3": 15, "mo6": 16, "yr1": 17, "yr2": 18, "yr5": 20, "yr10": 22, "yr30": 24}


def parse_yield(text) -> "F.Column":
    """Yield text; blank and N/A are NULL."""
    return F.expr("try_cast(nullif(trim({0}), '') AS double)".format(text))


def yield_pages(pages: DataFrame, start, end) -> DataFrame:
    """Rows of the first ``usa-table`` of each page, without its header row.

    Rows with fewer than 11 cells, without a readable time, shorter than the last
    cell used, or outside the range are left out.
    """
    body = F.regexp_extract("html", r"(?s)<table[^>]*class=\"[^\"]*usa-table[^\"]*\"[^>]*>(.*?)</table>", 1)
    rows = pages.select("url", F.explode(F.slice(F.regexp_extract_all(body, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), 1), 2, 1 << 30)).alias("tr"))
    cells = rows.select("url", F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), 1).alias("td"))
    wide = cells.filter(F.size("td") >= 11).select(
        "url",
        F.expr("try_to_timestamp(regexp_extract(td[0], 'datetime=\"([^\"]*)\"', 1), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")")
        .cast("date")
        .alias("date"),
        *[
            F.regexp_replace(F.get("td", F.lit(pos)), r"<[^>]*>", "").alias(f"{tenor}_text")
            for tenor, pos in YIELD_CELLS.items()
        ],
    )
    usable = wide.filter(
        F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("yr30_text").isNotNull()
    )
    return usable.select("date", *[parse_yield(f"{t}_text").alias(t) for t in TENORS])


def split_events(splits: DataFrame, since=None) -> DataFrame:
    out = splits.filter("ratio > 0")
    if since is not None:
        out = out.filter(F.col("split_date") >= F.lit(since).cast("date"))
    return out.select("symbol", "split_date", "ratio")
