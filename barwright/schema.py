"""Declared schemas of the tables the package reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

BARS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("open", T.DoubleType()),
        T.StructField("high", T.DoubleType()),
        T.StructField("low", T.DoubleType()),
        T.StructField("close", T.DoubleType()),
        T.StructField("volume", T.LongType()),
    ]
)

# The nine maturities of the yield table.
TENORS = ["mo1", "mo2", "mo3", "mo6", "yr1", "yr2", "yr5", "yr10", "yr30"]

YIELDS = T.StructType(
    [T.StructField("date", T.DateType())] + [T.StructField(t, T.DoubleType()) for t in TENORS]
)

# The seven index series.
INDEX_SYMBOLS = ["SPX", "NDX", "DJI", "RUT", "VIX", "SOX", "OSX"]

STOCKS = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("quotetype", T.StringType()),
        T.StructField("sector", T.StringType()),
        T.StructField("industry", T.StringType()),
        T.StructField("last_updated", T.TimestampType()),
        T.StructField("is_active", T.BooleanType()),
    ]
)

_TEXT = T.ArrayType(T.StringType())
_FLAG = T.ArrayType(T.IntegerType())

# A filing list: one struct of parallel arrays per company.
SUBMISSIONS = T.StructType(
    [
        T.StructField("cik", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField(
            "filings",
            T.StructType(
                [
                    T.StructField(
                        "recent",
                        T.StructType(
                            [
                                T.StructField("accessionNumber", _TEXT),
                                T.StructField("filingDate", _TEXT),
                                T.StructField("form", _TEXT),
                                T.StructField("fileNumber", _TEXT),
                                T.StructField("items", _TEXT),
                                T.StructField("size", T.ArrayType(T.LongType())),
                                T.StructField("isXBRL", _FLAG),
                                T.StructField("isInlineXBRL", _FLAG),
                                T.StructField("primaryDocument", _TEXT),
                                T.StructField("primaryDocDescription", _TEXT),
                            ]
                        ),
                    )
                ]
            ),
        ),
    ]
)

_POINT = T.StructType(
    [
        T.StructField("val", T.StringType()),  # text: integers may pass 64 bits
        T.StructField("form", T.StringType()),
        T.StructField("filed", T.StringType()),
        T.StructField("end", T.StringType()),
        T.StructField("start", T.StringType()),
        T.StructField("accn", T.StringType()),
        T.StructField("fy", T.IntegerType()),
        T.StructField("fp", T.StringType()),
    ]
)
_TAGS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("label", T.StringType()),
            T.StructField("description", T.StringType()),
            T.StructField("units", T.MapType(T.StringType(), T.ArrayType(_POINT))),
        ]
    ),
)

# Two layouts are in use: facts.<taxonomy> and facts.facts.<taxonomy>.
FACTS_FLAT = T.StructType([T.StructField("facts", T.MapType(T.StringType(), _TAGS))])
FACTS_NESTED = T.StructType(
    [T.StructField("facts", T.StructType([T.StructField("facts", T.MapType(T.StringType(), _TAGS))]))]
)

TICKERS = T.MapType(
    T.StringType(),
    T.StructType(
        [
            T.StructField("ticker", T.StringType()),
            T.StructField("cik_str", T.LongType()),
            T.StructField("title", T.StringType()),
        ]
    ),
)
