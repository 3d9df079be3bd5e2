"""Filing and company-fact documents derived row by row from orders and line items.

Each order is one document with its own small arrays, so no document grows with a
busy customer and nothing is gathered to build one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from barwright.sources.panel import table


def _cik(column: str):
    return F.lpad(F.col(column).cast("string"), 10, "0")


def submission_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents with a struct of parallel arrays of uneven lengths."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    recent = F.struct(
        F.array(F.concat(key, F.lit("-1")), F.concat(key, F.lit("-2"))).alias("accessionNumber"),
        F.array(F.col("d").cast("string"), F.date_add("d", 30).cast("string")).alias("filingDate"),
        F.array(F.col("o_orderpriority"), F.lit("8-K")).alias("form"),
        F.array(F.col("o_orderstatus")).alias("fileNumber"),
        F.array().cast("array<string>").alias("items"),
        F.array(cents, cents + 1).alias("size"),
        F.array(F.lit(1), F.lit(0)).alias("isXBRL"),
        F.array(F.lit(0)).alias("isInlineXBRL"),
        F.array(F.concat(F.lit("doc"), key, F.lit(".htm"))).alias("primaryDocument"),
        F.array(F.lit("report"), F.lit("notice")).alias("primaryDocDescription"),
    )
    body = F.struct(
        _cik("o_custkey").alias("cik"),
        F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")).alias("name"),
        F.struct(recent.alias("recent")).alias("filings"),
    )
    return o.select(F.to_json(body).alias("doc"))


# Which order priority reports which tag.
TAG_OF_PRIORITY = {
    "1-URGENT": "Assets",
    "2-HIGH": "Liabilities",
    "3-MEDIUM": "Goodwill",
    "4-NOT SPECIFIED": "NetIncomeLoss",
    "5-LOW": "Inventory",
}


def tag_case(column: str = "o_orderpriority") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TAG_OF_PRIORITY.items()) + " END"


def fact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON documents in both layouts; one tag in two units, the second beyond 64 bits."""
    o = table(spark, sf_dir, "orders").withColumn("d", F.to_date("o_orderdate"))
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    key = F.lpad(F.col("o_orderkey").cast("string"), 12, "0")

    def point(value, accn):
        return F.concat(
            F.lit('{"val":'), value, F.lit(',"form":"10-K","filed":"'), F.date_add("d", 45).cast("string"), F.lit('","end":"'),
            F.col("d").cast("string"), F.lit('","accn":"'), accn, F.lit('","fy":'), F.year("d").cast("string"), F.lit(',"fp":"FY"}'),
        )

    tags = F.concat(
        F.lit('{"us-gaap":{"'), F.expr(tag_case()), F.lit('":{"label":"x","units":{"USD":['),
        point(cents, key), F.lit(","), point(F.concat(cents, F.lit("0")), key), F.lit('],"shares":['),
        point(F.concat(cents, F.lit("000000000000000000")), key), F.lit("]}}}}"),
    )
    nested = F.concat(F.lit('{"facts":{"facts":'), tags, F.lit("}}"))
    flat = F.concat(F.lit('{"facts":'), tags, F.lit("}"))
    return o.select(
        _cik("o_custkey").alias("cik"),
        F.concat(F.lit("S"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("symbol"),
        F.when(F.col("o_orderstatus") == "F", nested).otherwise(flat).alias("doc"),
    )


def ticker_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directory pages, one JSON object of objects per customer; some tickers repeat."""
    ticker = F.concat(F.lit("s"), F.lpad((F.col("c_custkey")).cast("string"), 12, "0"))
    entry = F.create_map(
        F.lit("0"),
        F.struct(ticker.alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("title")),
        F.lit("1"),
        F.struct(F.upper(F.col("c_mktsegment")).alias("ticker"), F.col("c_custkey").alias("cik_str"), F.col("c_name").alias("title")),
    )
    return table(spark, sf_dir, "customer").select(F.to_json(entry).alias("doc"))
