"""Bars, index bars, yields and dimensions derived from the order tables.

Every line item acts as one quote: list price (the open side), list price less
discount (low side), list price plus tax (high side) and the charged price (close
side). Prices are kept as whole cents until the last division, so sums are exact
and do not depend on the order in which partitions arrive.

Scale: the only pass over the fact table is one hash aggregation on
``(key, date)`` over primitive buffers, so each map task pre-aggregates and a hot
symbol is spread over its dates. What leaves it holds at most one row per symbol
and trading day, which bounds every later per-symbol window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from barwright.functions.series import dealt
from barwright.schema import TENORS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbol_of(key: str) -> Column:
    return F.concat(F.lit("S"), F.lpad(F.col(key).cast("string"), 12, "0"))


#: Line items that one task of a dealt panel should have: bounds what its sorts and hash tables hold.
DEALT = 1 << 18


def tasks(spark: SparkSession, sf_dir: str) -> int | None:
    """Tasks among which a panel is dealt so that none holds much more than ``DEALT`` line items.

    The files' footers have the number. None where the session's own tasks are enough: the
    panel is then dealt as the session has it.
    """
    return tasks_for(spark, table(spark, sf_dir, "lineitem").count())


def tasks_for(spark: SparkSession, rows: int) -> int | None:
    n = -(-rows // DEALT)
    return n if n > spark.sparkContext.defaultParallelism else None


def line_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: whole cents, units, and discount/tax in percent."""
    return table(spark, sf_dir, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        "l_linestatus",
        F.to_date("l_shipdate").alias("date"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").alias("c"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("t"),
    )


def quote_totals(quotes: DataFrame, *keys: str) -> DataFrame:
    return quotes.groupBy(*keys, "date").agg(
        F.sum("c").alias("c"),
        F.sum(F.expr("c * (100 - d) * (100 + t) div 10000")).alias("charge"),
        F.sum("q").alias("q"),
        F.max(F.expr("c * (100 + t) div nullif(10000 * q, 0)")).alias("hi"),
        F.min(F.expr("c * (100 - d) div nullif(10000 * q, 0)")).alias("lo"),
    )


def bars_of_totals(totals: DataFrame) -> DataFrame:
    return totals.select(
        "symbol",
        "date",
        (F.expr("c div nullif(100 * q, 0)").cast("double") / 100).alias("open"),
        (F.col("hi").cast("double") / 100).alias("high"),
        (F.col("lo").cast("double") / 100).alias("low"),
        (F.expr("charge div nullif(100 * q, 0)").cast("double") / 100).alias("close"),
        F.col("q").alias("volume"),
    )


def bars(spark: SparkSession, sf_dir: str, n: int | None = None) -> DataFrame:
    """Daily bar panel: one row per (symbol, date), over ``n`` tasks where that is given."""
    # Named before it is grouped: merges and windows on (symbol, date) or symbol then find
    # the rows dealt by a key they know, and need no second shuffle on another name for it.
    lines = line_quotes(spark, sf_dir).withColumn("symbol", symbol_of("l_suppkey"))
    return bars_of_totals(quote_totals(dealt(lines, n, "symbol", "date"), "symbol"))


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven index series in one long table; SPX is the whole market.

    The market series is re-aggregated from the six part series, so the fact table
    is read once more for neither.
    """
    parts = quote_totals(line_quotes(spark, sf_dir), "l_returnflag", "l_linestatus")
    part_name = F.expr(
        "CASE concat(l_returnflag, l_linestatus) WHEN 'AF' THEN 'NDX' WHEN 'AO' THEN 'DJI'"
        " WHEN 'NF' THEN 'RUT' WHEN 'NO' THEN 'VIX' WHEN 'RF' THEN 'SOX' WHEN 'RO' THEN 'OSX' END"
    )
    both = parts.select(
        F.explode(F.array(part_name, F.lit("SPX"))).alias("symbol"), "date", "c", "charge", "q", "hi", "lo"
    ).filter(F.col("symbol").isNotNull())
    totals = both.groupBy("symbol", "date").agg(
        F.sum("c").alias("c"),
        F.sum("charge").alias("charge"),
        F.sum("q").alias("q"),
        F.max("hi").alias("hi"),
        F.min("lo").alias("lo"),
    )
    return bars_of_totals(totals)


# Which orders feed which maturity of the derived yield table.
TENOR_RULES = {
    "mo1": "o_orderpriority = '1-URGENT'",
    "mo2": "o_orderpriority = '2-HIGH'",
    "mo3": "o_orderpriority = '3-MEDIUM'",
    "mo6": "o_orderpriority = '4-NOT SPECIFIED'",
    "yr1": "o_orderpriority = '5-LOW'",
    "yr2": "o_orderstatus = 'F'",
    "yr5": "o_orderstatus = 'O'",
    "yr10": "o_orderstatus = 'P'",
    "yr30": "true",
}


def yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine nullable maturities per date, in percent with four decimals."""
    orders = table(spark, sf_dir, "orders").select(
        F.to_date("o_orderdate").alias("date"),
        "o_orderpriority",
        "o_orderstatus",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("c"),
    )
    sums = []
    for tenor in TENORS:
        rule = F.expr(TENOR_RULES[tenor])
        sums += [
            F.sum(F.when(rule, F.col("c"))).alias(f"{tenor}_c"),
            F.count(F.when(rule, F.lit(1))).alias(f"{tenor}_n"),
        ]
    wide = orders.groupBy("date").agg(*sums)
    return wide.select(
        "date",
        *[
            (F.expr(f"{t}_c div nullif(1000 * {t}_n, 0)").cast("double") / 10000).alias(t) for t in TENORS
        ],
    )


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stock dimension from supplier, nation and region (25 and 5 fixed rows)."""
    supplier = table(spark, sf_dir, "supplier")
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
        .select(
            symbol_of("s_suppkey").alias("symbol"),
            F.col("s_name").alias("company_name"),
            F.when(F.col("s_acctbal") >= 1000, "EQUITY").otherwise("ETF").alias("quotetype"),
            F.when(F.col("s_acctbal") >= 0, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" "))).alias("sector"),
            F.when(F.col("s_acctbal") < 9000, F.concat(F.lower("n_name"), F.lit("-goods"))).alias("industry"),
            F.date_add(F.lit("1999-01-01").cast("date"), F.floor(F.col("s_acctbal") / 10).cast("int"))
            .cast("timestamp")
            .alias("last_updated"),
            (F.col("s_acctbal") < 8500).alias("is_active"),
        )
    )


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger, dirty dimension: repeated and badly formed symbols."""
    return table(spark, sf_dir, "customer").select(
        F.concat(
            F.when(F.col("c_acctbal") < 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")),
            F.when(F.col("c_acctbal") > 9000, " ").otherwise("-"),
            F.col("c_nationkey").cast("string"),
        ).alias("symbol"),
        F.col("c_custkey").alias("row_id"),
        F.col("c_name").alias("company_name"),
        (F.col("c_acctbal") < 8000).alias("is_active"),
    )


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two split events per symbol; some carry ratio 0 and must be filtered."""
    days = F.floor(F.abs("s_acctbal")).cast("int")
    return (
        table(spark, sf_dir, "supplier")
        .select(
            symbol_of("s_suppkey").alias("symbol"),
            F.explode(
                F.array(
                    F.struct(
                        F.date_add(F.lit("1996-01-01").cast("date"), days % 700).alias("split_date"),
                        (F.lit(2.0) + F.col("s_nationkey") % 3).alias("ratio"),
                    ),
                    F.struct(
                        F.date_add(F.lit("1999-01-01").cast("date"), days % 500).alias("split_date"),
                        F.when(F.col("s_acctbal") < 500, F.lit(0.0)).otherwise(F.lit(1.5)).alias("ratio"),
                    ),
                )
            ).alias("e"),
        )
        .select("symbol", "e.split_date", "e.ratio")
    )


def raw_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider rows as text, one per line item, with the usual defects.

    Close is ``N/A`` where tax is 8 %, zero where discount is 9 %, volume is missing
    where tax is 7 %, zero where tax is 6 %, and high and low are swapped where
    discount is 10 %.
    """
    keys = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", F.to_date("l_shipdate").alias("date"),
    )
    c = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    base = keys.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "date",
        c.alias("c"),
        F.col("l_quantity").cast("bigint").alias("q"),
        F.round(F.col("l_discount") * 100).cast("bigint").alias("d"),
        F.round(F.col("l_tax") * 100).cast("bigint").alias("t"),
    )
    up = F.expr("c * (100 + t) div nullif(10000 * q, 0)").cast("double") / 100
    down = F.expr("c * (100 - d) div nullif(10000 * q, 0)").cast("double") / 100
    charged = F.expr("c * (100 - d) * (100 + t) div nullif(1000000 * q, 0)").cast("double") / 100
    return base.select(
        symbol_of("l_suppkey").alias("symbol"),
        "date",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "c",
        (F.expr("c div nullif(100 * q, 0)").cast("double") / 100).alias("open"),
        F.when(F.col("d") == 10, down).otherwise(up).alias("high"),
        F.when(F.col("d") == 10, up).otherwise(down).alias("low"),
        F.when(F.col("t") == 8, F.lit("N/A"))
        .when(F.col("d") == 9, F.lit("0"))
        .otherwise(charged.cast("decimal(18,2)").cast("string"))
        .alias("close_text"),
        F.when(F.col("t") == 7, F.lit(None)).when(F.col("t") == 6, F.lit(0)).otherwise(F.col("q")).cast("bigint").alias("volume"),
    )
