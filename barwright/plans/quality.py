"""Queries over validation, quality reports, merges and incremental loads."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.functions.series import by_date, dealt
from barwright.operators import adjust, alignment as al, calendar as cal, distribution as dist, incremental as inc, quality as q, upsert as up
from barwright.plans.registry import query, tidy
from barwright.plans.scans import MISSING, TRADING, bar_spans
from barwright.plans.sqltext import BARS, BARS_AND_INDEX, FEED, LAGGED, LISTINGS, SPLITS, STOCKS, YIELDS, r
from barwright.schema import TENORS
from barwright.sources import panel

_B = "symbol, date, open, high, low, close, volume"
_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "c"]
_O = ", ".join(_ORDER)
_DATES = "DATE '1998-01-01'"


def feed_frame(spark, sf):
    return panel.raw_feed(spark, sf).withColumnRenamed("close_text", "close")


@query(
    "coerced_bars",
    f"WITH {FEED} SELECT symbol, date, {_O}, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume"
    " FROM feed WHERE TRY_CAST(close_text AS DOUBLE) IS NOT NULL AND volume IS NOT NULL",
)
def coerced_bars(spark, sf):
    return tidy(q.coerced(feed_frame(spark, sf), q.OHLCV))


VALID = f"""{FEED}, valid AS (SELECT symbol, date, {_O}, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close,
  coalesce(volume, 0) AS volume FROM feed WHERE TRY_CAST(close_text AS DOUBLE) > 0)"""


@query(
    "valid_stock_bars",
    f"WITH {VALID} SELECT symbol, date, {_O}, nullif(open, 0) AS open, nullif(high, 0) AS high, nullif(low, 0) AS low, close, volume FROM valid",
)
def valid_stock_bars(spark, sf):
    return tidy(q.valid_stock_bars(feed_frame(spark, sf)))


@query("valid_index_bars", f"WITH {VALID} SELECT symbol, date, {_O}, open, high, low, close, volume FROM valid")
def valid_index_bars(spark, sf):
    return tidy(q.valid_index_bars(feed_frame(spark, sf)))


@query("valid_yields", f"WITH {YIELDS} SELECT * FROM yields WHERE coalesce({', '.join(TENORS)}) IS NOT NULL")
def valid_yields(spark, sf):
    return q.valid_yields(panel.yields(spark, sf))


@query(
    "eligible_stocks",
    f"WITH {STOCKS} SELECT symbol, company_name, sector, industry FROM stocks WHERE is_active AND quotetype = 'EQUITY' AND sector IS NOT NULL",
)
def eligible_stocks(spark, sf):
    return q.eligible_stocks(panel.stocks(spark, sf))


@query("invalid_symbols", f"WITH {LISTINGS} SELECT * FROM listings WHERE NOT regexp_full_match(symbol, '[A-Z0-9.-]+')")
def invalid_symbols(spark, sf):
    return q.invalid_symbols(panel.listings(spark, sf))


_ASOF = "TIMESTAMP '2001-06-01 00:00:00'"


@query("stale_stocks", f"WITH {STOCKS} SELECT symbol, last_updated FROM stocks WHERE last_updated < {_ASOF} - INTERVAL 365 DAYS")
def stale_stocks(spark, sf):
    return q.stale(panel.stocks(spark, sf), F.expr(_ASOF)).select("symbol", "last_updated")


@query("inactive_stocks", f"WITH {STOCKS} SELECT symbol FROM stocks WHERE NOT is_active")
def inactive_stocks(spark, sf):
    return q.inactive(panel.stocks(spark, sf)).select("symbol")


@query(
    "inconsistent_bars",
    f"""WITH {FEED}, f AS (SELECT symbol, date, {_O}, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close FROM feed)
    SELECT * FROM f WHERE low > open OR close > high OR low > close OR open > high""",
)
def inconsistent_bars(spark, sf):
    df = feed_frame(spark, sf).withColumn("close", F.col("close").try_cast("double")).drop("volume")
    return tidy(df.filter(q.is_inconsistent()))


@query(
    "repeated_symbols",
    f"WITH {LISTINGS} SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY row_id) AS rn FROM listings) WHERE rn > 1",
)
def repeated_symbols(spark, sf):
    return q.repeated_symbols(panel.listings(spark, sf), "row_id").select("symbol", "row_id", "company_name", "is_active")


@query("duplicate_symbols", f"WITH {LISTINGS} SELECT symbol, count(*) AS n FROM listings GROUP BY symbol HAVING count(*) > 1")
def duplicate_symbols(spark, sf):
    return dist.duplicate_keys(panel.listings(spark, sf), ["symbol"])


@query(
    "null_counts",
    f"WITH {STOCKS} " + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS nulls FROM stocks" for c in ("company_name", "sector", "industry")
    ),
)
def null_counts(spark, sf):
    return dist.null_counts(panel.stocks(spark, sf), ["company_name", "sector", "industry"])


@query(
    "clean_text",
    f"""WITH {STOCKS} SELECT symbol, {{0}} AS sector, {{1}} AS industry FROM stocks""".format(
        *[
            f"CASE WHEN {c} IS NOT NULL THEN list_aggregate(list_transform(regexp_extract_all(trim({c}), '[A-Za-z]+|[^A-Za-z]+'),"
            " lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', '') END"
            for c in ("sector", "industry")
        ]
    ),
)
def clean_text(spark, sf):
    return panel.stocks(spark, sf).select("symbol", q.clean_text("sector").alias("sector"), q.clean_text("industry").alias("industry"))


@query(
    "missing_matrix",
    f"""WITH {YIELDS}, f AS (SELECT * FROM yields WHERE {' OR '.join(f'{t} IS NULL' for t in TENORS)})
    """ + " UNION ALL ".join(f"SELECT date, '{t}' AS field, CAST({t} IS NULL AS BIGINT) AS missing FROM f" for t in TENORS),
)
def missing_matrix(spark, sf):
    return dist.missingness(panel.yields(spark, sf), TENORS, keys=("date",))


_OUT_COLS = ["open", "high", "low", "close", "volume"]


@query(
    "outlier_counts",
    f"WITH {BARS}, s AS (SELECT symbol, "
    + ", ".join(f"avg({c}) AS m_{c}, CASE WHEN stddev_samp({c}) > 0 THEN stddev_samp({c}) ELSE 1 END AS s_{c}" for c in _OUT_COLS)
    + " FROM bars GROUP BY symbol) SELECT b.symbol, "
    + ", ".join(f"count(*) FILTER (abs(({c} - m_{c}) / s_{c}) > 3) AS {c}_outliers" for c in _OUT_COLS)
    + " FROM bars b JOIN s ON b.symbol = s.symbol GROUP BY b.symbol",
)
def outlier_counts(spark, sf):
    return dist.outlier_counts(panel.bars(spark, sf))


@query(
    "outlier_report",
    f"""WITH {BARS}, s AS (SELECT symbol, avg(close) AS m, stddev_pop(close) AS s, count(*) AS n FROM bars GROUP BY symbol)
    SELECT b.symbol, {r('m')} AS mean, {r('s')} AS std_dev, count(*) FILTER (abs(close - m) > 3 * s) AS outlier_count,
      {r('count(*) FILTER (abs(close - m) > 3 * s) / n * 100')} AS outlier_percentage
    FROM bars b JOIN s ON b.symbol = s.symbol GROUP BY b.symbol, m, s, n""",
)
def outlier_report(spark, sf):
    return tidy(dist.outlier_report(panel.bars(spark, sf), "close", ("symbol",)))


_CAL = """cdays AS (SELECT symbol, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), CAST(max(date) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date
  FROM bars GROUP BY symbol)"""


@query(
    "missing_calendar_days",
    f"""WITH {BARS}, {_CAL} SELECT c.symbol, count(*) AS total_dates, count(*) FILTER (b.date IS NULL) AS missing_dates,
      min(c.date) FILTER (b.date IS NULL) AS first_missing, max(c.date) FILTER (b.date IS NULL) AS last_missing
    FROM cdays c LEFT JOIN bars b ON b.symbol = c.symbol AND b.date = c.date GROUP BY c.symbol""",
)
def missing_calendar_days(spark, sf):
    return tidy(q.missing_date_report(panel.bars(spark, sf)))


@query(
    "received_weekdays",
    f"WITH {BARS}, {_CAL} SELECT c.symbol, c.date FROM cdays c ANTI JOIN bars b ON b.symbol = c.symbol AND b.date = c.date WHERE isodow(c.date) <= 5",
)
def received_weekdays(spark, sf):
    bars = panel.bars(spark, sf)
    return inc.received_check(bar_spans(bars), bars)


@query(
    "first_missing_dates",
    f"WITH {MISSING} SELECT symbol, date FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS rn FROM missing) WHERE rn <= 10",
)
def first_missing_dates(spark, sf):
    n = panel.tasks(spark, sf)
    bars = panel.bars(spark, sf, n)
    return q.first_rows(dealt(cal.missing_days(bars, bar_spans(bars), tasks=n), n, "symbol"), "date", 10)


@query(
    "consistency_report",
    f"""WITH {FEED} SELECT 'duplicate_keys' AS item, count(*) AS value FROM (SELECT symbol, date FROM feed GROUP BY ALL HAVING count(*) > 1)
    """ + " ".join(f"UNION ALL SELECT 'nulls_{c}', count(*) FILTER ({c} IS NULL) FROM feed" for c in ("open", "high", "low", "volume")),
)
def consistency_report(spark, sf):
    return tidy(q.consistency_report(panel.raw_feed(spark, sf), ["symbol", "date"], ["open", "high", "low", "volume"]))


@query(
    "legacy_duplicate_dates",
    f"WITH {BARS} SELECT date, count(*) AS n FROM bars GROUP BY date HAVING count(*) > 1",
)
def legacy_duplicate_dates(spark, sf):
    return dist.duplicate_keys(panel.bars(spark, sf), ["date"])


def _checks_sql():
    parts = []
    for loader, t, measure, key, cols in (
        ("stock", "bars", "close", "symbol, date", ["close", "volume"]),
        ("index", "index_bars", "close", "symbol, date", ["close", "volume"]),
        ("treasury", "yields", "yr10", "date", TENORS),
    ):
        parts.append(
            f"SELECT '{loader}' AS loader, 'missing_dates' AS item, CAST((max(date) - min(date) + 1) - count(DISTINCT date) AS DOUBLE) AS value FROM {t}"
        )
        stats = f"(SELECT avg({measure}) AS m, stddev_pop({measure}) AS s, count({measure}) AS n FROM {t})"
        hit = f"count(*) FILTER (abs({measure} - m) > 3 * s)"
        for item, e in (("mean", "min(m)"), ("std_dev", "min(s)"), ("outlier_count", hit), ("outlier_percentage", f"{hit} / min(n) * 100")):
            parts.append(f"SELECT '{loader}', '{item}', {r(e, 5)} FROM {t}, {stats}")
        parts.append(f"SELECT '{loader}', 'duplicate_keys', CAST(count(*) AS DOUBLE) FROM (SELECT {key} FROM {t} GROUP BY {key} HAVING count(*) > 1)")
        parts += [f"SELECT '{loader}', 'nulls_{c}', CAST(count(*) FILTER ({c} IS NULL) AS DOUBLE) FROM {t}" for c in cols]
    return f"WITH {BARS_AND_INDEX}, {YIELDS} " + " UNION ALL ".join(parts)


@query("quality_checks", _checks_sql())
def quality_checks(spark, sf):
    out = q.quality_checks(
        {
            "stock": (panel.bars(spark, sf, panel.tasks(spark, sf)), ["symbol", "date"], "close", ["close", "volume"]),
            "index": (panel.index_bars(spark, sf), ["symbol", "date"], "close", ["close", "volume"]),
            "treasury": (panel.yields(spark, sf), ["date"], "yr10", TENORS),
        }
    )
    return tidy(out.select("loader", "item", "value"), 5)


@query(
    "guarded_features",
    f"""WITH {LAGGED}, f AS (SELECT symbol, date, volume / nullif(high - low, 0) AS a, ln(nullif(abs(close - open), 0)) AS b FROM rets)
    SELECT symbol, date, {r('a', 4)} AS volume_per_range, {r('b')} AS log_body FROM f""",
)
def guarded_features(spark, sf):
    span = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    # Infinities made here on purpose stand for what a feature formula may produce.
    df = panel.bars(spark, sf).select(
        "symbol",
        "date",
        F.when(span == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("volume"), span)).alias("volume_per_range"),
        F.when(body == 0, F.lit(float("nan"))).otherwise(F.log(body)).alias("log_body"),
    )
    return tidy(q.guarded_features(df, ["volume_per_range", "log_body"]), volume_per_range=4)


@query(
    "feature_guard",
    f"""WITH {LAGGED}, f AS (SELECT symbol, volume / nullif(high - low, 0) AS a, CASE WHEN symbol NOT LIKE '%3' THEN sr END AS b FROM rets)
    SELECT symbol, count(*) AS rows, count(a) AS values_volume_per_range, count(b) AS values_daily_return,
    CASE WHEN count(a) = 0 AND count(b) = 0 THEN 'all missing: volume_per_range,daily_return' WHEN count(a) = 0 THEN 'all missing: volume_per_range'
      WHEN count(b) = 0 THEN 'all missing: daily_return' ELSE 'ok' END AS status FROM f GROUP BY symbol""",
)
def feature_guard(spark, sf):
    """Which series have features that can be used; those of some symbols are taken away on purpose."""
    span = F.col("high") - F.col("low")
    step = F.try_divide(F.col("close"), F.lag("close").over(by_date())) - 1
    df = panel.bars(spark, sf).select(
        "symbol",
        F.when(span == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.col("volume"), span)).alias("volume_per_range"),
        F.when(F.col("symbol").endswith("3"), F.lit(float("nan"))).otherwise(step).alias("daily_return"),
    )
    return q.guard_report(df, ["volume_per_range", "daily_return"], "symbol")


@query(
    "split_price_window",
    f"""WITH {BARS}, {SPLITS} SELECT b.symbol, s.split_date, b.date, open, high, low, close, volume, b.date = s.split_date AS is_mark
    FROM bars b JOIN splits s ON b.symbol = s.symbol AND b.date BETWEEN s.split_date - 7 AND s.split_date + 7 WHERE ratio > 0""",
)
def split_price_window(spark, sf):
    return q.price_window(panel.bars(spark, sf), panel.splits(spark, sf).filter("ratio > 0"), "split_date")


@query(
    "stock_search",
    f"WITH {STOCKS} SELECT symbol, company_name FROM stocks WHERE contains(lower(symbol), '007') OR contains(lower(company_name), '007')",
)
def stock_search(spark, sf):
    return q.text_search(panel.stocks(spark, sf), "007", ["symbol", "company_name"]).select("symbol", "company_name")


@query(
    "cleaning_report",
    f"""WITH {STOCKS}, {LISTINGS}, {FEED}, f AS (SELECT symbol, date, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close FROM feed)
    SELECT 'missing_company_name' AS item, count(*) FILTER (company_name IS NULL) AS value FROM stocks
    UNION ALL SELECT 'missing_sector', count(*) FILTER (sector IS NULL) FROM stocks
    UNION ALL SELECT 'missing_industry', count(*) FILTER (industry IS NULL) FROM stocks
    UNION ALL SELECT 'inactive_count', count(*) FILTER (NOT is_active) FROM stocks
    UNION ALL SELECT 'outdated_symbols', count(*) FILTER (last_updated < {_ASOF} - INTERVAL 365 DAYS) FROM stocks
    UNION ALL SELECT 'invalid_symbols', count(*) FILTER (NOT regexp_full_match(symbol, '[A-Z0-9.-]+')) FROM listings
    UNION ALL SELECT 'duplicate_symbols', count(*) - count(DISTINCT symbol) FROM listings
    UNION ALL SELECT 'inconsistent_rows', count(*) FROM f WHERE low > open OR close > high OR low > close OR open > high""",
)
def cleaning_report(spark, sf):
    """Counts behind the cleaning report in one long table."""
    feed = feed_frame(spark, sf).withColumn("close", F.col("close").try_cast("double"))
    stocks, listings = panel.stocks(spark, sf), panel.listings(spark, sf)
    summary = stocks.agg(
        F.count_if(F.col("company_name").isNull()).alias("missing_company_name"),
        F.count_if(F.col("sector").isNull()).alias("missing_sector"),
        F.count_if(F.col("industry").isNull()).alias("missing_industry"),
        F.count_if(~F.col("is_active")).alias("inactive_count"),
        F.count_if(F.col("last_updated") < F.expr(f"{_ASOF} - INTERVAL 365 DAYS")).alias("outdated_symbols"),
    )
    out = summary.unpivot([], summary.columns, "item", "value")
    for item, df in (
        ("invalid_symbols", q.invalid_symbols(listings)),
        ("duplicate_symbols", q.repeated_symbols(listings, "row_id")),
        ("inconsistent_rows", feed.filter(q.is_inconsistent())),
    ):
        out = out.unionByName(df.agg(F.count("*").alias("value")).select(F.lit(item).alias("item"), "value"))
    return out


# --- merges -------------------------------------------------------------------

_STORED = f"stored AS (SELECT symbol, date, open, high, low, close, CASE WHEN year(date) % 2 = 0 THEN 0 ELSE volume END AS volume FROM bars WHERE date < {_DATES})"
_BATCH = f"""batch AS (SELECT symbol, date, open, high, low, close, volume FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY volume <= 0, {_O}) AS rn FROM valid) WHERE rn = 1)"""
_BARS_FEED = f"{BARS}, {VALID}"


def stored_bars(spark, sf):
    """Bars up to 1997, as stored; those of even years were filled with volume 0."""
    bars = panel.bars(spark, sf).filter(F.expr(f"date < {_DATES}"))
    return bars.withColumn("volume", F.when(F.year("date") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("volume")))


def landed_bars(spark, sf):
    return q.valid_stock_bars(feed_frame(spark, sf))


@query(
    "bar_upsert",
    f"""WITH {_BARS_FEED}, {_STORED}, {_BATCH} SELECT coalesce(s.symbol, b.symbol) AS symbol, coalesce(s.date, b.date) AS date, """
    + ", ".join(
        f"CASE WHEN s.symbol IS NULL OR (b.symbol IS NOT NULL AND s.volume = 0 AND b.volume > 0) THEN b.{c} ELSE s.{c} END AS {c}"
        for c in ("open", "high", "low", "close", "volume")
    )
    + " FROM stored s FULL OUTER JOIN batch b ON s.symbol = b.symbol AND s.date = b.date",
)
def bar_upsert(spark, sf):
    batch = up.fold_bars(landed_bars(spark, sf), _ORDER)
    return up.upsert_bars(stored_bars(spark, sf), batch.select("symbol", "date", *q.OHLCV))


@query(
    "yield_upsert",
    f"""WITH {YIELDS}, n AS (SELECT date, {', '.join(f'{t} + 1 AS {t}' for t in TENORS)} FROM yields WHERE date >= {_DATES})
    SELECT date, {', '.join(f'{r(t)} AS {t}' for t in TENORS)} FROM (SELECT * FROM yields WHERE date < {_DATES} UNION ALL SELECT * FROM n)""",
)
def yield_upsert(spark, sf):
    y = panel.yields(spark, sf)
    batch = y.filter(F.expr(f"date >= {_DATES}")).withColumns({t: F.col(t) + 1 for t in TENORS})
    return tidy(up.overwrite(y, batch, ["date"]))


@query(
    "company_upsert",
    f"""WITH {LISTINGS} SELECT symbol, arg_max(company_name, row_id) AS company_name, max(row_id) AS row_id, arg_max(is_active, row_id) AS is_active
    FROM listings GROUP BY symbol""",
)
def company_upsert(spark, sf):
    listings = panel.listings(spark, sf)
    stored = listings.filter("is_active")
    return up.overwrite(stored, listings, ["symbol"], ["row_id"])


@query(
    "insert_absent_bars",
    f"""WITH {VALID}, k AS (SELECT symbol, CASE WHEN volume > 0 THEN date END AS date, {_O}, close FROM valid),
    stored AS (SELECT DISTINCT symbol, date FROM k WHERE date < {_DATES})
    SELECT symbol, date, {_O}, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY {_O}) AS rn FROM k) n
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM stored s WHERE s.symbol = n.symbol AND s.date IS NOT DISTINCT FROM n.date)""",
)
def insert_absent_bars(spark, sf):
    """Insert-if-absent on a key that may be NULL."""
    batch = landed_bars(spark, sf).select(
        "symbol", F.when(F.col("volume") > 0, F.col("date")).alias("date"), *_ORDER, "close"
    )
    stored = batch.filter(F.expr(f"date < {_DATES}")).select("symbol", "date").distinct()
    return tidy(up.insert_absent(stored, batch, ["symbol", "date"], _ORDER))


@query(
    "bulk_update_bars",
    f"""WITH {BARS} SELECT symbol, date, open, high, low, CASE WHEN date >= {_DATES} AND volume > 20 THEN {r('close * 2')} ELSE close END AS close,
    CASE WHEN date >= {_DATES} THEN volume + 1 ELSE volume END AS volume FROM bars""",
)
def bulk_update_bars(spark, sf):
    bars = panel.bars(spark, sf)
    changes = bars.filter(F.expr(f"date >= {_DATES}")).select(
        "symbol", "date", F.when(F.col("volume") > 20, F.col("close") * 2).alias("close"), (F.col("volume") + 1).alias("volume")
    )
    return tidy(up.update_by_key(bars, changes, ["symbol", "date"], ["close", "volume"]))


@query(
    "metric_records",
    f"""WITH {LAGGED} SELECT '{{"symbol":"' || symbol || '","date":"' || CAST(date AS VARCHAR) || '","volume_change":'
      || coalesce(CAST(volume - lag(volume) OVER (PARTITION BY symbol ORDER BY date) AS VARCHAR), 'null') || '}}' AS record FROM rets""",
)
def metric_records(spark, sf):
    from barwright.functions.series import prev

    df = panel.bars(spark, sf).select("symbol", "date", (F.col("volume") - prev("volume")).alias("volume_change"))
    return up.json_records(df)


@query(
    "nan_to_null",
    f"WITH {LAGGED} SELECT symbol, date, {r('sr')} AS ret, [CASE WHEN sr IS NOT NULL THEN {r('sr')} END, close] AS pair FROM rets",
)
def nan_to_null(spark, sf):
    from barwright.functions.series import simple_return

    nan = F.lit(float("nan"))
    ret = F.coalesce(F.round(simple_return(), 6) + F.lit(0.0), nan)
    df = panel.bars(spark, sf).select("symbol", "date", ret.alias("ret"), F.array(ret, F.col("close")).alias("pair"))
    return up.without_nan(df)


@query(
    "latest_feed_wins",
    f"""WITH {BARS} SELECT symbol, date, CASE WHEN year(date) = 2000 THEN {r('close * 3')} WHEN date >= {_DATES} THEN {r('close * 2')} ELSE close END AS close FROM bars""",
)
def latest_feed_wins(spark, sf):
    bars = panel.bars(spark, sf).select("symbol", "date", "close")
    later = bars.filter(F.expr(f"date >= {_DATES}")).withColumn("close", F.col("close") * 2)
    today = bars.filter(F.year("date") == 2000).withColumn("close", F.col("close") * 3)
    return tidy(up.latest_wins([bars, later, today], ["symbol", "date"]))


@query(
    "split_adjusted_bars",
    f"""WITH {BARS}, {SPLITS}, f AS (SELECT b.symbol, b.date, exp(sum(coalesce(ln(nullif(s.ratio, 0)), 0))) AS factor
      FROM bars b LEFT JOIN splits s ON s.symbol = b.symbol AND b.date < s.split_date AND s.ratio > 0 GROUP BY b.symbol, b.date)
    SELECT b.symbol, b.date, {r('open / factor')} AS open, {r('high / factor')} AS high, {r('low / factor')} AS low,
      {r('close / factor')} AS close, {r('volume * factor', 4)} AS volume, {r('factor')} AS factor FROM bars b JOIN f ON b.symbol = f.symbol AND b.date = f.date""",
)
def split_adjusted_bars(spark, sf):
    return tidy(adjust.back_adjusted(panel.bars(spark, sf), panel.splits(spark, sf)), volume=4)


# --- joins --------------------------------------------------------------------


@query(
    "series_alignment",
    f"WITH {BARS_AND_INDEX} SELECT b.symbol, b.date, b.close, i.close AS index_close FROM bars b JOIN index_bars i ON i.symbol = 'SPX' AND i.date = b.date",
)
def series_alignment(spark, sf):
    spx = panel.index_bars(spark, sf).filter("symbol = 'SPX'").select("date", F.col("close").alias("index_close"))
    return al.inner_align(panel.bars(spark, sf).select("symbol", "date", "close"), spx, ["date"]).select(
        "symbol", "date", "close", "index_close"
    )


_GRID = f"""{MISSING}, grid AS (SELECT s.symbol, t.date, b.close FROM spans s JOIN trading t ON t.date BETWEEN s.first_date AND s.last_date
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = t.date)"""


@query("reindexed_closes", f"WITH {_GRID} SELECT symbol, date, close FROM grid")
def reindexed_closes(spark, sf):
    n = panel.tasks(spark, sf)
    bars = panel.bars(spark, sf, n)
    return al.reindex(bars.select("symbol", "date", "close"), dealt(cal.days(bar_spans(bars), "trading"), n, "symbol", "date"))


@query(
    "interpolated_closes",
    f"""WITH {_GRID}, n AS (SELECT *, last_value(close IGNORE NULLS) OVER p AS pv, last_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER p AS pd,
      first_value(close IGNORE NULLS) OVER f AS nv, first_value(CASE WHEN close IS NOT NULL THEN date END IGNORE NULLS) OVER f AS nd FROM grid
      WINDOW p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
             f AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT symbol, date, {r('coalesce(close, pv + (nv - pv) * (date - pd) / nullif(nd - pd, 0), pv, nv)', 9)} AS close FROM n""",
)
def interpolated_closes(spark, sf):
    n = panel.tasks(spark, sf)
    bars = panel.bars(spark, sf, n)
    days = dealt(cal.days(bar_spans(bars), "trading"), n, "symbol", "date")
    grid = al.reindex(bars.select("symbol", "date", "close"), days)
    return tidy(al.interpolate(dealt(grid, n, "symbol"), "close"), 9)


@query(
    "latest_close_before",
    f"""WITH {BARS}, {SPLITS} SELECT DISTINCT s.symbol, s.split_date AS date, b.close AS last_close FROM splits s
    LEFT JOIN LATERAL (SELECT close FROM bars b WHERE b.symbol = s.symbol AND b.date < s.split_date ORDER BY b.date DESC LIMIT 1) b ON true""",
)
def latest_close_before(spark, sf):
    marks = panel.splits(spark, sf).select("symbol", F.col("split_date").alias("date")).distinct()
    return al.latest_before(panel.bars(spark, sf), marks)


@query(
    "carried_forward_bars",
    f"""WITH {MISSING}, steps AS (SELECT symbol, date, CASE WHEN date - lag(date) OVER (PARTITION BY symbol ORDER BY date) > 3 THEN 1 ELSE 0 END AS brk FROM missing),
    islands AS (SELECT symbol, date, sum(brk) OVER (PARTITION BY symbol ORDER BY date) AS island FROM steps),
    rng AS (SELECT symbol, min(date) AS a, max(date) AS z FROM islands GROUP BY symbol, island),
    d AS (SELECT symbol, CAST(unnest(generate_series(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM rng WHERE z - a <= 5)
    SELECT d.symbol, d.date, b.close AS open, b.close AS high, b.close AS low, b.close, CAST(0 AS BIGINT) AS volume
    FROM d ASOF JOIN bars b ON b.symbol = d.symbol AND b.date < d.date WHERE isodow(d.date) <= 5""",
)
def carried_forward_bars(spark, sf):
    n = panel.tasks(spark, sf)
    bars = panel.bars(spark, sf, n)
    gone = dealt(cal.missing_days(bars, bar_spans(bars), tasks=n), n, "symbol")
    return al.carry_forward(bars, cal.ranges(gone), tasks=n)


@query(
    "date_alignment",
    f"""WITH {BARS}, f AS (SELECT symbol, date FROM bars WHERE date < DATE '2000-01-01'), t AS (SELECT symbol, date FROM bars WHERE date >= {_DATES})
    SELECT coalesce(f.symbol, t.symbol) AS symbol, coalesce(f.date, t.date) AS date,
      CASE WHEN f.date IS NOT NULL AND t.date IS NOT NULL THEN 'common' WHEN f.date IS NOT NULL THEN 'features_only' ELSE 'targets_only' END AS side
    FROM f FULL OUTER JOIN t ON f.symbol = t.symbol AND f.date = t.date""",
)
def date_alignment(spark, sf):
    bars = panel.bars(spark, sf)
    return al.date_alignment(bars.filter("date < DATE '2000-01-01'"), bars.filter(F.expr(f"date >= {_DATES}")))


@query(
    "common_dates",
    f"WITH {BARS} SELECT symbol, date FROM bars WHERE date < DATE '2000-01-01' INTERSECT SELECT symbol, date FROM bars WHERE date >= {_DATES}",
)
def common_dates(spark, sf):
    keys = panel.bars(spark, sf).select("symbol", "date")
    return keys.filter("date < DATE '2000-01-01'").intersect(keys.filter(F.expr(f"date >= {_DATES}")))


@query("unprocessed_symbols", f"WITH {STOCKS} SELECT symbol FROM stocks WHERE is_active AND symbol NOT IN (SELECT symbol FROM stocks WHERE quotetype = 'ETF')")
def unprocessed_symbols(spark, sf):
    stocks = panel.stocks(spark, sf)
    done = stocks.filter("quotetype = 'ETF'").select("symbol")
    return stocks.filter("is_active").select("symbol").join(done, "symbol", "left_anti")


# --- incremental loads ---------------------------------------------------------

_FULL = f"""{BARS}, {VALID}, {TRADING}, {_STORED}"""
_MERGED = """SELECT * FROM stored UNION ALL SELECT symbol, date, open, high, low, close, volume FROM fresh"""


def _refresh_sql(first: str) -> str:
    return f"""WITH {_FULL}, want AS (SELECT s.symbol, t.date FROM (SELECT symbol, {first} AS first_date, (SELECT max(date) FROM valid) AS last_date FROM bars b0
        LEFT JOIN (SELECT symbol, max(date) AS latest FROM stored GROUP BY symbol) l USING (symbol) GROUP BY symbol, latest) s
      JOIN trading t ON t.date >= s.first_date AND t.date <= s.last_date ANTI JOIN stored st ON st.symbol = s.symbol AND st.date = t.date),
    fresh AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.symbol, v.date ORDER BY v.volume <= 0, {_O}) AS rn FROM valid v
      SEMI JOIN want w ON w.symbol = v.symbol AND w.date = v.date) WHERE rn = 1)
    {_MERGED}"""


def _symbols(spark, sf):
    return panel.bars(spark, sf).select("symbol").distinct()


@query("daily_update", _refresh_sql("coalesce(latest + 1, DATE '1995-01-01')"))
def daily_update(spark, sf):
    """Trading days after the latest stored bar of each symbol, up to the last landed day."""
    stored, landed = stored_bars(spark, sf), landed_bars(spark, sf)
    want = inc.wanted_days(stored, _symbols(spark, sf), F.expr("DATE '1995-01-01'"), inc.last_day(landed), tail_only=True)
    return inc.refresh(stored, landed, want, _ORDER)


@query("historical_load", _refresh_sql("DATE '1996-01-01'"))
def historical_load(spark, sf):
    """Every trading day from the start to the last landed day that is not stored."""
    stored, landed = stored_bars(spark, sf), landed_bars(spark, sf)
    want = inc.wanted_days(stored, _symbols(spark, sf), F.expr("DATE '1996-01-01'"), inc.last_day(landed), tail_only=False)
    return inc.refresh(stored, landed, want, _ORDER)


@query(
    "rows_not_stored",
    f"WITH {BARS}, {_STORED} SELECT {_B} FROM bars WHERE date = DATE '1997-06-02' OR (symbol, date) NOT IN (SELECT (symbol, date) FROM stored)",
)
def rows_not_stored(spark, sf):
    return inc.not_stored(panel.bars(spark, sf), stored_bars(spark, sf), F.expr("DATE '1997-06-02'")).select(
        "symbol", "date", *q.OHLCV
    )


@query(
    "reload_range",
    f"""WITH {BARS}, {_STORED} SELECT * FROM stored WHERE NOT date BETWEEN DATE '1996-03-01' AND DATE '1998-03-31'
    UNION ALL SELECT {_B} FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1998-03-31'""",
)
def reload_range(spark, sf):
    return inc.reload(
        stored_bars(spark, sf), panel.bars(spark, sf), F.expr("DATE '1996-03-01'"), F.expr("DATE '1998-03-31'")
    )


@query(
    "gap_fill_start",
    f"""WITH {BARS}, {_STORED} SELECT symbol, coalesce(max(s.date) + 1, DATE '1995-01-01') AS first_date
    FROM (SELECT DISTINCT symbol FROM bars) LEFT JOIN stored s USING (symbol) GROUP BY symbol""",
)
def gap_fill_start(spark, sf):
    return inc.day_after_latest(stored_bars(spark, sf), _symbols(spark, sf), F.expr("DATE '1995-01-01'"))
