"""Queries over scans, provider feeds and calendars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.functions.series import dealt
from barwright.operators import calendar as cal
from barwright.plans.registry import query
from barwright.plans.sqltext import BARS, BARS_AND_INDEX, FEED, INDEX_BARS, SPLITS, STOCKS, YIELDS
from barwright.schema import INDEX_SYMBOLS, TENORS
from barwright.session import run_folder
from barwright.sources import loaders, panel, readers

_B = "symbol, date, open, high, low, close, volume"


@query(
    "bar_scan",
    f"WITH {BARS} SELECT {_B} FROM bars WHERE date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31'",
)
def bar_scan(spark, sf):
    return readers.scan_bars(panel.bars(spark, sf), "1996-01-01", "1999-12-31")


@query("bar_load", f"WITH {BARS} SELECT {_B} FROM bars")
def bar_load(spark, sf):
    return readers.load_bars(panel.bars(spark, sf))


@query("index_load", f"WITH {INDEX_BARS} SELECT {_B} FROM index_bars WHERE symbol = 'SPX'")
def index_load(spark, sf):
    index = panel.index_bars(spark, sf)
    unknown = readers.load_index(index, "UNKNOWN")
    return readers.load_index(index, "SPX").unionByName(unknown)


@query("index_close_series", f"WITH {INDEX_BARS} SELECT date, close AS \"NDX\" FROM index_bars WHERE symbol = 'NDX'")
def index_close_series(spark, sf):
    return readers.series_column(panel.index_bars(spark, sf), "close", "NDX", "NDX")


@query(
    "market_series",
    f"WITH {INDEX_BARS}, {YIELDS} SELECT symbol AS asset, date, close AS value FROM index_bars"
    " UNION ALL SELECT 'US10Y', date, yr10 FROM yields",
)
def market_series(spark, sf):
    return readers.market_series(panel.index_bars(spark, sf), panel.yields(spark, sf))


@query(
    "market_wide",
    f"WITH {INDEX_BARS}, {YIELDS}, long AS (SELECT symbol AS asset, date, close AS value FROM index_bars"
    " UNION ALL SELECT 'US10Y', date, yr10 FROM yields) SELECT date, "
    + ", ".join(f"max(value) FILTER (asset = '{a}') AS \"{a}\"" for a in INDEX_SYMBOLS + ["US10Y"])
    + " FROM long GROUP BY date",
)
def market_wide(spark, sf):
    return readers.market_wide(panel.index_bars(spark, sf), panel.yields(spark, sf))


@query(
    "feature_index_bundle",
    f"WITH {INDEX_BARS} SELECT {_B} FROM index_bars WHERE symbol <> 'OSX'",
)
def feature_index_bundle(spark, sf):
    return readers.feature_indices(panel.index_bars(spark, sf))


@query(
    "yield_scan",
    f"WITH {YIELDS} SELECT date, {', '.join(TENORS)} FROM yields"
    " WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31'",
)
def yield_scan(spark, sf):
    return readers.load_yields(panel.yields(spark, sf), "1996-01-01", "2000-12-31")


@query("active_stocks", f"WITH {STOCKS} SELECT symbol, company_name AS name FROM stocks WHERE is_active")
def active_stocks(spark, sf):
    return readers.active_stocks(panel.stocks(spark, sf))


@query("stock_dimension", f"WITH {STOCKS} SELECT * FROM stocks")
def stock_dimension(spark, sf):
    return panel.stocks(spark, sf)


@query(
    "provider_table_bars",
    f"WITH {FEED} SELECT symbol, date, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close,"
    " coalesce(volume, 0) AS volume FROM feed",
)
def provider_table_bars(spark, sf):
    landed = panel.raw_feed(spark, sf).select(
        F.col("symbol").alias("Symbol"),
        F.col("date").cast("timestamp").alias("Date"),
        F.col("open").alias("Open"),
        F.col("high").alias("High"),
        F.col("low").alias("Low"),
        F.expr("try_cast(close_text AS double)").alias("Close"),
        F.col("volume").alias("Volume"),
    )
    return readers.provider_table(landed)


@query(
    "provider_json_bars",
    f"WITH {FEED} SELECT symbol, date, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close, volume FROM feed",
)
def provider_json_bars(spark, sf):
    feed = panel.raw_feed(spark, sf)
    payload = F.to_json(
        F.struct(
            F.concat(F.col("date").cast("string"), F.lit("T05:00:00Z")).alias("t"),
            F.col("open").alias("o"),
            F.col("high").alias("h"),
            F.col("low").alias("l"),
            F.expr("try_cast(close_text AS double)").alias("c"),
            F.col("volume").alias("v"),
        )
    )
    return readers.provider_json(feed.select("symbol", payload.alias("payload")))


def yield_html(spark, sf):
    """One page per date: a header row, the yield row and a short row."""
    y = panel.yields(spark, sf)
    cells = []
    by_cell = {pos: t for t, pos in readers.YIELD_CELLS.items()}
    for pos in range(1, 25):
        text = F.coalesce(F.col(by_cell[pos]).cast("decimal(10,4)").cast("string"), F.lit("N/A")) if pos in by_cell else F.lit("x")
        cells.append(F.concat(F.lit("<td class=\"v\"> "), text, F.lit(" </td>")))
    row = F.concat(
        F.lit("<tr><td><time datetime=\""), F.col("date").cast("string"), F.lit("T00:00:00Z\">d</time></td>"), *cells, F.lit("</tr>")
    )
    html = F.concat(
        F.lit("<html><table class=\"other\"><tr><td>0</td></tr></table><table class=\"usa-table views\"><tr><th>Date</th></tr>"),
        row,
        F.lit("<tr><td>short</td></tr></table></html>"),
    )
    return y.select(F.concat(F.lit("page/"), F.col("date").cast("string")).alias("url"), html.alias("html"))


@query(
    "yield_page_rows",
    f"WITH {YIELDS} SELECT date, {', '.join(TENORS)} FROM yields"
    " WHERE date BETWEEN DATE '1995-06-01' AND DATE '2000-06-30'",
)
def yield_page_rows(spark, sf):
    return readers.yield_pages(yield_html(spark, sf), "1995-06-01", "2000-06-30")


@query("split_events", f"WITH {SPLITS} SELECT symbol, split_date, ratio FROM splits WHERE ratio > 0")
def split_events(spark, sf):
    return readers.split_events(panel.splits(spark, sf))


_EASTER = """easter AS (
  SELECT y, make_date(CAST(y AS INTEGER), CAST((h + l - 7 * m + 114) // 31 AS INTEGER), CAST((h + l - 7 * m + 114) % 31 + 1 AS INTEGER)) AS easter
  FROM (SELECT *, (a + 11 * h + 22 * l) // 451 AS m
   FROM (SELECT *, (32 + 2 * e + 2 * i - h - k) % 7 AS l
    FROM (SELECT *, (19 * a + b - d - g + 15) % 30 AS h, c // 4 AS i, c % 4 AS k
     FROM (SELECT *, (b - f + 1) // 3 AS g
      FROM (SELECT *, (b + 8) // 25 AS f, b // 4 AS d, b % 4 AS e
       FROM (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM (SELECT CAST(unnest(range((SELECT year(min(l_shipdate)) FROM lineitem), (SELECT year(max(l_shipdate)) + 1 FROM lineitem))) AS INTEGER) AS y))))))))"""
_DAYS = """days AS (SELECT CAST(unnest(generate_series(
    (SELECT min(l_shipdate) FROM lineitem), (SELECT max(l_shipdate) FROM lineitem), INTERVAL 1 DAY)) AS DATE) AS date)"""
TRADING = f"""{_EASTER},
{_DAYS},
holidays AS (
  SELECT easter - 2 AS date FROM easter
  UNION SELECT CASE isodow(make_date(y, m, d)) WHEN 7 THEN make_date(y, m, d) + 1
                    WHEN 6 THEN CASE WHEN m = 1 THEN NULL ELSE make_date(y, m, d) - 1 END
                    ELSE make_date(y, m, d) END
        FROM easter, (VALUES (1, 1, 0), (6, 19, 2022), (7, 4, 0), (12, 25, 0)) f(m, d, since) WHERE y >= since
  UNION SELECT make_date(y, m, 1) + CAST((8 - isodow(make_date(y, m, 1))) % 7 + 7 * (n - 1) AS INTEGER)
        FROM easter, (VALUES (1, 3, 1998), (2, 3, 0), (9, 1, 0)) f(m, n, since) WHERE y >= since
  UNION SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INTEGER) FROM easter
  UNION SELECT make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INTEGER) FROM easter
  UNION SELECT unnest([{', '.join(f"DATE '{x}'" for x in cal.SPECIAL_CLOSURES)}])),
trading AS (SELECT date FROM days WHERE isodow(date) <= 5 AND date NOT IN (SELECT date FROM holidays WHERE date IS NOT NULL))"""


@query("trading_days", f"WITH {TRADING} SELECT date FROM trading")
def trading_days(spark, sf):
    return cal.days(cal.span_of(panel.line_quotes(spark, sf)), "trading")


@query("calendar_days", f"WITH {_DAYS} SELECT date FROM days")
def calendar_days(spark, sf):
    return cal.days(cal.span_of(panel.line_quotes(spark, sf)), "calendar")


@query("weekdays", f"WITH {_DAYS} SELECT date FROM days WHERE isodow(date) <= 5")
def weekdays(spark, sf):
    return cal.days(cal.span_of(panel.line_quotes(spark, sf)), "weekday")


_SPANS = "spans AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol)"
MISSING = f"""{BARS}, {TRADING}, {_SPANS},
missing AS (
  SELECT s.symbol, t.date FROM spans s JOIN trading t ON t.date BETWEEN s.first_date AND s.last_date
  ANTI JOIN bars b ON b.symbol = s.symbol AND b.date = t.date)"""


def bar_spans(bars):
    return cal.span_of(bars, "symbol")


@query("missing_trading_days", f"WITH {MISSING} SELECT symbol, date FROM missing")
def missing_trading_days(spark, sf):
    n = panel.tasks(spark, sf)
    bars = panel.bars(spark, sf, n)
    return cal.missing_days(bars, bar_spans(bars), tasks=n)


@query(
    "missing_date_ranges",
    f"""WITH {MISSING}, steps AS (
      SELECT symbol, date, CASE WHEN date - lag(date) OVER (PARTITION BY symbol ORDER BY date) > 3 THEN 1 ELSE 0 END AS brk FROM missing),
    islands AS (SELECT symbol, date, sum(brk) OVER (PARTITION BY symbol ORDER BY date) AS island FROM steps)
    SELECT symbol, min(date) AS range_start, max(date) AS range_end, count(*) AS days FROM islands GROUP BY symbol, island""",
)
def missing_date_ranges(spark, sf):
    n = panel.tasks(spark, sf)
    bars = panel.bars(spark, sf, n)
    return cal.ranges(dealt(cal.missing_days(bars, bar_spans(bars), tasks=n), n, "symbol"))


@query(
    "missing_date_difference",
    f"""WITH {MISSING} SELECT symbol, date FROM (SELECT s.symbol, t.date FROM spans s
      JOIN trading t ON t.date BETWEEN s.first_date AND s.last_date) EXCEPT SELECT symbol, date FROM bars""",
)
def missing_date_difference(spark, sf):
    bars = panel.bars(spark, sf)
    # The days of a span differ, and a symbol has one span: what an EXCEPT would sort out besides is not there.
    days, known = cal.days(bar_spans(bars), "trading").select("symbol", "date"), bars.select(F.col("symbol").alias("s"), F.col("date").alias("d"))
    return days.join(known, F.col("symbol").eqNullSafe(F.col("s")) & F.col("date").eqNullSafe(F.col("d")), "left_anti")


@query(
    "date_chunks",
    f"""WITH {BARS}, {_SPANS} SELECT symbol, chunk_start, least(chunk_start + 999, last_date) AS chunk_end
    FROM (SELECT symbol, last_date, CAST(unnest(generate_series(CAST(first_date AS TIMESTAMP), CAST(last_date AS TIMESTAMP), INTERVAL 1000 DAY)) AS DATE) AS chunk_start FROM spans)""",
)
def date_chunks(spark, sf):
    return cal.chunks(bar_spans(panel.bars(spark, sf)))


@query(
    "common_market_days",
    f"""WITH {BARS_AND_INDEX}, {YIELDS}, market AS (
      SELECT date, count(*) AS n FROM (SELECT date FROM index_bars WHERE close IS NOT NULL
        UNION ALL SELECT date FROM yields WHERE yr10 IS NOT NULL) GROUP BY date HAVING count(*) = 8)
    SELECT b.symbol, b.date, b.close FROM bars b JOIN market m ON b.date = m.date""",
)
def common_market_days(spark, sf):
    from barwright.operators.alignment import complete_dates

    market = readers.market_series(panel.index_bars(spark, sf), panel.yields(spark, sf))
    return panel.bars(spark, sf).join(complete_dates(market, 8), "date").select("symbol", "date", "close")


# --- registered loaders ------------------------------------------------------------

_YEAR = "date BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'"


def _landed(spark, sf):
    """Folder of each loader, with provider files written from the given tables."""
    tables = {"stock": panel.bars(spark, sf), "index": panel.index_bars(spark, sf), "treasury": panel.yields(spark, sf)}
    folders = {name: run_folder(spark, f"landed-{name}") for name in tables}
    for name, df in tables.items():
        loaders.land(name, df, folders[name])
    return folders


@query(
    "registered_loader",
    f"""WITH {BARS_AND_INDEX} SELECT 'stock' AS loader, symbol, date, open, high, low, close, volume FROM bars WHERE {_YEAR}
    UNION ALL SELECT 'index', symbol, date, open, high, low, close, volume FROM index_bars WHERE {_YEAR} AND symbol = 'SPX'""",
)
def registered_loader(spark, sf):
    """Landed CSV and JSON read back through the registered loaders, range and symbol pushed to the source."""
    folders = _landed(spark, sf)
    stock = loaders.load(spark, "stock", folders["stock"], "1996-02-01", "1997-01-31")
    index = loaders.load(spark, "index", folders["index"], "1996-02-01", "1997-01-31", "SPX")
    return stock.select(F.lit("stock").alias("loader"), "*").unionByName(index.select(F.lit("index").alias("loader"), "*"))


@query("registered_treasury_loader", f"WITH {YIELDS} SELECT * FROM yields")
def registered_treasury_loader(spark, sf):
    return loaders.load(spark, "treasury", _landed(spark, sf)["treasury"])
