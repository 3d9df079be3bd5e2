"""Queries over listed defects, recent spans, catalogues, whole filings and the bundle of analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barwright.functions.series import by_date, log_return, prev, rolling, simple_return
from barwright.operators import (
    calendar as cal, distribution as dist, features as fe, filings as fi, incremental as inc, indicators as ind, jobs, models as mdl, quality as q, registry as reg,
    tail as ta, upsert as up, volatility as vol,
)
from barwright.plans.features import _MODELS, backtests, models
from barwright.plans.filings import _FACTS, _METRIC, _SUBS, filing_rows, parsed_facts
from barwright.plans.quality import _B, _FULL, _MERGED, _O, _ORDER, _STORED, _checks_sql, _symbols, feed_frame, landed_bars, stored_bars
from barwright.plans.registry import query, tidy
from barwright.plans.series import TAIL, _HIST, _NORM
from barwright.plans.sqltext import BARS, BARS_AND_INDEX, FEED, LAGGED, LISTINGS, STOCKS, YIELDS, r, rolling as roll, sig
from barwright.schema import TENORS
from barwright.session import run_folder
from barwright.sources import panel
from barwright.streaming import filings as stream

# --- listed defects ---------------------------------------------------------------


@query(
    "missing_date_lists",
    f"""WITH {BARS}, s AS (SELECT symbol, min(date) AS a, max(date) AS b FROM bars GROUP BY symbol),
    d AS (SELECT symbol, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS date FROM s)
    SELECT symbol, date FROM d ANTI JOIN bars USING (symbol, date)""",
)
def missing_date_lists(spark, sf):
    """Every calendar day without a bar between the first and last bar of each symbol."""
    bars = panel.bars(spark, sf)
    return cal.missing_days(bars, cal.span_of(bars, "symbol"), "calendar").select("symbol", "date")


_BROKEN = f"""{FEED}, f AS (SELECT symbol, date, {_O}, open, high, low, TRY_CAST(close_text AS DOUBLE) AS close FROM feed),
bad AS (SELECT * FROM f WHERE low > open OR close > high OR low > close OR open > high)"""


def _broken(spark, sf):
    feed = feed_frame(spark, sf).withColumn("close", F.col("close").try_cast("double"))
    return feed.select("symbol", "date", *_ORDER, "open", "high", "low", "close").filter(q.is_inconsistent())


@query(
    "first_inconsistent_rows",
    f"""WITH {_BROKEN} SELECT symbol, date, {_O}, open, high, low, close FROM
    (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date, {_O}) AS n FROM bad) WHERE n <= 5""",
)
def first_inconsistent_rows(spark, sf):
    """A report of the first five bad rows of each symbol."""
    order = F.struct("date", *_ORDER)
    return q.first_rows(_broken(spark, sf).withColumn("_order", order), "_order", 5).drop("_order")


@query(
    "cleaning_price_issues",
    f"""WITH {_BROKEN} SELECT symbol, count(*) FILTER (low > open) AS low_above_open, count(*) FILTER (close > high) AS close_above_high,
    count(*) FILTER (low > close) AS low_above_close, count(*) FILTER (open > high) AS open_above_high FROM bad GROUP BY symbol""",
)
def cleaning_price_issues(spark, sf):
    """Bad rows of each symbol by the rule they break; a row may break several."""
    rules = {"low_above_open": "low > open", "close_above_high": "close > high", "low_above_close": "low > close", "open_above_high": "open > high"}
    return _broken(spark, sf).groupBy("symbol").agg(*[F.count_if(F.expr(e)).alias(n) for n, e in rules.items()])


@query(
    "cleaning_issues",
    f"""WITH {STOCKS}, {LISTINGS} SELECT symbol, 'missing_sector' AS issue, CAST(1 AS BIGINT) AS n FROM stocks WHERE sector IS NULL
    UNION ALL SELECT symbol, 'missing_industry', 1 FROM stocks WHERE industry IS NULL
    UNION ALL SELECT symbol, 'inactive', 1 FROM stocks WHERE NOT is_active
    UNION ALL SELECT symbol, 'invalid_symbol', count(*) FROM listings WHERE NOT regexp_full_match(symbol, '[A-Z0-9.-]+') GROUP BY symbol
    UNION ALL SELECT symbol, 'duplicate_symbol', count(*) FROM listings GROUP BY symbol HAVING count(*) > 1""",
)
def cleaning_issues(spark, sf):
    """Each symbol with each thing that is wrong with its entry, in one pass over either table."""
    stocks, listings = panel.stocks(spark, sf), panel.listings(spark, sf)
    wrong = {"missing_sector": F.col("sector").isNull(), "missing_industry": F.col("industry").isNull(), "inactive": ~F.col("is_active")}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in wrong.items()]), lambda x: x.isNotNull())
    own = stocks.select("symbol", F.explode(found).alias("issue"), F.lit(1).cast("long").alias("n"))
    names = listings.groupBy("symbol").agg(F.count("*").alias("n"))
    wrong = {"invalid_symbol": ~F.col("symbol").rlike("^[A-Z0-9.-]+$"), "duplicate_symbol": F.col("n") > 1}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in wrong.items()]), lambda x: x.isNotNull())
    return own.unionByName(names.select("symbol", F.explode(found).alias("issue"), "n"))


@query(
    "frame_report",
    f"""WITH {FEED}, f AS (SELECT symbol, date, TRY_CAST(close_text AS DOUBLE) AS close FROM feed)
    SELECT symbol, count(*) AS rows, count(date) AS dates, count(close) AS closes, count(date) = count(close) AS equal_lengths, false AS empty FROM f GROUP BY symbol""",
)
def frame_report(spark, sf):
    """What a request frame needs, for each symbol of the raw feed."""
    feed = feed_frame(spark, sf).withColumn("close", F.col("close").try_cast("double"))
    return q.frame_report(feed, "symbol")


_LAST = 365


def _recent_sql():
    sql = _checks_sql()
    ctes = "".join(
        f", {t}_recent AS (SELECT * FROM {t} WHERE date > (SELECT max(date) FROM {t}) - {_LAST})" for t in ("bars", "index_bars", "yields")
    )
    head = f"WITH {BARS_AND_INDEX}, {YIELDS} "
    body = sql.removeprefix(head)
    for t in ("index_bars", "yields", "bars"):
        body = body.replace(f"FROM {t} ", f"FROM {t}_recent ").replace(f"FROM {t},", f"FROM {t}_recent,").replace(f"FROM {t})", f"FROM {t}_recent)")
        body = body.removesuffix(f"FROM {t}") + (f"FROM {t}_recent" if body.endswith(f"FROM {t}") else "")
    return head.rstrip() + ctes + " " + body


@query("quality_last_days", _recent_sql())
def quality_last_days(spark, sf):
    """The checks of every loader over its own last days."""
    recent = lambda df: df.filter(F.col("date") > F.date_sub(inc.last_day(df), _LAST))
    loaders = {
        "stock": (recent(panel.bars(spark, sf, panel.tasks(spark, sf))), ["symbol", "date"], "close", ["close", "volume"]),
        "index": (recent(panel.index_bars(spark, sf)), ["symbol", "date"], "close", ["close", "volume"]),
        "treasury": (recent(panel.yields(spark, sf)), ["date"], "yr10", TENORS),
    }
    return tidy(q.quality_checks(loaders).select("loader", "item", "value"), 5)


def _checked(spark, sf):
    """Loader inputs of the checks, made when asked for; the last one's folder does not exist."""
    columns = ["close", "volume"]
    return {
        "stock": lambda: (panel.bars(spark, sf, panel.tasks(spark, sf)), ["symbol", "date"], "close", columns),
        "nowhere": lambda: (spark.read.parquet(f"{sf}/no_such_table.parquet"), ["symbol", "date"], "close", columns),
        "index": lambda: (panel.index_bars(spark, sf), ["symbol", "date"], "close", columns),
        "treasury": lambda: (panel.yields(spark, sf), ["date"], "yr10", TENORS),
    }


@query(
    "quality_checks_each",
    f"""SELECT loader, item, value, CAST(NULL AS VARCHAR) AS error FROM ({_checks_sql()}) UNION ALL SELECT 'nowhere', NULL, NULL, 'PATH_NOT_FOUND'""",
)
def quality_checks_each(spark, sf):
    """The checks of every loader; one that cannot be read gives its error and stops none of the others."""
    return tidy(jobs.checks_of_each(spark, _checked(spark, sf)), 5)


@query(
    "load_with_checks",
    f"""WITH {BARS}, c AS (SELECT * FROM ({_checks_sql()}) WHERE loader = 'stock')
    SELECT 'stock' AS loader, 'rows' AS item, CAST(count(*) AS DOUBLE) AS value, CAST(NULL AS VARCHAR) AS error FROM bars
    UNION ALL SELECT 'stock', 'first_day', CAST(min(date) - DATE '1970-01-01' AS DOUBLE), NULL FROM bars
    UNION ALL SELECT 'stock', 'last_day', CAST(max(date) - DATE '1970-01-01' AS DOUBLE), NULL FROM bars
    UNION ALL SELECT loader, item, value, NULL FROM c""",
)
def load_with_checks(spark, sf):
    """Bars as they are written, with the checks of what was written."""
    path = run_folder(spark, "checked-bars")
    return tidy(jobs.write_checked(panel.bars(spark, sf), path, "stock", ["symbol", "date"], "close", ["close", "volume"]), 5)


@query(
    "month_order",
    f"""WITH {BARS}, m AS (SELECT symbol, date_trunc('month', date) AS m, count(*) AS n FROM bars GROUP BY ALL)
    SELECT symbol, strftime(m, '%b %Y') AS label, row_number() OVER (PARTITION BY symbol ORDER BY m) AS month_rank, n FROM m""",
)
def month_order(spark, sf):
    """Month labels of each symbol with their place in time."""
    return dist.month_order(panel.bars(spark, sf))


# --- incremental -----------------------------------------------------------------


@query(
    "gap_fill",
    f"""WITH {_FULL}, want AS (SELECT s.symbol, t.date FROM (SELECT symbol, coalesce(latest + 1, DATE '1995-01-01') AS first_date,
        (SELECT max(date) - 1 FROM valid) AS last_date FROM bars b0
        LEFT JOIN (SELECT symbol, max(date) AS latest FROM stored GROUP BY symbol) l USING (symbol) GROUP BY symbol, latest) s
      JOIN trading t ON t.date >= s.first_date AND t.date <= s.last_date ANTI JOIN stored st ON st.symbol = s.symbol AND st.date = t.date),
    fresh AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY v.symbol, v.date ORDER BY v.volume <= 0, {_O}) AS rn FROM valid v
      SEMI JOIN want w ON w.symbol = v.symbol AND w.date = v.date) WHERE rn = 1)
    {_MERGED}""",
)
def gap_fill(spark, sf):
    """From the day after the latest bar to the day before the as-of date."""
    stored, landed = stored_bars(spark, sf), landed_bars(spark, sf)
    end = F.date_sub(inc.last_day(landed), 1)
    want = inc.wanted_days(stored, _symbols(spark, sf), F.expr("DATE '1995-01-01'"), end, tail_only=True)
    return inc.refresh(stored, landed, want, _ORDER)


@query(
    "reload_last_days",
    f"""WITH {BARS_AND_INDEX}, {_STORED}, l AS (SELECT max(date) - 60 AS a FROM stored), li AS (SELECT max(date) - 60 AS a FROM index_bars)
    SELECT 'stock' AS loader, {_B} FROM stored WHERE date <= (SELECT a FROM l)
    UNION ALL SELECT 'stock', {_B} FROM bars WHERE date > (SELECT a FROM l) AND date <= (SELECT a FROM l) + 60
    UNION ALL SELECT 'index', {_B} FROM index_bars""",
)
def reload_last_days(spark, sf):
    """The last sixty days of every loader taken again from what has landed."""
    out = None
    for name, stored, landed in (
        ("stock", stored_bars(spark, sf), panel.bars(spark, sf)),
        ("index", panel.index_bars(spark, sf), panel.index_bars(spark, sf)),
    ):
        part = inc.reload_last(stored.select("symbol", "date", *q.OHLCV), landed, 60).withColumn("loader", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


# Stored tables that differ from what has landed: older, and wrong in even years.
_CUT = "DATE '1997-07-01'"
_STORED_INDEX = f"stored_index AS (SELECT symbol, date, open, high, low, close, CASE WHEN year(date) % 2 = 0 THEN 0 ELSE volume END AS volume FROM index_bars WHERE date < {_CUT} AND symbol <> 'OSX')"
_STORED_YIELDS = f"stored_yields AS (SELECT date, {', '.join(t for t in TENORS if t != 'yr10')}, CASE WHEN year(date) % 2 = 1 THEN yr10 END AS yr10 FROM yields WHERE date < {_CUT})"
_LOADED = f"{BARS_AND_INDEX}, {YIELDS}, {_STORED}, {_STORED_INDEX}, {_STORED_YIELDS}"


def _landings(spark, sf):
    """What is stored and what has landed of each loader, made when asked for."""

    def index():
        landed = panel.index_bars(spark, sf)
        stored = landed.filter(F.expr(f"date < {_CUT}") & (F.col("symbol") != "OSX"))
        return jobs.Landing(stored.withColumn("volume", F.when(F.year("date") % 2 == 0, F.lit(0).cast("bigint")).otherwise(F.col("volume"))), landed)

    def treasury():
        landed = panel.yields(spark, sf)
        return jobs.Landing(landed.filter(F.expr(f"date < {_CUT}")).withColumn("yr10", F.when(F.year("date") % 2 == 1, F.col("yr10"))), landed, ())

    return {"stock": lambda: jobs.Landing(stored_bars(spark, sf), panel.bars(spark, sf)), "index": index, "treasury": treasury}


def _long_sql(loader, table, columns, where="", symbol="symbol"):
    return " UNION ALL ".join(f"SELECT '{loader}' AS loader, {symbol} AS symbol, date, '{c}' AS item, CAST({c} AS DOUBLE) AS value FROM {table} {where}" for c in columns)


def _each_sql(rule):
    """Long rows of the three loaders; ``rule`` gives (condition on stored, condition on landed) of a loader's tables."""
    parts = []
    for name, stored, landed, columns, symbol in (
        ("stock", "stored", "bars", ["close", "volume"], "symbol"), ("index", "stored_index", "index_bars", ["close", "volume"], "symbol"),
        ("treasury", "stored_yields", "yields", TENORS, "CAST(NULL AS VARCHAR)"),
    ):
        old, new = rule(stored, landed, symbol == "symbol")
        parts += [_long_sql(name, stored, columns, old, symbol), _long_sql(name, landed, columns, new, symbol)]
    return f"WITH {_LOADED} SELECT *, CAST(NULL AS VARCHAR) AS error FROM ({' UNION ALL '.join(parts)})"


def _fill_rule(stored, landed, keyed):
    own = f" WHERE {stored}.symbol = {landed}.symbol" if keyed else ""
    return "", f"WHERE date < (SELECT max(date) FROM {landed}) AND date > coalesce((SELECT max(date) FROM {stored}{own}), DATE '0001-01-01')"


def _reload_rule(stored, landed, keyed):
    end = f"(SELECT max(date) FROM {stored})"
    return f"WHERE date <= {end} - 60", f"WHERE date > {end} - 60 AND date <= {end}"


_LONG = "symbol string, date date, item string, value double"


def _values(name):
    return TENORS if name == "treasury" else ["close", "volume"]


@query("gap_fill_each", _each_sql(_fill_rule))
def gap_fill_each(spark, sf):
    """Every loader filled from the day after its latest stored rows to the day before the last landed one."""
    return jobs.each_loader(spark, _landings(spark, sf), lambda name, landing: jobs.long_rows(jobs.filled(landing), _values(name)), _LONG)


@query("reload_each", _each_sql(_reload_rule))
def reload_each(spark, sf):
    """The last sixty stored days of every loader taken again from what has landed."""
    return jobs.each_loader(spark, _landings(spark, sf), lambda name, landing: jobs.long_rows(jobs.reloaded(landing, 60), _values(name)), _LONG)


@query(
    "poll_against_stored",
    """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession_number,
    CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderstatus <> 'F'""",
)
def poll_against_stored(spark, sf):
    """A poll whose batches are held against the stored filings before they are appended."""
    orders = panel.table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    path = run_folder(spark, "stored-filings")
    stream.order_filings(orders).write.parquet(path)
    return stream.drain_orders(spark, sf, stored=path)


# --- filings ---------------------------------------------------------------------

_ASOF = "2001-12-31"


@query(
    "company_metrics",
    f"""WITH {_FACTS}, {STOCKS} SELECT {_METRIC.replace('cik, symbol,', 'cik, p.symbol,')}, company_name, sector, industry, '{_ASOF}' AS captured_at
    FROM points p LEFT JOIN stocks s ON s.symbol = p.symbol WHERE metric <> 'NetIncomeLoss'""",
)
def company_metrics(spark, sf):
    """Key metrics with all sixteen fields."""
    stocks = panel.stocks(spark, sf)
    return tidy(fi.with_company(fi.key_metrics(parsed_facts(spark, sf)), stocks, F.lit(_ASOF)))


@query(
    "companies_by_cik",
    f"""WITH {_SUBS}, n AS (SELECT cik, company_name, max(filing_date) AS updated_at FROM filings GROUP BY ALL)
    SELECT lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik, coalesce(company_name, c_name) AS company_name, coalesce(updated_at, '1990-01-01') AS updated_at
    FROM customer LEFT JOIN n ON n.cik = lpad(CAST(c_custkey AS VARCHAR), 10, '0')""",
)
def companies_by_cik(spark, sf):
    """Company table written over by the names that filings report."""
    stored = panel.table(spark, sf, "customer").select(
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("company_name"), F.lit("1990-01-01").alias("updated_at")
    )
    rows = filing_rows(spark, sf).groupBy("cik", "company_name").agg(F.max("filing_date").alias("updated_at"))
    return fi.upsert_companies(stored, rows)


@query(
    "unique_violations",
    f"""WITH {_FACTS}, {LISTINGS}, m AS (SELECT {_METRIC} FROM points)
    SELECT 'listing_symbol' AS item, count(*) AS n FROM (SELECT symbol FROM listings GROUP BY symbol HAVING count(*) > 1)
    UNION ALL SELECT 'company_cik', count(*) FROM (SELECT c_custkey FROM customer GROUP BY c_custkey HAVING count(*) > 1)
    UNION ALL SELECT 'metric', count(*) FROM (SELECT cik, symbol, metric, period_end, value FROM m GROUP BY ALL HAVING count(*) > 1)""",
)
def unique_violations(spark, sf):
    """Keys that occur more than once, over companies, listings and metrics."""
    metrics = fi.key_metrics(parsed_facts(spark, sf), [*fi.KEY_METRICS, "NetIncomeLoss"])
    checks = {
        "listing_symbol": (panel.listings(spark, sf), ["symbol"]),
        "company_cik": (panel.table(spark, sf, "customer"), ["c_custkey"]),
        "metric": (metrics, fi.METRIC_KEY),
    }
    out = None
    for item, (df, keys) in checks.items():
        part = dist.duplicate_keys(df, keys).agg(F.count("*").alias("n")).select(F.lit(item).alias("item"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "fact_schema",
    f"""WITH {_FACTS} SELECT 'us-gaap' AS taxonomy, metric, unit, count(*) AS points,
    arg_min(value, CAST(d AS VARCHAR) || accn || lpad(CAST(length(value) AS VARCHAR), 4, '0')) AS first_value FROM points GROUP BY ALL""",
)
def fact_schema(spark, sf):
    """Taxonomies, tags and units with how many values they hold and the first of them."""
    return fi.schema_of_facts(parsed_facts(spark, sf))


@query("ticker_file", "SELECT lower(c_mktsegment) AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer")
def ticker_file(spark, sf):
    """Directory from lines of ticker and number parted by a tab."""
    c = panel.table(spark, sf, "customer")
    lines = c.select(F.concat(F.lower("c_mktsegment"), F.lit("\t"), F.col("c_custkey").cast("string")).alias("line"))
    return fi.tickers_of_lines(lines)


# --- registries ------------------------------------------------------------------


@query(
    "model_write",
    f"""WITH {_MODELS} SELECT model_id, model_type, {r('CASE WHEN r2 < 0.2 THEN r2 + 1 ELSE r2 END', 8)} AS r2 FROM models
    UNION ALL SELECT -1 - s_suppkey, 'new', 0.5 FROM supplier""",
)
def model_write(spark, sf):
    """Models created where absent, and listed fields updated."""
    stored = models(spark, sf).select("model_id", "model_type", "r2")
    fresh = panel.table(spark, sf, "supplier").select((-1 - F.col("s_suppkey")).alias("model_id"), F.lit("new").alias("model_type"), F.lit(0.5).alias("r2"))
    created = stored.unionByName(up.insert_absent(stored, fresh, ["model_id"], ["model_type"]))
    changes = stored.filter("r2 < 0.2").select("model_id", (F.col("r2") + 1).alias("r2"))
    return tidy(up.update_by_key(created, changes, ["model_id"], ["r2"]), 8)


@query(
    "model_delete_children",
    f"WITH {_MODELS} SELECT l_orderkey AS model_id, l_linenumber AS feature, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT model_id FROM models WHERE r2 >= 0.1) GROUP BY ALL",
)
def model_delete_children(spark, sf):
    """Importance rows left when weak models are deleted with their children."""
    gone = models(spark, sf).filter("r2 < 0.1")
    rows = panel.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("feature")).agg(F.count("*").alias("n"))
    known = rows.join(models(spark, sf).select("model_id"), "model_id", "left_semi")
    return up.delete_by_key(known, gone, ["model_id"])


_CATALOGUE = "cat AS (SELECT p_partkey AS id, p_name AS name, p_brand AS type, p_retailprice AS mean FROM part)"


def catalogue(spark, sf) -> DataFrame:
    return panel.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("type"), F.col("p_retailprice").alias("mean")
    )


@query(
    "catalogue_write",
    f"""WITH {_CATALOGUE} SELECT id, name, CASE WHEN id % 5 = 0 THEN 'updated' ELSE type END AS type, mean FROM cat WHERE id % 7 <> 0
    UNION ALL SELECT -1 - id, name, 'saved', mean FROM cat WHERE id % 11 = 0""",
)
def catalogue_write(spark, sf):
    """Feature catalogue: new entries saved, some updated, some deleted."""
    stored = catalogue(spark, sf)
    fresh = stored.filter("id % 11 = 0").withColumns({"id": -1 - F.col("id"), "type": F.lit("saved")})
    saved = stored.unionByName(up.insert_absent(stored, fresh, ["id"], ["name"]))
    changed = up.update_by_key(saved, stored.filter("id % 5 = 0").select("id", F.lit("updated").alias("type")), ["id"], ["type"])
    return up.delete_by_key(changed, stored.filter("id % 7 = 0"), ["id"])


@query("catalogue_lookup", f"WITH {_CATALOGUE} SELECT id, name FROM cat WHERE type = 'Brand#5'")
def catalogue_lookup(spark, sf):
    """Entries by type; an id or nothing at all may be asked for as well."""
    return reg.search(catalogue(spark, sf), {"id": None, "type": "Brand#5"}).select("id", "name")


@query(
    "backtest_lookup",
    "SELECT o_orderkey AS backtest_id, o_custkey AS model_id FROM orders WHERE o_custkey <= 50 AND o_totalprice / 1000 >= 100 AND o_orderdate >= TIMESTAMP '1997-01-01'",
)
def backtest_lookup(spark, sf):
    """Back-tests by model range, date and reported return together."""
    dated = panel.table(spark, sf, "orders").select(F.col("o_orderkey").alias("backtest_id"), F.to_date("o_orderdate").alias("run_at"))
    found = reg.search(backtests(spark, sf).join(dated, "backtest_id"), at_least={"run_at": "1997-01-01"}).filter("model_id <= 50")
    return reg.min_return(found, 100.0).select("backtest_id", "model_id")


@query(
    "fold_errors",
    f"""WITH {LAGGED}, e AS (SELECT symbol, year(date) AS fold, avg((close - pc) ** 2) AS mse FROM rets WHERE pc IS NOT NULL GROUP BY ALL)
    SELECT symbol, count(*) AS folds, {sig('avg(mse)')} AS mean_mse, {sig('stddev_samp(mse)')} AS std_mse FROM e GROUP BY symbol HAVING count(*) > 1""",
)
def fold_errors(spark, sf):
    """Mean and deviation over yearly folds of the error of the last close as a forecast."""
    p = panel.bars(spark, sf).select("symbol", F.year("date").alias("fold"), F.col("close").alias("actual"), prev("close").alias("predicted")).dropna()
    out = reg.fold_measures(reg.regression_measures(p, "symbol", "fold"), "symbol")
    return tidy(out.filter("folds > 1"), significant=("mean_mse", "std_mse"))


@query(
    "ensemble_predictions",
    f"""WITH {LAGGED}, p AS (SELECT symbol, date, lag(close, 1) OVER w AS a, CASE WHEN count(close) OVER v = 5 THEN avg(close) OVER v END AS b FROM lagged
      WINDOW w AS (PARTITION BY symbol ORDER BY date), v AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT symbol, date, {r('CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (2 * a + b) / 3 END')} AS predicted FROM p WHERE a IS NOT NULL OR b IS NOT NULL""",
)
def ensemble_predictions(spark, sf):
    """Weighted mean of two forecasts; a member without a forecast drops out, a missing weight counts 1."""
    bars = panel.bars(spark, sf).select("symbol", "date", prev("close").alias("m1"), rolling(F.avg("close"), "close", 5).alias("m2"))
    long = bars.unpivot(["symbol", "date"], ["m1", "m2"], "model_id", "predicted").filter("predicted IS NOT NULL")
    members = spark.createDataFrame([("e", "m1", 2.0), ("e", "m2", None)], "ensemble_id string, model_id string, weight double")
    return tidy(reg.ensemble_mean(long, members).drop("ensemble_id"))


# --- features, models and chart tables ------------------------------------------------


@query(
    "joined_feature_sets",
    f"""WITH {LAGGED}, {STOCKS}, {YIELDS}, m AS (SELECT sector, date, avg(sr) AS mean FROM rets JOIN stocks USING (symbol) WHERE sr IS NOT NULL AND sector IS NOT NULL GROUP BY sector, date)
    SELECT r.symbol, r.date, {r('r.sr - m.mean')} AS strength, {r('yr10 - yr2')} AS slope_10y_2y FROM rets r LEFT JOIN stocks s ON s.symbol = r.symbol
    LEFT JOIN m ON m.sector = s.sector AND m.date = r.date LEFT JOIN yields y ON y.date = r.date""",
)
def joined_feature_sets(spark, sf):
    bars = panel.bars(spark, sf)
    out = fe.feature_set(bars, "sector", "yield_curve", stocks=panel.stocks(spark, sf), yields=panel.yields(spark, sf))
    return tidy(out.select("symbol", "date", "strength", "slope_10y_2y"))


@query(
    "alpha_targets",
    f"""WITH {BARS_AND_INDEX}, j AS (SELECT b.symbol, b.date, b.close, i.close AS m FROM bars b JOIN index_bars i ON i.symbol = 'SPX' AND i.date = b.date),
    t AS (SELECT symbol, date, lead(close, 5) OVER w / close - 1 - (lead(m, 5) OVER w / m - 1) AS a FROM j WINDOW w AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, date, {r('a')} AS target_alpha, a > 0.01 AS beats FROM t WHERE a IS NOT NULL""",
)
def alpha_targets(spark, sf):
    market = panel.index_bars(spark, sf).filter("symbol = 'SPX'")
    return tidy(fe.alpha_target(panel.bars(spark, sf), market, threshold=0.01))


@query("close_position_nullable", f"WITH {BARS} SELECT symbol, date, {r('(close - low) / nullif(high - low, 0)', 9)} AS close_position FROM bars")
def close_position_nullable(spark, sf):
    return tidy(panel.bars(spark, sf).select("symbol", "date", ind.close_position_or_null().alias("close_position")), 9)


@query(
    "volatility_chart",
    f"""WITH {LAGGED}, v AS (SELECT symbol, date, close, ({roll('stddev_samp(lr)', 'lr', 5)}) * sqrt(252) AS short, ({roll('stddev_samp(lr)', 'lr', 21)}) * sqrt(252) AS long FROM rets)
    SELECT symbol, date, close, {r('short')} AS vol_5d, {r('long')} AS vol_21d, short > long AS rising FROM v WHERE long IS NOT NULL AND short IS NOT NULL""",
)
def volatility_chart(spark, sf):
    """Short against long volatility beside the close, ready to draw."""
    v = vol.rolling_volatility(panel.bars(spark, sf), [5, 21]).filter("vol_5d IS NOT NULL AND vol_21d IS NOT NULL")
    return tidy(v.select("symbol", "date", "close", "vol_5d", "vol_21d", (F.col("vol_5d") > F.col("vol_21d")).alias("rising")))


@query("model_holdout")
def model_holdout(spark, sf):
    """Four model types on whether the next close is higher, judged on the last part of each series."""
    bars = ind.candle_metrics(panel.bars(spark, sf)).withColumn("r1", simple_return())
    frame = bars.withColumn("label", (F.lead("close").over(by_date()) > F.col("close")).cast("double")).dropna(subset=["label", "r1"])
    features = ["r1", "body_size_norm", "upper_shadow_norm", "lower_shadow_norm", "close_position"]
    # The learners pass over their rows many times: they read what they need from files, and not the whole plan.
    path = run_folder(spark, "model-frame")
    # Row groups are small, as a task reads whole ones.
    fe.chronological_split(frame).select("part", "label", *features).write.option("parquet.block.size", 8 << 20).parquet(path)
    part = spark.read.parquet(path)
    with mdl.read_in(spark, panel.tasks_for(spark, part.count())):
        return mdl.holdout(part.filter("part = 'train'"), part.filter("part = 'test'"), features)


# --- all analyses of one panel ------------------------------------------------------


@query(
    "eda_bundle",
    f"""WITH {TAIL}, {_HIST}, {_NORM},
    s AS (SELECT symbol, count(*) AS n, avg(close) AS m, min(close) AS lo, max(close) AS hi, count(*) FILTER (sr > 0) AS up, count(*) FILTER (sr <= 0) AS down,
      avg(volume) AS v, stddev_samp(lr) * sqrt(252) AS vol FROM rets GROUP BY symbol)
    SELECT symbol, 'tail' AS analysis, 'historical_var' AS item, {sig('var')} AS value FROM hist UNION ALL SELECT symbol, 'tail', 'historical_cvar', {sig('cvar')} FROM hist
    UNION ALL SELECT symbol, 'tail', 'normal_var', {sig('var')} FROM norm UNION ALL SELECT symbol, 'tail', 'normal_cvar', {sig('cvar')} FROM norm
    """
    + " ".join(
        f"UNION ALL SELECT symbol, '{a}', '{i}', {sig(c)} FROM s WHERE {c} IS NOT NULL"
        for a, i, c in (
            ("price", "rows", "n"), ("price", "mean", "m"), ("price", "low", "lo"), ("price", "high", "hi"),
            ("volume", "up_days", "up"), ("volume", "down_days", "down"), ("volume", "mean", "v"), ("volatility", "annual", "vol"),
        )
    ),
)
def eda_bundle(spark, sf):
    """One long table of several analyses over one read of the panel, which is written once and shared."""
    path = run_folder(spark, "panel")
    panel.bars(spark, sf).write.parquet(path)
    bars = spark.read.parquet(path)
    returns = ta.tail_returns(bars)
    step = F.try_divide(F.col("close"), F.lag("close").over(by_date())) - 1
    own = bars.select("symbol", "close", "volume", step.alias("sr"), log_return().alias("lr")).groupBy("symbol").agg(
        F.count("*").alias("price/rows"), F.avg("close").alias("price/mean"), F.min("close").alias("price/low"), F.max("close").alias("price/high"),
        F.count_if(F.col("sr") > 0).alias("volume/up_days"), F.count_if(F.col("sr") <= 0).alias("volume/down_days"), F.avg("volume").alias("volume/mean"),
        (F.stddev_samp("lr") * F.sqrt(F.lit(252.0))).alias("volatility/annual"),
    )
    parts = [(own, [c for c in own.columns if c != "symbol"])]
    for name, df in (("historical", ta.historical_var(returns)), ("normal", ta.normal_var(returns))):
        parts.append((df.select("symbol", F.col("var").alias(f"tail/{name}_var"), F.col("cvar").alias(f"tail/{name}_cvar")), [f"tail/{name}_var", f"tail/{name}_cvar"]))
    out = None
    for df, items in parts:
        long = F.inline(F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("analysis", "item"), i.split("/"), strict=True)], F.col(f"`{i}`").cast("double").alias("value")) for i in items]))
        part = df.select("symbol", long).filter("value IS NOT NULL")
        out = part if out is None else out.unionByName(part)
    return tidy(out, significant=("value",))
