"""Queries over filing documents and request streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import distribution as dist, filings as fi
from barwright.plans.registry import query, tidy
from barwright.plans.sqltext import STOCKS
from barwright.sources import filings as src, panel
from barwright.streaming import filings as stream, quota

_SUBS = """orders0 AS (SELECT *, CAST(o_orderdate AS DATE) AS d, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS key,
  lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
filings AS (
  SELECT cik, 'Customer ' || CAST(o_custkey AS VARCHAR) AS company_name, o_orderpriority AS form_type, CAST(d AS VARCHAR) AS filing_date,
    key || '-1' AS accession_number, o_orderstatus AS file_number, CAST(NULL AS VARCHAR) AS items, cents AS size,
    CAST(1 AS BIGINT) AS "isXBRL", CAST(0 AS BIGINT) AS "isInlineXBRL", 'doc' || key || '.htm' AS "primaryDocument", 'report' AS "primaryDocDescription" FROM orders0
  UNION ALL
  SELECT cik, 'Customer ' || CAST(o_custkey AS VARCHAR), '8-K', CAST(d + 30 AS VARCHAR), key || '-2', NULL, NULL, cents + 1, 0, NULL, NULL, 'notice' FROM orders0)"""


def filing_rows(spark, sf):
    return fi.filings(fi.submissions(src.submission_documents(spark, sf)))


@query("filing_rows", f"WITH {_SUBS} SELECT * FROM filings")
def filing_list(spark, sf):
    return tidy(filing_rows(spark, sf))


@query(
    "latest_filings",
    f"WITH {_SUBS} SELECT cik, arg_max(accession_number, filing_date || accession_number) AS latest_accession, max(filing_date) AS latest_date FROM filings GROUP BY cik",
)
def latest_filings(spark, sf):
    return fi.latest_filings(filing_rows(spark, sf))


_CUT = "1998-06-01"


@query("new_filings", f"WITH {_SUBS} SELECT cik, accession_number, filing_date FROM filings WHERE filing_date >= '{_CUT}'")
def new_filings(spark, sf):
    rows = fi.filing_keys(src.submission_documents(spark, sf))
    return fi.new_filings(rows, rows.filter(F.col("filing_date") < _CUT)).select("cik", "accession_number", "filing_date")


@query(
    "filings_above_mark",
    f"""WITH {_SUBS}, m AS (SELECT cik, arg_max(accession_number, filing_date || accession_number) AS mark FROM filings WHERE filing_date < '{_CUT}' GROUP BY cik)
    SELECT f.cik, accession_number, filing_date FROM filings f LEFT JOIN m ON m.cik = f.cik WHERE mark IS NULL OR accession_number > mark""",
)
def filings_above_mark(spark, sf):
    rows = fi.filing_keys(src.submission_documents(spark, sf))
    return fi.new_filings(rows, rows.filter(F.col("filing_date") < _CUT), high_water=True).select(
        "cik", "accession_number", "filing_date"
    )


@query("filing_write", f"WITH {_SUBS} SELECT accession_number, cik, filing_date, CASE WHEN filing_date >= '{_CUT}' THEN size + 5 ELSE size END AS size FROM filings")
def filing_write(spark, sf):
    rows = filing_rows(spark, sf).select("accession_number", "cik", "filing_date", "size")
    again = rows.filter(F.col("filing_date") >= _CUT).withColumn("size", F.col("size") + 5)
    return fi.write_filings(rows, again)


_FACTS = f"""orders0 AS (SELECT *, CAST(o_orderdate AS DATE) AS d, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accn,
  lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, 'S' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS symbol,
  CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS cents, {src.tag_case()} AS metric FROM orders),
points AS (SELECT o.*, unit, cents || suffix AS value FROM orders0 o,
  (VALUES ('USD', ''), ('USD', '0'), ('shares', '000000000000000000')) u(unit, suffix))"""
_METRIC = """cik, symbol, metric, value, unit, '10-K' AS form, CAST(d + 45 AS VARCHAR) AS filed_date, CAST(d AS VARCHAR) AS period_end,
  CAST(NULL AS VARCHAR) AS period_start, accn, year(d) AS fiscal_year, 'FY' AS fiscal_period"""


def parsed_facts(spark, sf):
    return fi.facts(src.fact_documents(spark, sf))


@query("key_metrics", f"WITH {_FACTS} SELECT {_METRIC} FROM points WHERE metric <> 'NetIncomeLoss'")
def key_metrics(spark, sf):
    return tidy(fi.key_metrics(parsed_facts(spark, sf)))


@query(
    "metric_insert",
    f"""WITH {_FACTS}, p AS (SELECT {_METRIC}, row_number() OVER (PARTITION BY cik, metric, CAST(d AS VARCHAR), value ORDER BY accn, unit) AS rn FROM points WHERE metric <> 'NetIncomeLoss')
    SELECT cik, symbol, metric, period_end, value, accn, unit FROM p WHERE rn = 1 AND period_end >= '{_CUT}'""",
)
def metric_insert(spark, sf):
    rows = fi.key_metrics(parsed_facts(spark, sf)).select(*fi.METRIC_KEY, "accn", "unit")
    return fi.insert_metrics(rows.filter(F.col("period_end") < _CUT), rows)


@query("fact_tag_counts", f"WITH {_FACTS} SELECT metric AS tag, count(*) AS n FROM orders0 GROUP BY metric ORDER BY n DESC, tag LIMIT 40")
def fact_tag_counts(spark, sf):
    return fi.tag_counts(parsed_facts(spark, sf), top=40)


@query(
    "fact_document_shape",
    f"WITH {_FACTS} SELECT metric, unit, count(*) AS points, CAST(min(d) AS VARCHAR) AS first_end, CAST(max(d) AS VARCHAR) AS last_end FROM points GROUP BY metric, unit",
)
def fact_document_shape(spark, sf):
    return fi.document_shape(parsed_facts(spark, sf))


@query(
    "big_integers",
    f"""WITH {_FACTS} SELECT accn, unit, value, TRY_CAST(value AS BIGINT) AS as_long, CAST(TRY_CAST(value AS DECIMAL(38, 0)) AS VARCHAR) AS as_decimal FROM points""",
)
def big_integers(spark, sf):
    points = fi.fact_points(parsed_facts(spark, sf))
    return points.select(
        "accn", "unit", F.col("val").alias("value"), F.expr("try_cast(val AS bigint)").alias("as_long"),
        fi.as_integer("val").cast("string").alias("as_decimal"),
    )


_TICK = """ticks AS (SELECT 's' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') AS ticker, lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS cik FROM customer
  UNION ALL SELECT upper(c_mktsegment), lpad(CAST(c_custkey AS VARCHAR), 10, '0') FROM customer)"""


@query("ticker_directory", f"WITH {_TICK} SELECT ticker, cik FROM ticks")
def ticker_directory(spark, sf):
    return fi.tickers(src.ticker_documents(spark, sf))


@query(
    "resolved_ciks",
    f"""WITH {STOCKS}, {_TICK}, t AS (SELECT upper(ticker) AS k, min(cik) AS cik FROM ticks GROUP BY 1)
    SELECT symbol, company_name, cik FROM stocks LEFT JOIN t ON upper(symbol) = k""",
)
def resolved_ciks(spark, sf):
    stocks = panel.stocks(spark, sf).select("symbol", "company_name")
    return fi.resolved(stocks, fi.tickers(src.ticker_documents(spark, sf)))


@query(
    "unmatched_symbols",
    f"""WITH {_TICK}, p AS (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT DISTINCT c_mktsegment FROM customer)
    SELECT symbol FROM p WHERE upper(symbol) NOT IN (SELECT upper(ticker) FROM ticks)""",
)
def unmatched_symbols(spark, sf):
    names = panel.table(spark, sf, "part").select(F.col("p_brand").alias("symbol")).union(
        panel.table(spark, sf, "customer").select("c_mktsegment")
    )
    return fi.unmatched(names.distinct(), fi.tickers(src.ticker_documents(spark, sf)))


@query("repeated_ciks", f"WITH {_SUBS} SELECT cik, count(*) AS n FROM filings GROUP BY cik HAVING count(*) > 1")
def repeated_ciks(spark, sf):
    return dist.duplicate_keys(filing_rows(spark, sf), ["cik"])


@query(
    "request_quota",
    """SELECT CAST(user_id AS VARCHAR) AS client, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS n
    FROM events GROUP BY 1, 2 HAVING count(*) > 1""",
)
def request_quota(spark, sf):
    events = panel.table(spark, sf, "events").select(F.col("user_id").cast("string").alias("client"), "ts")
    return quota.over_quota(events, limit=1)


@query("polled_filings", """SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS accession_number,
  CAST(o_orderdate AS DATE) AS filing_date FROM orders""")
def polled_filings(spark, sf):
    """One-shot poll of a landed folder: the stream is drained, deduplicated and appended."""
    return stream.drain_orders(spark, sf)


@query(
    "filing_records",
    f"""WITH {_SUBS}, {_TICK}, t AS (SELECT cik, min(upper(ticker)) AS symbol FROM ticks GROUP BY cik)
    SELECT f.*, t.symbol, TIMESTAMP '2001-12-31 18:00:00' AS fetched_at FROM filings f LEFT JOIN t ON t.cik = f.cik""",
)
def filing_records(spark, sf):
    """Filing rows with symbol and time of fetching, as they are kept."""
    out = fi.filing_records(filing_rows(spark, sf), fi.tickers(src.ticker_documents(spark, sf)), F.lit("2001-12-31 18:00:00").cast("timestamp"))
    return tidy(out)
