"""SQL fragments shared by the oracle statements (DuckDB dialect)."""

from __future__ import annotations

from barwright.schema import TENORS
from barwright.sources.panel import TENOR_RULES

_LINES = """lines AS (
  SELECT l_suppkey, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS date,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
         CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
  FROM lineitem)"""

_SUMS = """sum(c) AS c, sum(c * (100 - d) * (100 + t) // 10000) AS charge, sum(q) AS q,
         max(c * (100 + t) // (10000 * q)) AS hi, min(c * (100 - d) // (10000 * q)) AS lo"""

_SHAPE = """CAST(CAST(c // (100 * q) AS BIGINT) AS DOUBLE) / 100 AS open, CAST(hi AS DOUBLE) / 100 AS high,
         CAST(lo AS DOUBLE) / 100 AS low, CAST(CAST(charge // (100 * q) AS BIGINT) AS DOUBLE) / 100 AS close,
         CAST(q AS BIGINT) AS volume"""

_SYMBOL = "'S' || lpad(CAST(l_suppkey AS VARCHAR), 12, '0')"

BARS = f"""{_LINES},
bars AS (
  SELECT {_SYMBOL} AS symbol, date, {_SHAPE}
  FROM (SELECT l_suppkey, date, {_SUMS} FROM lines GROUP BY l_suppkey, date))"""

_INDEX = f"""parts AS (
  SELECT l_returnflag || l_linestatus AS part, date, {_SUMS} FROM lines GROUP BY ALL),
index_bars AS (
  SELECT symbol, date, {_SHAPE} FROM (
    SELECT CASE part WHEN 'AF' THEN 'NDX' WHEN 'AO' THEN 'DJI' WHEN 'NF' THEN 'RUT'
                     WHEN 'NO' THEN 'VIX' WHEN 'RF' THEN 'SOX' WHEN 'RO' THEN 'OSX' END AS symbol,
           date, c, charge, q, hi, lo FROM parts
    UNION ALL
    SELECT 'SPX', date, sum(c), sum(charge), sum(q), max(hi), min(lo) FROM parts GROUP BY date)
  WHERE symbol IS NOT NULL)"""

INDEX_BARS = f"{_LINES},\n{_INDEX}"
BARS_AND_INDEX = f"{BARS},\n{_INDEX}"

YIELDS = (
    "yields AS (SELECT date, "
    + ", ".join(
        f"CAST(CAST(sum(c) FILTER ({TENOR_RULES[t]}) // nullif(1000 * count(*) FILTER ({TENOR_RULES[t]}), 0)"
        f" AS BIGINT) AS DOUBLE) / 10000 AS {t}"
        for t in TENORS
    )
    + " FROM (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority, o_orderstatus,"
    " CAST(round(o_totalprice * 100) AS BIGINT) AS c FROM orders) GROUP BY date)"
)

STOCKS = """stocks AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS symbol, s_name AS company_name,
         CASE WHEN s_acctbal >= 1000 THEN 'EQUITY' ELSE 'ETF' END AS quotetype,
         CASE WHEN s_acctbal >= 0 THEN '  ' || lower(r_name) || ' ' END AS sector,
         CASE WHEN s_acctbal < 9000 THEN lower(n_name) || '-goods' END AS industry,
         CAST(DATE '1999-01-01' + CAST(floor(s_acctbal / 10) AS INTEGER) AS TIMESTAMP) AS last_updated,
         s_acctbal < 8500 AS is_active
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey)"""

LISTINGS = """listings AS (
  SELECT (CASE WHEN c_acctbal < 0 THEN lower(c_mktsegment) ELSE c_mktsegment END)
         || (CASE WHEN c_acctbal > 9000 THEN ' ' ELSE '-' END) || CAST(c_nationkey AS VARCHAR) AS symbol,
         c_custkey AS row_id, c_name AS company_name, c_acctbal < 8000 AS is_active
  FROM customer)"""

SPLITS = """splits AS (
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0') AS symbol,
         DATE '1996-01-01' + CAST(floor(abs(s_acctbal)) AS INTEGER) % 700 AS split_date,
         CAST(2 + s_nationkey % 3 AS DOUBLE) AS ratio FROM supplier
  UNION ALL
  SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 12, '0'),
         DATE '1999-01-01' + CAST(floor(abs(s_acctbal)) AS INTEGER) % 500,
         CASE WHEN s_acctbal < 500 THEN CAST(0 AS DOUBLE) ELSE CAST(1.5 AS DOUBLE) END FROM supplier)"""

FEED = f"""feed AS (
  SELECT symbol, date, l_orderkey, l_linenumber, l_partkey, c, open,
         CASE WHEN d = 10 THEN down ELSE up END AS high, CASE WHEN d = 10 THEN up ELSE down END AS low,
         CASE WHEN t = 8 THEN 'N/A' WHEN d = 9 THEN '0' ELSE CAST(CAST(charged AS DECIMAL(18,2)) AS VARCHAR) END AS close_text,
         CASE WHEN t = 7 THEN NULL WHEN t = 6 THEN 0 ELSE q END AS volume
  FROM (SELECT {_SYMBOL} AS symbol, CAST(l_shipdate AS DATE) AS date, l_orderkey, l_linenumber, l_partkey,
               c, q, d, t, CAST(c // (100 * q) AS DOUBLE) / 100 AS open,
               CAST(c * (100 + t) // (10000 * q) AS DOUBLE) / 100 AS up,
               CAST(c * (100 - d) // (10000 * q) AS DOUBLE) / 100 AS down,
               CAST(c * (100 - d) * (100 + t) // (1000000 * q) AS DOUBLE) / 100 AS charged
        FROM (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(l_quantity AS BIGINT) AS q,
                     CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS t
              FROM lineitem)))"""

# One lagged row per bar, shared by most return measures.
LAGGED = f"""{BARS},
lagged AS (
  SELECT *, lag(close) OVER w AS pc, row_number() OVER w AS rn FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY date)),
rets AS (
  SELECT *, CASE WHEN close > 0 AND pc > 0 THEN ln(close / pc) END AS lr, close / nullif(pc, 0) - 1 AS sr FROM lagged)"""


def r(expr: str, digits: int = 6) -> str:
    """Rounded double that never shows a negative zero."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + CAST(0 AS DOUBLE))"


def sig(expr: str) -> str:
    """Nine significant digits, whatever the size."""
    return f"CAST(printf('%.8e', CAST({expr} AS DOUBLE)) AS DOUBLE)"


def rolling(fn: str, value: str, n: int, extra: str = "") -> str:
    """Full-window rolling aggregate: NULL until ``n`` non-null values are in the frame."""
    frame = f"OVER (PARTITION BY symbol{extra} ORDER BY date ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({value}) {frame} = {n} THEN {fn} {frame} END"
