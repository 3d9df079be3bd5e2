"""Queries over distributions, correlations and calendar quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.functions.series import simple_return
from barwright.operators import correlation as cor, distribution as dist, indicators as ind
from barwright.plans.price import GAPS, gap_case
from barwright.plans.registry import query, tidy
from barwright.plans.sqltext import BARS, BARS_AND_INDEX, INDEX_BARS, LAGGED, YIELDS, r
from barwright.schema import INDEX_SYMBOLS, TENORS
from barwright.sources import panel, readers

_BOX = f"""count(*) AS n, {r('avg(value)')} AS mean, {r('min(value)')} AS min, {r('quantile_cont(value, 0.25)')} AS q25,
  {r('quantile_cont(value, 0.5)')} AS median, {r('quantile_cont(value, 0.75)')} AS q75, {r('max(value)')} AS max"""

_MEASURES = {
    "volume": "CAST(volume AS DOUBLE)",
    "range": "high - low",
    "gap": "open - pc",
    "close_position": "least(greatest((close - low) / (high - low + 1e-10), 0), 1)",
    "close": "close",
}


@query(
    "monthly_distribution",
    f"WITH {LAGGED}, long AS ("
    + " UNION ALL ".join(f"SELECT symbol, strftime(date, '%Y-%m') AS year_month, '{k}' AS measure, {v} AS value FROM rets" for k, v in _MEASURES.items())
    + f""") SELECT symbol, measure, year_month, {_BOX}, strftime(strptime(year_month || '-01', '%Y-%m-%d'), '%b %Y') AS month_label
    FROM long WHERE value IS NOT NULL GROUP BY symbol, measure, year_month""",
)
def monthly_distribution(spark, sf):
    bars = ind.gaps(panel.bars(spark, sf))
    return tidy(
        dist.monthly_box_stats(
            bars,
            {
                "volume": F.col("volume").cast("double"),
                "range": F.col("high") - F.col("low"),
                "gap": F.col("gap"),
                "close_position": ind.close_position_clipped(),
                "close": F.col("close"),
            },
        )
    )


@query("year_month_key", f"WITH {BARS} SELECT symbol, date, strftime(date, '%Y-%m') AS year_month FROM bars")
def year_month_key(spark, sf):
    return panel.bars(spark, sf).select("symbol", "date", dist.year_month().alias("year_month"))


@query(
    "up_down_volume",
    f"""WITH {LAGGED}, long AS (SELECT symbol, CASE WHEN sr > 0 THEN 'Up Days' WHEN sr <= 0 THEN 'Down Days' END AS category,
      CAST(volume AS DOUBLE) AS value FROM rets) SELECT symbol, category, {_BOX} FROM long WHERE category IS NOT NULL GROUP BY symbol, category""",
)
def up_down_volume(spark, sf):
    return tidy(dist.up_down_volume(panel.bars(spark, sf)))


@query(
    "gap_class_volume",
    f"""WITH {GAPS}, long AS (SELECT symbol, {gap_case('gap_pct')} AS gap_class, CAST(volume AS DOUBLE) AS value FROM gaps)
    SELECT symbol, gap_class, {_BOX}, list_position([{', '.join(f"'{c}'" for c in ind.GAP_CLASSES)}], gap_class) AS class_rank
    FROM long GROUP BY symbol, gap_class""",
)
def gap_class_volume(spark, sf):
    return tidy(dist.gap_class_volume(panel.bars(spark, sf)))


@query(
    "returns_histogram",
    f"""WITH {LAGGED}, v AS (SELECT symbol, sr AS v, min(sr) OVER (PARTITION BY symbol) AS lo, max(sr) OVER (PARTITION BY symbol) AS hi
      FROM rets WHERE sr IS NOT NULL)
    SELECT symbol, bin, {r('lo + bin * (hi - lo) / 50')} AS bin_start, count(*) AS n FROM (
      SELECT symbol, lo, hi, CAST(least(floor((v - lo) / ((hi - lo) / 50)), 49) AS BIGINT) AS bin FROM v) GROUP BY symbol, bin, lo, hi""",
)
def returns_histogram(spark, sf):
    df = panel.bars(spark, sf).select("symbol", "date", simple_return().alias("ret"))
    return tidy(dist.histogram(df, "ret"))


@query(
    "volume_weighted_gaps",
    f"""WITH {GAPS}, g AS (SELECT symbol, gap_pct, volume, min(gap_pct) OVER (PARTITION BY symbol) AS lo, max(gap_pct) OVER (PARTITION BY symbol) AS hi
      FROM gaps WHERE gap_pct IS NOT NULL),
    b AS (SELECT *, CAST(least(floor((gap_pct - lo) / ((hi - lo) / 30)), 29) AS BIGINT) AS bin FROM g),
    s AS (SELECT symbol, bin, count(*) AS n, avg(volume) FILTER (gap_pct < hi) AS v FROM b GROUP BY symbol, bin),
    grid AS (SELECT symbol, min(lo) AS lo, min(hi) AS hi, CAST(unnest(range(30)) AS BIGINT) AS bin FROM g GROUP BY symbol),
    f AS (SELECT grid.*, coalesce(n, 0) AS n, coalesce(v, 0) AS mv FROM grid LEFT JOIN s ON s.symbol = grid.symbol AND s.bin = grid.bin)
    SELECT symbol, bin, {r('lo + (bin + 0.5::DOUBLE) * (hi - lo) / 30')} AS bin_center, n, {r('mv')} AS mean_volume,
      {r('mv / nullif(max(mv) OVER (PARTITION BY symbol), 0) * 0.8')} AS width FROM f""",
)
def volume_weighted_gaps(spark, sf):
    return tidy(dist.volume_weighted_gaps(panel.bars(spark, sf)))


def _grid_sql(edges):
    bins = edges - 1
    return f"""WITH {GAPS}, q AS (SELECT symbol, quantile_cont(gap_pct, 0.01) AS g0, quantile_cont(gap_pct, 0.99) AS g1,
      quantile_cont(CAST(volume AS DOUBLE), 0.01) AS v0, quantile_cont(CAST(volume AS DOUBLE), 0.99) AS v1 FROM gaps GROUP BY symbol)
    SELECT g.symbol, CAST(least(floor((gap_pct - g0) / ((g1 - g0) / {bins})), {bins - 1}) AS BIGINT) AS gap_bin,
      CAST(least(floor((volume - v0) / ((v1 - v0) / {bins})), {bins - 1}) AS BIGINT) AS volume_bin, count(*) AS n
    FROM gaps g JOIN q ON g.symbol = q.symbol WHERE gap_pct BETWEEN g0 AND g1 AND volume BETWEEN v0 AND v1 GROUP BY ALL"""


@query("gap_volume_heatmap", _grid_sql(10))
def gap_volume_heatmap(spark, sf):
    return tidy(dist.gap_volume_grid(panel.bars(spark, sf), 10))


@query("gap_volume_surface", _grid_sql(20))
def gap_volume_surface(spark, sf):
    return tidy(dist.gap_volume_grid(panel.bars(spark, sf), 20))


_LONG3 = f"""{LAGGED}, long AS (SELECT symbol, 'close' AS measure, close AS value FROM rets UNION ALL
  SELECT symbol, 'volume', CAST(volume AS DOUBLE) FROM rets UNION ALL SELECT symbol, 'returns', sr FROM rets)"""


@query(
    "describe",
    f"""WITH {_LONG3} SELECT symbol, measure, {_BOX.replace(", 6) +", ", 5) +")}, {r('stddev_samp(value)', 5)} AS std
    FROM long WHERE value IS NOT NULL GROUP BY symbol, measure""",
)
def describe(spark, sf):
    return tidy(dist.describe(panel.bars(spark, sf)), 5)


@query(
    "load_summary",
    f"WITH {BARS_AND_INDEX}, {YIELDS}, long AS ("
    + " UNION ALL ".join(
        f"SELECT '{loader}' AS loader, '{c}' AS \"column\", date, CAST({c} AS DOUBLE) AS value FROM {t}"
        for loader, t, cols in (("stock", "bars", ["close", "volume"]), ("index", "index_bars", ["close", "volume"]), ("treasury", "yields", TENORS))
        for c in cols
    )
    + f""") SELECT loader, "column", {r('min(value)', 4)} AS min, {r('max(value)', 4)} AS max, {r('avg(value)', 4)} AS mean, count(value) AS n,
    min(date) AS first_date, max(date) AS last_date FROM long GROUP BY loader, "column" """,
)
def load_summary(spark, sf):
    tables = {
        "stock": (panel.bars(spark, sf), ["close", "volume"]),
        "index": (panel.index_bars(spark, sf), ["close", "volume"]),
        "treasury": (panel.yields(spark, sf), TENORS),
    }
    return tidy(dist.load_summary(tables), 4)


@query(
    "returns_ecdf",
    f"""WITH {LAGGED} SELECT symbol, date, {r('sr')} AS ret, {r('row_number() OVER (PARTITION BY symbol ORDER BY sr, date) / count(*) OVER (PARTITION BY symbol)')} AS ecdf
    FROM rets WHERE sr IS NOT NULL""",
)
def returns_ecdf(spark, sf):
    df = panel.bars(spark, sf).select("symbol", "date", simple_return().alias("ret"))
    return tidy(dist.ecdf(df, "ret"))


@query("latest_dates", f"WITH {BARS} SELECT symbol, max(date) AS latest_date FROM bars GROUP BY symbol")
def latest_dates(spark, sf):
    return dist.latest_dates(panel.bars(spark, sf))


@query(
    "index_loaded_until",
    f"WITH {INDEX_BARS} SELECT min(d) AS latest_date FROM (SELECT max(date) AS d FROM index_bars GROUP BY symbol)",
)
def index_loaded_until(spark, sf):
    return dist.oldest_latest(panel.index_bars(spark, sf))


_ASSETS = INDEX_SYMBOLS + ["US10Y"]
JOINT = (
    f"{BARS_AND_INDEX}, {YIELDS}, mlong AS (SELECT symbol AS asset, date, close AS value FROM index_bars"
    " UNION ALL SELECT 'US10Y', date, yr10 FROM yields), market AS (SELECT date, "
    + ", ".join(f"max(value) FILTER (asset = '{a}') AS {a}" for a in _ASSETS)
    + " FROM mlong GROUP BY date), joint AS (SELECT b.symbol, b.date, b.close AS STOCK, "
    + ", ".join(_ASSETS)
    + " FROM bars b JOIN market m ON b.date = m.date WHERE "
    + " AND ".join(f"{a} IS NOT NULL" for a in _ASSETS)
    + "), jr0 AS (SELECT symbol, date, "
    + ", ".join(
        f"CASE WHEN {a} > 0 AND lag({a}) OVER w > 0 THEN ln({a} / lag({a}) OVER w) END AS {a}" for a in ["STOCK"] + _ASSETS
    )
    + " FROM joint WINDOW w AS (PARTITION BY symbol ORDER BY date)), jr AS (SELECT * FROM jr0 WHERE "
    + " AND ".join(f"{a} IS NOT NULL" for a in ["STOCK"] + _ASSETS)
    + ")"
)


def joint_panel(spark, sf):
    market = readers.market_wide(panel.index_bars(spark, sf), panel.yields(spark, sf))
    return cor.combined(panel.bars(spark, sf), market)


@query("combined_panel", f"WITH {JOINT} SELECT * FROM joint")
def combined_panel(spark, sf):
    return joint_panel(spark, sf)


@query(
    "joint_log_returns",
    f"WITH {JOINT} SELECT symbol, date, " + ", ".join(f"{r(a)} AS {a}" for a in ["STOCK"] + _ASSETS) + " FROM jr",
)
def joint_log_returns(spark, sf):
    return tidy(cor.joint_returns(joint_panel(spark, sf)))


@query(
    "correlation_matrix",
    f"WITH {JOINT}, m AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, count(*) AS n, '{a}' AS asset_x, '{b}' AS asset_y, corr({a}, {b}) AS c FROM jr GROUP BY symbol"
        for a in ["STOCK"] + _ASSETS
        for b in ["STOCK"] + _ASSETS
    )
    + f") SELECT symbol, n, asset_x, asset_y, {r('c')} AS correlation, CAST(CAST(round(c, 2) AS DECIMAL(4, 2)) AS VARCHAR) AS label FROM m",
)
def correlation_matrix(spark, sf):
    return tidy(cor.correlation_matrix(cor.joint_returns(joint_panel(spark, sf))))


@query(
    "rolling_correlations",
    f"WITH {JOINT}, rc AS ("
    + " UNION ALL ".join(
        f"SELECT symbol, date, '{a}' AS asset, CASE WHEN count(*) OVER w = 63 THEN corr(STOCK, {a}) OVER w END AS c FROM jr"
        " WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING)"
        for a in _ASSETS
    )
    + f") SELECT symbol, date, asset, {r('c')} AS correlation FROM rc WHERE c IS NOT NULL",
)
def rolling_correlations(spark, sf):
    return tidy(cor.rolling_correlations(cor.joint_returns(joint_panel(spark, sf))))
