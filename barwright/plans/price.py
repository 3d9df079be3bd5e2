"""Queries over returns, bands, candles, gaps and volatility."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import indicators as ind, volatility as vol
from barwright.plans.registry import query, tidy
from barwright.plans.sqltext import BARS, LAGGED, r, rolling
from barwright.sources import panel

_W = "OVER (PARTITION BY symbol ORDER BY date)"


@query(
    "simple_and_log_return",
    f"WITH {LAGGED} SELECT symbol, date, {r('sr')} AS simple_return, {r('lr')} AS log_return FROM rets",
)
def simple_and_log_return(spark, sf):
    return tidy(ind.returns(panel.bars(spark, sf)).select("symbol", "date", "simple_return", "log_return"))


@query(
    "rate_of_change",
    f"WITH {BARS} SELECT symbol, date, "
    + ", ".join(f"{r(f'close / nullif(lag(close, {n}) {_W}, 0) - 1')} AS roc_{n}d" for n in ind.ROC_WINDOWS)
    + " FROM bars",
)
def rate_of_change(spark, sf):
    out = ind.rate_of_change(panel.bars(spark, sf))
    return tidy(out.select("symbol", "date", *[f"roc_{n}d" for n in ind.ROC_WINDOWS]))


_GAP = "(open - pc) / nullif(pc, 0) * 100"


@query(
    "overnight_gap",
    f"WITH {LAGGED} SELECT symbol, date, {r('open - pc')} AS gap, {r(_GAP)} AS gap_pct FROM rets",
)
def overnight_gap(spark, sf):
    return tidy(ind.gaps(panel.bars(spark, sf)).select("symbol", "date", "gap", "gap_pct"))


VOLS = f"""{LAGGED}, vols AS (
  SELECT symbol, date, open, high, low, close, volume, pc, lr, """ + ", ".join(
    f"({rolling('stddev_samp(lr)', 'lr', n, ', lr IS NOT NULL')}) * sqrt(252) AS vol_{n}d" for n in vol.HORIZONS
) + " FROM rets)"


@query(
    "rolling_volatility",
    f"WITH {VOLS} SELECT symbol, date, " + ", ".join(f"{r(f'vol_{n}d')} AS vol_{n}d" for n in vol.HORIZONS) + " FROM vols",
)
def rolling_volatility(spark, sf):
    out = vol.rolling_volatility(panel.bars(spark, sf))
    return tidy(out.select("symbol", "date", *[f"vol_{n}d" for n in vol.HORIZONS]))


PARKINSON = f"""{BARS}, sq AS (SELECT *, CASE WHEN high > low AND low > 0 THEN ln(high / low) ** 2 END AS x FROM bars),
park AS (SELECT symbol, date, close, sqrt(({rolling('sum(x)', 'x', 21)}) / (4 * 21 * ln(2))) * sqrt(252) AS parkinson_21d FROM sq)"""


@query("parkinson_volatility", f"WITH {PARKINSON} SELECT symbol, date, {r('parkinson_21d')} AS parkinson_21d FROM park")
def parkinson_volatility(spark, sf):
    return tidy(vol.parkinson(panel.bars(spark, sf)).select("symbol", "date", "parkinson_21d"))


_TR = "greatest(high - low, abs(high - pc), abs(low - pc))"
_TRN = f"CASE WHEN pc IS NOT NULL THEN {_TR} END"


@query(
    "true_range",
    f"WITH {LAGGED} SELECT symbol, date, {r(_TR)} AS true_range, {r(_TRN)} AS true_range_strict FROM rets",
)
def true_range(spark, sf):
    out = panel.bars(spark, sf).withColumns(
        {"true_range": ind.true_range(), "true_range_strict": ind.true_range(skip_nulls=False)}
    )
    return tidy(out.select("symbol", "date", "true_range", "true_range_strict"))


_CENTRE = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
ATR = f"""{LAGGED}, tr AS (SELECT *, {_TR} AS tr FROM rets),
atr AS (SELECT *, {rolling('avg(tr)', 'tr', 14)} AS atr_14d FROM tr),
norm AS (SELECT *, atr_14d / nullif(close, 0) * 100 AS atr_normalized FROM atr),
smooth AS (SELECT *, CASE WHEN count(atr_14d) {_CENTRE} = 5 THEN avg(atr_14d) {_CENTRE} END AS atr_14d_smoothed,
  CASE WHEN count(atr_normalized) {_CENTRE} = 5 THEN avg(atr_normalized) {_CENTRE} END AS atr_normalized_smoothed FROM norm)"""
_ATR_COLS = ["atr_14d", "atr_14d_smoothed", "atr_normalized", "atr_normalized_smoothed"]


@query("average_true_range", f"WITH {ATR} SELECT symbol, date, " + ", ".join(f"{r(c, 5)} AS {c}" for c in _ATR_COLS) + " FROM smooth")
def average_true_range(spark, sf):
    return tidy(ind.average_true_range(panel.bars(spark, sf)).select("symbol", "date", *_ATR_COLS), 5)


@query(
    "atr_bands",
    f"""WITH {LAGGED}, tr AS (SELECT *, {_TRN} AS tr FROM rets),
    atr AS (SELECT *, {rolling('avg(tr)', 'tr', 14)} AS atr FROM tr)
    SELECT symbol, date, {r('close + atr', 5)} AS atr_upper, {r('close - atr', 5)} AS atr_lower FROM atr""",
)
def atr_bands(spark, sf):
    return tidy(ind.atr_bands(panel.bars(spark, sf)).select("symbol", "date", "atr_upper", "atr_lower"), 5)


@query(
    "moving_averages",
    f"WITH {BARS} SELECT symbol, date, "
    + ", ".join(f"{r(rolling('avg(close)', 'close', n), 6)} AS ma_{n}" for n in ind.MA_WINDOWS)
    + " FROM bars",
)
def moving_averages(spark, sf):
    out = ind.moving_averages(panel.bars(spark, sf))
    return tidy(out.select("symbol", "date", *[f"ma_{n}" for n in ind.MA_WINDOWS]))


def _bollinger_sql(fn):
    return f"""WITH {BARS}, b AS (SELECT symbol, date, {rolling('avg(close)', 'close', 20)} AS m,
      {rolling(f'{fn}(close)', 'close', 20)} AS s FROM bars)
    SELECT symbol, date, {r('m', 5)} AS bb_mid, {r('m + 2 * s', 5)} AS bb_high, {r('m - 2 * s', 5)} AS bb_low FROM b"""


@query("bollinger_sample", _bollinger_sql("stddev_samp"))
def bollinger_sample(spark, sf):
    return tidy(ind.bollinger(panel.bars(spark, sf)).select("symbol", "date", "bb_mid", "bb_high", "bb_low"), 5)


@query("bollinger_population", _bollinger_sql("stddev_pop"))
def bollinger_population(spark, sf):
    out = ind.bollinger(panel.bars(spark, sf), ddof=0)
    return tidy(out.select("symbol", "date", "bb_mid", "bb_high", "bb_low"), 5)


_DERIVED = {
    "volume_change": "v / lag(v) OVER w - 1",
    "volume_normalized": "v / avg(v) OVER (PARTITION BY symbol ORDER BY date ROWS 20 PRECEDING)",
    "dollar_volume": "close * volume",
    "body_size_norm": "abs(open - close) / close",
    "upper_shadow_norm": "(high - greatest(open, close)) / close",
    "lower_shadow_norm": "(least(open, close) - low) / close",
    "close_position": "coalesce((close - low) / nullif(high - low, 0), 0.5)",
    "log_return": "lr",
    "abs_return": "abs(sr)",
    "sq_return": "sr * sr",
    "range_return_open": "(high - low) / open",
    "price_range_norm": "(high - low) / close",
    "true_range": _TRN,
    "vol_garman_klass": "greatest(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2, 0)",
    "vol_rogers_satchell": "greatest(ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open), 0)",
}
# Ratios of two-decimal prices end early, so they are compared at nine digits.
_DIGITS = {"dollar_volume": 2}
# One subtraction and one product: the same double in any engine.
_EXACT = ("sq_return",)
_DERIVED_SQL = f"WITH {LAGGED}, d AS (SELECT *, nullif(volume, 0) AS v FROM rets) SELECT symbol, date, "


def _derived(*names):
    cols = ", ".join(f"{_DERIVED[n] if n in _EXACT else r(_DERIVED[n], _DIGITS.get(n, 9))} AS {n}" for n in names)
    return f"{_DERIVED_SQL}{cols} FROM d WINDOW w AS (PARTITION BY symbol ORDER BY date)"


@query("derived_metrics", _derived(*_DERIVED))
def derived_metrics(spark, sf):
    return tidy(ind.derived_metrics(panel.bars(spark, sf)), 9, exact=_EXACT, **_DIGITS)


_VOLUME = ["volume_change", "volume_normalized", "dollar_volume"]


@query("volume_metrics", _derived(*_VOLUME))
def volume_metrics(spark, sf):
    return tidy(ind.volume_metrics(panel.bars(spark, sf)).select("symbol", "date", *_VOLUME), 9, dollar_volume=2)


_CANDLE = ["body_size_norm", "upper_shadow_norm", "lower_shadow_norm", "close_position"]


@query("candle_metrics", _derived(*_CANDLE))
def candle_metrics(spark, sf):
    return tidy(ind.candle_metrics(panel.bars(spark, sf)).select("symbol", "date", *_CANDLE), 9)


_RETURN = ["log_return", "abs_return", "sq_return", "range_return_open"]


@query("return_metrics", _derived(*_RETURN))
def return_metrics(spark, sf):
    return tidy(ind.return_metrics(panel.bars(spark, sf)).select("symbol", "date", *_RETURN), 9, exact=_EXACT)


_RANGE = ["price_range_norm", "true_range", "vol_garman_klass", "vol_rogers_satchell"]


@query("range_volatility", _derived(*_RANGE))
def range_volatility(spark, sf):
    return tidy(ind.range_volatility(panel.bars(spark, sf)).select("symbol", "date", *_RANGE), 9)


@query(
    "close_position_clipped",
    f"WITH {BARS} SELECT symbol, date, {r('least(greatest((close - low) / (high - low + 1e-10), 0), 1)')} AS close_position FROM bars",
)
def close_position_clipped(spark, sf):
    return tidy(panel.bars(spark, sf).select("symbol", "date", ind.close_position_clipped().alias("close_position")))


def gap_case(gap):
    a, b, c, d, e = ind.GAP_CLASSES
    return (
        f"CASE WHEN {gap} <= -1 THEN '{a}' WHEN {gap} < 0 THEN '{b}' WHEN {gap} IS NULL OR {gap} = 0 THEN '{c}'"
        f" WHEN {gap} <= 1 THEN '{d}' ELSE '{e}' END"
    )


GAPS = f"{LAGGED}, gaps AS (SELECT *, {_GAP} AS gap_pct FROM rets)"


@query(
    "gap_follow_through",
    f"""WITH {GAPS} SELECT symbol, date, {r('gap_pct')} AS gap_pct,
      CASE WHEN pc IS NOT NULL THEN CASE WHEN gap_pct > 0 THEN low <= pc ELSE high >= pc END END AS gap_filled,
      {r('(close - open) / open * 100')} AS intraday_move,
      {r('sqrt(volume / max(volume) OVER (PARTITION BY symbol)) * 50')} AS marker_size,
      {gap_case('gap_pct')} AS gap_class FROM gaps""",
)
def gap_follow_through(spark, sf):
    out = ind.gap_events(panel.bars(spark, sf))
    return tidy(out.select("symbol", "date", "gap_pct", "gap_filled", "intraday_move", "marker_size", "gap_class"))


@query(
    "trendlines",
    f"""WITH {BARS}, x AS (SELECT *, row_number() {_W} - 1 AS x, ln(close + 1e-10) AS ly FROM bars),
    f AS (SELECT symbol, regr_slope(close, x) AS s1, regr_intercept(close, x) AS i1,
                 regr_slope(ly, x) AS s2, regr_intercept(ly, x) AS i2 FROM x GROUP BY symbol HAVING count(*) >= 2)
    SELECT x.symbol, date, {r('i1 + s1 * x', 5)} AS linear_trend, {r('exp(i2 + s2 * x)', 5)} AS exp_trend
    FROM x LEFT JOIN f ON x.symbol = f.symbol""",
)
def trendlines(spark, sf):
    return tidy(ind.trendlines(panel.bars(spark, sf)).select("symbol", "date", "linear_trend", "exp_trend"), 5)


@query("log_volume", f"WITH {BARS} SELECT symbol, date, {r('ln(1 + volume)')} AS log_volume FROM bars")
def log_volume(spark, sf):
    return tidy(panel.bars(spark, sf).select("symbol", "date", F.log1p("volume").alias("log_volume")))


@query(
    "intraday_change",
    f"""WITH {BARS}, c AS (SELECT *, (close - open) / nullif(open, 0) * 100 AS x FROM bars)
    SELECT symbol, date, {r('x')} AS change_pct, CAST(CAST(round(x, 2) AS DECIMAL(20, 2)) AS VARCHAR) || '%' AS change_text,
    close > open AS is_up FROM c""",
)
def intraday_change(spark, sf):
    out = ind.intraday_change(panel.bars(spark, sf))
    return tidy(out.select("symbol", "date", "change_pct", "change_text", "is_up"))


@query("elapsed_days", f"WITH {BARS} SELECT symbol, date, date - min(date) OVER (PARTITION BY symbol) AS elapsed FROM bars")
def elapsed_days(spark, sf):
    return tidy(panel.bars(spark, sf).select("symbol", "date", ind.elapsed_days().alias("elapsed")))


REGIMES = f"""{VOLS}, edges AS (
  SELECT symbol, count(vol_21d) AS n, list_sort(list_distinct([quantile_cont(vol_21d, 0.0), quantile_cont(vol_21d, 0.25),
    quantile_cont(vol_21d, 0.75), quantile_cont(vol_21d, 0.95), quantile_cont(vol_21d, 1.0)])) AS e
  FROM vols GROUP BY symbol),
cut AS (SELECT v.symbol, v.date, v.vol_21d, e.n, len(e.e) AS ne, CASE WHEN vol_21d IS NOT NULL THEN
    ['Low', 'Normal', 'High', 'Extreme'][greatest(len(list_filter(e.e, lambda x: x < vol_21d)), 1)] END AS c
  FROM vols v JOIN edges e ON v.symbol = e.symbol),
regimes AS (SELECT symbol, date, vol_21d, CASE WHEN n <= 5 THEN 'Unknown' WHEN ne < 2 THEN 'Normal' ELSE
    coalesce(first_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING),
             last_value(c IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) END AS vol_regime
  FROM cut)"""


@query("volatility_regime", f"WITH {REGIMES} SELECT symbol, date, {r('vol_21d')} AS vol_21d, vol_regime FROM regimes")
def volatility_regime(spark, sf):
    out = vol.regimes(vol.rolling_volatility(panel.bars(spark, sf), [21]))
    return tidy(out.select("symbol", "date", "vol_21d", "vol_regime"))


@query(
    "regime_summary",
    f"""WITH {REGIMES} SELECT symbol, vol_regime, count(*) AS days, {r('avg(vol_21d)')} AS mean_vol,
    min(date) AS first_date, max(date) AS last_date FROM regimes GROUP BY symbol, vol_regime""",
)
def regime_summary(spark, sf):
    """Days and mean volatility of each regime of each symbol."""
    out = vol.regimes(vol.rolling_volatility(panel.bars(spark, sf), [21]))
    return tidy(
        out.groupBy("symbol", "vol_regime").agg(
            F.count("*").alias("days"),
            F.avg("vol_21d").alias("mean_vol"),
            F.min("date").alias("first_date"),
            F.max("date").alias("last_date"),
        )
    )


TERM = f"{VOLS}, term AS (" + " UNION ALL ".join(
    f"SELECT symbol, date, CAST({n} AS BIGINT) AS horizon, vol_{n}d AS vol FROM vols WHERE vol_{n}d IS NOT NULL"
    for n in vol.HORIZONS
) + ")"


@query("volatility_term_structure", f"WITH {TERM} SELECT symbol, date, horizon, {r('vol')} AS vol FROM term")
def volatility_term_structure(spark, sf):
    return tidy(vol.term_structure(vol.rolling_volatility(panel.bars(spark, sf))))


@query(
    "volatility_cone",
    f"""WITH {TERM} SELECT symbol, horizon, {r('min(vol)')} AS min, {r('quantile_cont(vol, 0.25)')} AS q25,
    {r('quantile_cont(vol, 0.5)')} AS median, {r('quantile_cont(vol, 0.75)')} AS q75, {r('max(vol)')} AS max,
    {r('arg_max(vol, date)')} AS current FROM term GROUP BY symbol, horizon""",
)
def volatility_cone(spark, sf):
    return tidy(vol.cone(vol.rolling_volatility(panel.bars(spark, sf))))
