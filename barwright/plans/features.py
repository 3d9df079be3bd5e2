"""Queries over feature sets, registries and back-test measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.functions.series import simple_return
from barwright.operators import features as fe, registry as reg, upsert as up
from barwright.plans.registry import query, tidy
from barwright.plans.sqltext import BARS, BARS_AND_INDEX, LAGGED, STOCKS, YIELDS, r, sig
from barwright.sources import panel

_W = "OVER (PARTITION BY symbol ORDER BY date)"


@query(
    "formula_features",
    f"WITH {BARS} SELECT symbol, date, {r('(high + low + close) / 3')} AS typical_price, {r('(close - open) / nullif(high - low, 0)')} AS body_share FROM bars",
)
def formula_features(spark, sf):
    out = fe.add_formulas(
        panel.bars(spark, sf),
        {"typical_price": "(high + low + close) / 3", "body_share": "try_divide(close - open, high - low)"},
    )
    return tidy(out.select("symbol", "date", "typical_price", "body_share"))


@query(
    "market_columns",
    f"""WITH {LAGGED} SELECT symbol, date, {r('sr', 9)} AS daily_return, {r('lr', 9)} AS log_return, {r('exp(sum(lr) ' + _W + ') - 1', 9)} AS cumulative_return,
    {r('close - open', 9)} AS open_close, {r('high - low', 9)} AS high_low, {r('close / pc', 9)} AS close_prev_close FROM rets""",
)
def market_columns(spark, sf):
    out = fe.basic_market_columns(panel.bars(spark, sf))
    cols = ["daily_return", "log_return", "cumulative_return", "open_close", "high_low", "close_prev_close"]
    return tidy(out.select("symbol", "date", *cols), 9)


_FSET = f"""{LAGGED}, ff AS (SELECT symbol, date, (close - open) / open AS body, (high - low) / close AS spread, CAST(volume AS DOUBLE) AS volume,
  lead(close) {_W} / close - 1 AS target FROM rets)"""
_FEATS = ["body", "spread", "volume"]


def feature_frame(spark, sf):
    b = panel.bars(spark, sf)
    from barwright.functions.series import by_date

    return b.select(
        "symbol", "date", F.try_divide(F.col("close") - F.col("open"), F.col("open")).alias("body"),
        F.try_divide(F.col("high") - F.col("low"), F.col("close")).alias("spread"), F.col("volume").cast("double").alias("volume"),
        (F.lead("close").over(by_date()) / F.col("close") - 1).alias("target"),
    )


@query(
    "feature_correlations",
    f"WITH {_FSET} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, {r(f'corr({f}, target)')} AS correlation FROM ff" for f in _FEATS),
)
def feature_correlations(spark, sf):
    return tidy(fe.feature_correlations(feature_frame(spark, sf), _FEATS, "target"))


_CUTS = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"


@query(
    "feature_information",
    f"WITH {_FSET}, ok AS (SELECT * FROM ff WHERE target IS NOT NULL), e AS (SELECT "
    + ", ".join(f"quantile_cont({c}, {_CUTS}) AS e_{c}" for c in [*_FEATS, "target"])
    + " FROM ok), b AS (SELECT "
    + ", ".join(f"len(list_filter(e_{c}, lambda v: v < {c})) AS {c}" for c in [*_FEATS, "target"])
    + " FROM ok, e), j AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x, target AS y, count(*) AS n FROM b GROUP BY {f}, target" for f in _FEATS)
    + f"""), p AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, x) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny FROM j)
    SELECT feature, {r('sum(n / t * ln(CAST(n AS DOUBLE) * t / (nx * ny)))')} AS information FROM p GROUP BY feature""",
)
def feature_information(spark, sf):
    return tidy(fe.binned_information(feature_frame(spark, sf), _FEATS, "target"))


_CORRS = ", ".join(f"abs(corr({f}, target)) AS {f}" for f in _FEATS)


@query(
    "feature_set_comparison",
    f"""WITH {_FSET}, c AS (SELECT {_CORRS} FROM ff)
    SELECT 'candle' AS feature_set, CAST(2 AS BIGINT) AS features, {r('greatest(body, spread)')} AS best, {r('(body + spread) / 2')} AS mean FROM c
    UNION ALL SELECT 'volume', 1, {r('volume')}, {r('volume')} FROM c""",
)
def feature_set_comparison(spark, sf):
    return tidy(fe.compare_sets(feature_frame(spark, sf), {"candle": ["body", "spread"], "volume": ["volume"]}, "target"))


@query(
    "feature_set_columns",
    f"WITH {BARS} SELECT symbol, date, {r('abs(open - close) / close', 9)} AS body_size_norm, {r(f'close / lag(close, 5) {_W} - 1')} AS roc_5d FROM bars",
)
def feature_set_columns(spark, sf):
    out = fe.feature_set(panel.bars(spark, sf), "price_action", "momentum")
    return tidy(out.select("symbol", "date", "body_size_norm", "roc_5d"), body_size_norm=9)


@query(
    "sector_strength",
    f"""WITH {LAGGED}, {STOCKS}, x AS (SELECT r.symbol, date, sector, sr FROM rets r JOIN stocks s ON s.symbol = r.symbol WHERE sr IS NOT NULL AND sector IS NOT NULL)
    SELECT symbol, date, {r('sr - avg(sr) OVER (PARTITION BY sector, date)')} AS strength FROM x""",
)
def sector_strength(spark, sf):
    return tidy(fe.sector_strength(panel.bars(spark, sf), panel.stocks(spark, sf)))


@query(
    "yield_curve_slopes",
    f"WITH {YIELDS} SELECT date, {r('yr10 - yr2')} AS slope_10y_2y, {r('yr10 - mo3')} AS slope_10y_3m, {r('yr30 - yr5')} AS slope_30y_5y FROM yields",
)
def yield_curve_slopes(spark, sf):
    return tidy(fe.yield_curve(panel.yields(spark, sf)))


@query(
    "chronological_split",
    f"""WITH {BARS} SELECT symbol, date, CASE WHEN row_number() {_W} <= floor(count(*) OVER (PARTITION BY symbol) * 0.7::DOUBLE) THEN 'train' ELSE 'test' END AS part FROM bars""",
)
def chronological_split(spark, sf):
    return fe.chronological_split(panel.bars(spark, sf).select("symbol", "date"))


@query(
    "feature_sequences",
    f"""WITH {BARS}, s AS (SELECT symbol, date, list([close, CAST(volume AS DOUBLE)]) OVER (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING) AS sequence FROM bars)
    SELECT symbol, date, sequence FROM s WHERE len(sequence) = 20""",
)
def feature_sequences(spark, sf):
    return fe.sequences(panel.bars(spark, sf), ["close", "volume"])


@query("target_split", f"WITH {_FSET} SELECT symbol, date, {r('target')} AS target FROM ff WHERE target IS NOT NULL")
def target_split(spark, sf):
    frame = feature_frame(spark, sf).dropna(subset=["target"])
    return tidy(fe.split_target(frame, fe.target_column(frame, None, "target"))[1])


@query(
    "feature_history",
    f"WITH {_FSET} SELECT symbol, date, {r('body', 9)} AS body, {r('spread', 9)} AS spread FROM ff WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'",
)
def feature_history(spark, sf):
    frame = feature_frame(spark, sf).filter("date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'")
    return tidy(frame.select("symbol", "date", "body", "spread"), 9)


_A = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@query(
    "forward_targets",
    f"""WITH {LAGGED}, t AS (SELECT symbol, date, lead(close, 5) {_W} / close - 1 AS tr, min(low) {_A} / close - 1 AS td,
      stddev_samp(lr) {_A} AS tv, max(abs(lr)) {_A} AS tj, min(lr) {_A} AS tt FROM rets)
    SELECT symbol, date, {r('tr')} AS target_return, {r('td')} AS target_drawdown, {r('tv')} AS target_volatility, {r('tj')} AS target_jump, {r('tt')} AS target_tail,
      ntile(4) OVER (PARTITION BY symbol ORDER BY tr, date) AS target_bin FROM t WHERE tr IS NOT NULL""",
)
def forward_targets(spark, sf):
    out = fe.targets(panel.bars(spark, sf))
    cols = ["target_return", "target_drawdown", "target_volatility", "target_jump", "target_tail", "target_bin"]
    return tidy(out.select("symbol", "date", *cols))


_SIG = f"""{LAGGED}, s AS (SELECT symbol, date, close, sr AS p, CASE WHEN sr >= 0.02 THEN 'BUY' WHEN sr <= -0.02 THEN 'SELL' ELSE 'HOLD' END AS action FROM rets WHERE sr IS NOT NULL)"""


@query(
    "trading_signals",
    f"""WITH {_SIG} SELECT symbol, date, action, {r("CASE WHEN action <> 'HOLD' THEN close * (1 + p) END", 9)} AS target_price,
    {r("CASE action WHEN 'BUY' THEN close * 0.95::DOUBLE WHEN 'SELL' THEN close * 1.05::DOUBLE END", 5)} AS stop_price FROM s""",
)
def trading_signals(spark, sf):
    p = panel.bars(spark, sf).select("symbol", "date", "close", simple_return().alias("predicted")).dropna(subset=["predicted"])
    return tidy(fe.signals(p).select("symbol", "date", "action", "target_price", "stop_price"), 5, target_price=9)


@query("signals_by_action", f"WITH {_SIG} SELECT symbol, action, count(*) AS n FROM s GROUP BY symbol, action")
def signals_by_action(spark, sf):
    p = panel.bars(spark, sf).select("symbol", "date", "close", simple_return().alias("predicted")).dropna(subset=["predicted"])
    return fe.signals(p).groupBy("symbol", "action").agg(F.count("*").alias("n"))


# --- registries ---------------------------------------------------------------

_MODELS = """models AS (SELECT o_orderkey AS model_id, o_orderpriority AS model_type, o_orderstatus AS target, CAST(o_orderdate AS DATE) AS created_at,
  o_totalprice / 500000 AS r2 FROM orders)"""


def models(spark, sf):
    return panel.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("model_id"), F.col("o_orderpriority").alias("model_type"), F.col("o_orderstatus").alias("target"),
        F.to_date("o_orderdate").alias("created_at"), (F.col("o_totalprice") / 500000).alias("r2"),
    )


@query(
    "model_search",
    f"WITH {_MODELS} SELECT model_id, model_type, target, created_at, {r('r2', 8)} AS r2 FROM models WHERE model_type = '2-HIGH' AND created_at >= DATE '1998-01-01' AND r2 >= 0.5",
)
def model_search(spark, sf):
    out = reg.search(models(spark, sf), {"model_type": "2-HIGH", "target": None}, {"created_at": "1998-01-01", "r2": 0.5})
    return tidy(out, 8)


@query("model_page", f"WITH {_MODELS} SELECT model_id, created_at FROM models ORDER BY created_at DESC, model_id LIMIT 25 OFFSET 50")
def model_page(spark, sf):
    return reg.page(models(spark, sf), "created_at", "model_id", 50, 25).select("model_id", "created_at")


@query("model_count", f"WITH {_MODELS} SELECT target, count(*) AS n FROM models WHERE r2 >= 0.25 GROUP BY target")
def model_count(spark, sf):
    return reg.search(models(spark, sf), at_least={"r2": 0.25}).groupBy("target").agg(F.count("*").alias("n"))


@query("model_lookup", f"WITH {_MODELS} SELECT model_id, model_type FROM models WHERE model_id = 7")
def model_lookup(spark, sf):
    return reg.search(models(spark, sf), {"model_id": 7}).select("model_id", "model_type")


@query(
    "model_importance",
    f"""WITH {_MODELS} SELECT model_id, model_type, l_linenumber AS feature, {r('max(l_discount)')} AS importance FROM models JOIN lineitem ON l_orderkey = model_id GROUP BY ALL""",
)
def model_importance(spark, sf):
    items = panel.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("model_id"), F.col("l_linenumber").alias("feature")).agg(
        F.max("l_discount").alias("importance")
    )
    return tidy(models(spark, sf).select("model_id", "model_type").join(items, "model_id"))


@query("models_without_importance", f"WITH {_MODELS} SELECT model_id FROM models WHERE model_id NOT IN (SELECT l_orderkey FROM lineitem)")
def models_without_importance(spark, sf):
    items = panel.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("model_id"))
    return reg.orphans(models(spark, sf).select("model_id"), items, "model_id")


def backtests(spark, sf):
    return panel.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("backtest_id"), F.col("o_custkey").alias("model_id"),
        F.to_json(F.struct((F.col("o_totalprice") / 1000).alias("total_return"))).alias("metrics"),
    )


@query("backtest_search", "SELECT o_orderkey AS backtest_id, o_custkey AS model_id FROM orders WHERE o_totalprice / 1000 >= 300")
def backtest_search(spark, sf):
    return reg.min_return(backtests(spark, sf), 300.0).select("backtest_id", "model_id")


@query(
    "ensemble_members",
    f"""SELECT s_suppkey AS ensemble_id, s_suppkey * 2 AS model_id, {r('s_acctbal / 1000')} AS weight FROM supplier
    UNION ALL SELECT s_suppkey, s_suppkey * 2 + 1, NULL FROM supplier""",
)
def ensemble_members(spark, sf):
    return tidy(reg.ensemble_members(ensembles(spark, sf)))


def ensembles(spark, sf):
    key = F.col("s_suppkey")
    return panel.table(spark, sf, "supplier").select(
        key.alias("ensemble_id"), F.array(key * 2, key * 2 + 1).alias("model_ids"), F.array(F.col("s_acctbal") / 1000).alias("weights")
    )


@query(
    "registry_delete",
    f"WITH {_MODELS} SELECT model_id, model_type FROM models WHERE r2 >= 0.1",
)
def registry_delete(spark, sf):
    m = models(spark, sf)
    return up.delete_by_key(m, m.filter("r2 < 0.1"), ["model_id"]).select("model_id", "model_type")


_CURVE = f"""{BARS_AND_INDEX}, cv AS (SELECT b.symbol, b.date, b.close AS e, i.close AS k FROM bars b JOIN index_bars i ON i.symbol = 'SPX' AND i.date = b.date),
cr AS (SELECT *, e / lag(e) OVER w - 1 AS r, k / lag(k) OVER w - 1 AS b, e / max(e) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd
  FROM cv WINDOW w AS (PARTITION BY symbol ORDER BY date)),
ca AS (SELECT symbol, count(r) AS n, arg_max(e, date) / arg_min(e, date) - 1 AS tr, min(dd) AS dd, avg(r) AS m, stddev_samp(r) AS s,
  sqrt(avg(CASE WHEN r < 0 THEN r * r WHEN r IS NOT NULL THEN 0 END)) AS down, regr_slope(r, b) AS beta, avg(b) AS mb, stddev_samp(r - b) AS te, avg(r - b) AS active
  FROM cr GROUP BY symbol HAVING count(r) > 1)"""


@query(
    "equity_measures",
    f"""WITH {_CURVE} SELECT symbol, {sig('tr')} AS total_return, {sig('pow(1 + tr, 252 / n) - 1')} AS annual_return, {r('dd')} AS max_drawdown, {r('m / s * sqrt(252)')} AS sharpe,
    {r('m / down * sqrt(252)')} AS sortino, {sig('(pow(1 + tr, 252 / n) - 1) / abs(dd)')} AS calmar, {sig('beta')} AS beta, {sig('(m - beta * mb) * 252')} AS alpha,
    {r('active / te * sqrt(252)')} AS information_ratio FROM ca""",
)
def equity_measures(spark, sf):
    spx = panel.index_bars(spark, sf).filter("symbol = 'SPX'").select("date", F.col("close").alias("benchmark"))
    curve = panel.bars(spark, sf).select("symbol", "date", F.col("close").alias("equity")).join(spx, "date")
    return tidy(reg.equity_measures(curve), significant=("total_return", "annual_return", "calmar", "beta", "alpha"))


@query(
    "trade_measures",
    f"""WITH {BARS}, t AS (SELECT symbol, close - open AS p FROM bars) SELECT symbol, count(*) AS trades, {r('count(*) FILTER (p > 0) / count(*)', 8)} AS win_rate,
    {r('sum(p) FILTER (p > 0) / abs(sum(p) FILTER (p < 0))', 8)} AS profit_factor, {r('avg(p) FILTER (p > 0)', 8)} AS mean_win, {r('avg(p) FILTER (p < 0)', 8)} AS mean_loss FROM t GROUP BY symbol""",
)
def trade_measures(spark, sf):
    return tidy(reg.trade_measures(panel.bars(spark, sf).select("symbol", (F.col("close") - F.col("open")).alias("profit"))), 8)


@query(
    "prediction_errors",
    f"""WITH {LAGGED} SELECT symbol, {sig('avg((close - pc) ** 2)')} AS mse, {sig('avg(abs(close - pc))')} AS mae, {r('1 - avg((close - pc) ** 2) / var_pop(close)')} AS r2
    FROM rets WHERE pc IS NOT NULL GROUP BY symbol""",
)
def prediction_errors(spark, sf):
    from barwright.functions.series import prev

    p = panel.bars(spark, sf).select("symbol", F.col("close").alias("actual"), prev("close").alias("predicted")).dropna()
    return tidy(reg.regression_measures(p, "symbol"), 6, significant=("mse", "mae"))


@query(
    "feature_set_key",
    "SELECT p_partkey, md5('{\"brand\":\"' || p_brand || '\",\"size\":' || CAST(p_size AS VARCHAR) || '}') AS set_key FROM part",
)
def feature_set_key(spark, sf):
    part = panel.table(spark, sf, "part")
    return part.select("p_partkey", F.md5(F.to_json(F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))).cast("binary")).alias("set_key"))


@query("interval_symbols", f"WITH {BARS} SELECT DISTINCT symbol, '1h' AS interval FROM bars WHERE volume % 3 = 0")
def interval_symbols(spark, sf):
    interval = F.when(F.col("volume") % 3 == 0, "1h").otherwise("1d")
    table = panel.bars(spark, sf).withColumn("interval", interval)
    return table.filter("interval = '1h'").select("symbol", "interval").distinct()
