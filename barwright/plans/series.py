"""Queries over tails, momentum, autocorrelation, anomalies and spectra."""

from __future__ import annotations


from barwright.operators import anomaly as an, momentum as mo, spectral as sp, tail as ta, wavelet as wv
from barwright.plans.registry import query, tidy
from barwright.plans.sqltext import BARS, LAGGED, r, rolling, sig
from barwright.sources import panel

# --- tails --------------------------------------------------------------------

TAIL = f"{LAGGED}, tr AS (SELECT symbol, date, ln(close / pc) AS r FROM rets WHERE close > 1e-9 AND pc > 1e-9)"
_HIST = """hist AS (SELECT t.symbol, min(v) AS var, avg(r) FILTER (r <= v) AS cvar FROM tr t
  JOIN (SELECT symbol, quantile_cont(r, 0.05) AS v FROM tr GROUP BY symbol) q ON q.symbol = t.symbol GROUP BY t.symbol)"""
_NORM = """norm AS (SELECT symbol, avg(r) - 1.6448536269514729::DOUBLE * stddev_samp(r) AS var,
  avg(r) - stddev_samp(r) * exp(-(1.6448536269514729::DOUBLE ** 2) / 2) / sqrt(2 * pi()) / 0.05::DOUBLE AS cvar
  FROM tr GROUP BY symbol HAVING stddev_samp(r) > 0)"""


def returns(spark, sf):
    return ta.tail_returns(panel.bars(spark, sf))


@query("tail_returns", f"WITH {TAIL} SELECT symbol, date, {r('r')} AS r FROM tr")
def tail_returns(spark, sf):
    return tidy(returns(spark, sf))


@query("historical_var", f"WITH {TAIL}, {_HIST} SELECT symbol, {r('var')} AS var, {r('cvar')} AS cvar FROM hist")
def historical_var(spark, sf):
    return tidy(ta.historical_var(returns(spark, sf)))


@query("normal_var", f"WITH {TAIL}, {_NORM} SELECT symbol, {r('var')} AS var, {r('cvar')} AS cvar FROM norm")
def normal_var(spark, sf):
    return tidy(ta.normal_var(returns(spark, sf)))


@query(
    "var_comparison",
    f"""WITH {TAIL}, {_HIST}, {_NORM} SELECT symbol, 'Historical' AS method, {r('-var * 100')} AS loss_pct FROM hist
    UNION ALL SELECT symbol, 'Parametric (Normal)', {r('-var * 100')} FROM norm""",
)
def var_comparison(spark, sf):
    return tidy(ta.var_comparison(returns(spark, sf)))


@query(
    "rolling_var",
    f"""WITH {TAIL}, w AS (SELECT symbol, date, list(r) OVER x AS l, count(r) OVER x AS n, quantile_cont(r, 0.05) OVER x AS v FROM tr
      WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS 62 PRECEDING))
    SELECT symbol, date, {r('-v * 100')} AS var_pct, {r('-list_avg(list_filter(l, lambda z: z <= v)) * 100')} AS cvar_pct FROM w WHERE n = 63""",
)
def rolling_var(spark, sf):
    return tidy(ta.rolling_var(returns(spark, sf)))


@query(
    "loss_exceedances",
    f"""WITH {TAIL}, q AS (SELECT symbol, quantile_cont(-r, 0.95) AS u, count(*) AS n FROM tr GROUP BY symbol)
    SELECT t.symbol, date, {r('u')} AS threshold, {r('-r - u')} AS excess, n FROM tr t JOIN q ON q.symbol = t.symbol WHERE -r > u""",
)
def loss_exceedances(spark, sf):
    return tidy(ta.exceedances(returns(spark, sf)))


PARETO = f"""{TAIL}, q AS (SELECT symbol, quantile_cont(-r, 0.95) AS u, count(*) AS n FROM tr GROUP BY symbol),
m AS (SELECT t.symbol, u, n, count(*) AS n_over, avg(-r - u) AS m, var_samp(-r - u) AS v FROM tr t JOIN q ON q.symbol = t.symbol WHERE -r > u GROUP BY ALL),
fit AS (SELECT symbol, u, n_over, n, CASE WHEN n_over >= 10 THEN (1 - m * m / v) / 2 END AS shape, CASE WHEN n_over >= 10 THEN m * (1 + m * m / v) / 2 END AS scale FROM m)"""


@query("pareto_fit", f"WITH {PARETO} SELECT symbol, {r('u')} AS threshold, n_over, n, {sig('shape')} AS shape, {sig('scale')} AS scale FROM fit")
def pareto_fit(spark, sf):
    return tidy(ta.pareto_fit(ta.exceedances(returns(spark, sf))), significant=("shape", "scale"))


@query(
    "return_levels",
    f"""WITH {PARETO}, p AS (SELECT *, CAST(unnest([{', '.join(map(str, ta.RETURN_PERIODS))}]) AS BIGINT) AS period FROM fit WHERE shape IS NOT NULL AND scale > 0)
    SELECT symbol, period, {sig('100 * (CASE WHEN abs(shape) < 1e-6 THEN u + scale * ln(n_over / n * period) ELSE u + scale / shape * (pow(n_over / n * period, shape) - 1) END)')} AS level_pct FROM p""",
)
def return_levels(spark, sf):
    return tidy(ta.return_levels(ta.pareto_fit(ta.exceedances(returns(spark, sf)))), significant=("level_pct",))


@query(
    "hill_estimator",
    f"""WITH {TAIL}, o AS (SELECT symbol, ln(nullif(CASE WHEN abs(r) > 1e-12 THEN abs(r) END, 0)) AS ln, count(*) OVER (PARTITION BY symbol) AS n,
        row_number() OVER w AS k, abs(r) AS a, date FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY abs(r) DESC, date)),
    h AS (SELECT symbol, k, n, avg(ln) OVER (PARTITION BY symbol ORDER BY k) - lead(ln) OVER (PARTITION BY symbol ORDER BY k) AS xi FROM o)
    SELECT symbol, k, {r('xi')} AS xi FROM h WHERE k BETWEEN 10 AND least(n - 2, greatest(10, n // 10)) AND xi IS NOT NULL AND abs(xi) >= 1e-9""",
)
def hill_estimator(spark, sf):
    return tidy(ta.hill(returns(spark, sf)))


# --- momentum -----------------------------------------------------------------


def _ema_sql(name, source, value, alpha, least, start="1"):
    """Closed form of the recursive average: weights of every earlier row of the series."""
    return f"""{name} AS (SELECT a.symbol, a.rn, CASE WHEN a.rn - {start} + 1 >= {least} THEN
      sum(b.{value} * (CASE WHEN b.rn = {start} THEN 1 ELSE {alpha} END) * pow(1 - {alpha}, a.rn - b.rn)) END AS v
      FROM {source} a JOIN {source} b ON b.symbol = a.symbol AND b.rn <= a.rn AND b.rn >= {start} GROUP BY a.symbol, a.rn)"""


_D = "CAST(2 AS DOUBLE)"
MACD = f"""{LAGGED}, {_ema_sql('fast', 'rets', 'close', f'({_D} / 13)', 12)}, {_ema_sql('slow', 'rets', 'close', f'({_D} / 27)', 26)},
line AS (SELECT f.symbol, f.rn, f.v - s.v AS m FROM fast f JOIN slow s ON s.symbol = f.symbol AND s.rn = f.rn),
late AS (SELECT * FROM line WHERE m IS NOT NULL), {_ema_sql('sig', 'late', 'm', f'({_D} / 10)', 9, '26')},
macd AS (SELECT r.symbol, r.date, m, sig.v AS s FROM rets r JOIN line l ON l.symbol = r.symbol AND l.rn = r.rn
  LEFT JOIN sig ON sig.symbol = r.symbol AND sig.rn = r.rn)"""


@query("macd", f"WITH {MACD} SELECT symbol, date, {r('m', 5)} AS macd, {r('s', 5)} AS macd_signal, {r('m - s', 5)} AS macd_diff FROM macd")
def macd(spark, sf):
    return tidy(mo.macd(panel.bars(spark, sf)), 5)


_A = "(CAST(1 AS DOUBLE) / 14)"
RSI = f"""{LAGGED}, ud AS (SELECT symbol, date, rn, CASE WHEN close > pc THEN close - pc ELSE 0 END AS u, CASE WHEN close < pc THEN pc - close ELSE 0 END AS d FROM rets),
{_ema_sql('up', 'ud', 'u', _A, 14)}, {_ema_sql('dn', 'ud', 'd', _A, 14)},
rsi AS (SELECT ud.symbol, ud.date, CASE WHEN dn.v IS NULL THEN NULL WHEN dn.v = 0 THEN 100 ELSE 100 - 100 / (1 + up.v / dn.v) END AS rsi
  FROM ud JOIN up ON up.symbol = ud.symbol AND up.rn = ud.rn JOIN dn ON dn.symbol = ud.symbol AND dn.rn = ud.rn)"""


@query("rsi", f"WITH {RSI} SELECT symbol, date, {r('rsi')} AS rsi FROM rsi")
def rsi(spark, sf):
    return tidy(mo.rsi(panel.bars(spark, sf)))


@query(
    "phase_roc_rsi",
    f"""WITH {RSI}, roc AS (SELECT symbol, date, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w * 100 AS m FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
    p AS (SELECT roc.symbol, roc.date, m, rsi FROM roc JOIN rsi ON rsi.symbol = roc.symbol AND rsi.date = roc.date WHERE m IS NOT NULL AND rsi IS NOT NULL)
    SELECT symbol, date, {r('m')} AS momentum, {r('rsi')} AS reversion, date - min(date) OVER (PARTITION BY symbol) AS elapsed FROM p""",
)
def phase_roc_rsi(spark, sf):
    return tidy(mo.phase_table(panel.bars(spark, sf)))


@query(
    "phase_macd_rsi",
    f"""WITH {MACD}, {RSI.removeprefix(LAGGED + ', ')},
    p AS (SELECT macd.symbol, macd.date, m, rsi FROM macd JOIN rsi ON rsi.symbol = macd.symbol AND rsi.date = macd.date WHERE m IS NOT NULL AND rsi IS NOT NULL)
    SELECT symbol, date, {r('m', 5)} AS momentum, {r('rsi', 5)} AS reversion, date - min(date) OVER (PARTITION BY symbol) AS elapsed FROM p""",
)
def phase_macd_rsi(spark, sf):
    return tidy(mo.phase_table(panel.bars(spark, sf), "macd", "rsi"), 5)


@query(
    "rolling_autocorrelation",
    f"""WITH {LAGGED}, p AS (SELECT symbol, date, sr AS r, lag(sr) OVER (PARTITION BY symbol ORDER BY date) AS rl FROM rets),
    q AS (SELECT symbol, date, count(*) OVER w AS n, corr(r, rl) OVER w AS c FROM p WHERE r IS NOT NULL AND rl IS NOT NULL
      WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 119 PRECEDING))
    SELECT symbol, date, {r('c')} AS autocorrelation FROM q WHERE n = 120""",
)
def rolling_autocorrelation(spark, sf):
    return tidy(mo.rolling_autocorrelation(panel.bars(spark, sf)))


def _acf_series(absolute):
    x = "abs(sr)" if absolute else "sr"
    return f"{LAGGED}, xs AS (SELECT symbol, date, {x} AS x FROM rets WHERE sr IS NOT NULL)"


def _rolling_acf_sql(absolute):
    lags = ", ".join(f"lag(x, {k}) OVER w AS x{k}" for k in range(1, 31))
    num = ", ".join(
        f"""(sum(x * x{k}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {120 - k} PRECEDING AND 1 PRECEDING)
         - m * (sum(x) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {120 - k} PRECEDING AND 1 PRECEDING)
              + sum(x{k}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {120 - k} PRECEDING AND 1 PRECEDING)) + {120 - k} * m * m) / (119 * v) AS acf_{k}"""
        for k in range(1, 31)
    )
    return f"""WITH {_acf_series(absolute)}, l AS (SELECT *, {lags}, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n,
      avg(x) OVER p AS m, var_samp(x) OVER p AS v FROM xs WINDOW w AS (PARTITION BY symbol ORDER BY date),
      p AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
    a AS (SELECT symbol, date, i, n, v, {num} FROM l)
    SELECT symbol, date, {', '.join(f"{r(f'acf_{k}', 5)} AS acf_{k}" for k in range(1, 31))} FROM a WHERE n >= 151 AND i > 120 AND v >= 1e-10"""


@query("rolling_return_acf", _rolling_acf_sql(False))
def rolling_return_acf(spark, sf):
    return tidy(mo.rolling_acf(panel.bars(spark, sf)), 5)


@query("rolling_volatility_acf", _rolling_acf_sql(True))
def rolling_volatility_acf(spark, sf):
    return tidy(mo.rolling_acf(panel.bars(spark, sf), absolute=True), 5)


def _acf_sql(absolute):
    lags = ", ".join(f"lag(d, {k}) OVER (PARTITION BY symbol ORDER BY date) AS d{k}" for k in range(1, 31))
    union = "SELECT symbol, n, CAST(0 AS BIGINT) AS lag, CAST(1 AS DOUBLE) AS acf FROM s UNION ALL " + " UNION ALL ".join(
        f"SELECT symbol, n, {k}, c{k} / v FROM s" for k in range(1, 31)
    )
    return f"""WITH {_acf_series(absolute)}, d AS (SELECT *, x - avg(x) OVER (PARTITION BY symbol) AS d FROM xs), l AS (SELECT *, {lags} FROM d),
    s AS (SELECT symbol, count(*) AS n, sum(d * d) AS v, {', '.join(f'sum(d * d{k}) AS c{k}' for k in range(1, 31))} FROM l GROUP BY symbol HAVING count(*) >= 32),
    f AS ({union})
    SELECT a.symbol, a.lag, {r('min(a.acf)')} AS acf, {r('CASE WHEN a.lag = 0 THEN 0 ELSE 1.959963984540054::DOUBLE * sqrt((1 + 2 * coalesce(sum(b.acf ** 2), 0)) / min(a.n)) END')} AS band
    FROM f a LEFT JOIN f b ON b.symbol = a.symbol AND b.lag < a.lag AND b.lag > 0 GROUP BY a.symbol, a.lag"""


@query("return_acf", _acf_sql(False))
def return_acf(spark, sf):
    return tidy(mo.acf(panel.bars(spark, sf)))


@query("volatility_acf", _acf_sql(True))
def volatility_acf(spark, sf):
    return tidy(mo.acf(panel.bars(spark, sf), absolute=True))


@query(
    "hurst_exponent",
    f"""WITH {BARS}, b AS (SELECT symbol, close, date, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back FROM bars),
    p AS (SELECT symbol, close, date, 100 - back AS pos FROM b WHERE back <= 100 AND symbol IN (SELECT symbol FROM bars GROUP BY symbol HAVING count(*) >= 100)),
    c AS (SELECT p.*, size, pos // size AS chunk FROM p, (VALUES (10), (17), (31), (56), (100)) s(size) WHERE (pos // size + 1) * size <= 100),
    g AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol, size, chunk ORDER BY date) - 1 AS step FROM c),
    rs AS (SELECT symbol, size, chunk, (max(close) / min(close) - 1) / nullif(stddev_samp(step), 0) AS rs FROM g GROUP BY ALL),
    m AS (SELECT symbol, size, avg(rs) AS rs FROM rs WHERE rs > 0 GROUP BY ALL)
    SELECT symbol, {r('regr_slope(log10(rs), log10(size))')} AS hurst FROM m GROUP BY symbol""",
)
def hurst_exponent(spark, sf):
    return tidy(mo.hurst(panel.bars(spark, sf)))


def _rolling_hurst_sql():
    """Each chunk as its own frame before the row, sizes and offsets as the operator has them."""
    chunks = [(n, j) for n in mo.HURST_SIZES for j in range(100 // n)]
    frame = lambda n, j, cut: f"OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {100 - j * n - cut} PRECEDING AND {100 - (j + 1) * n + 1} PRECEDING)"
    cells = ", ".join(
        f"nullif((max(close) {frame(n, j, 0)} / min(close) {frame(n, j, 0)} - 1) / nullif(stddev_samp(step) {frame(n, j, 1)}, 0), 0) AS c{n}_{j}" for n, j in chunks
    )
    means = ", ".join(f"log10(list_avg([{', '.join(f'c{n}_{j}' for m, j in chunks if m == n)}])) AS m{n}" for n in mo.HURST_SIZES)
    points = ", ".join(f"(log10({n}::DOUBLE), m{n})" for n in mo.HURST_SIZES)
    return f"""{BARS}, st AS (SELECT symbol, date, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS step FROM bars),
    ch AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i,
      stddev_pop(close) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS sd, {cells} FROM st),
    ms AS (SELECT symbol, date, {means} FROM ch WHERE i > 100 AND sd >= 1e-9),
    hurst AS (SELECT symbol, date, (SELECT CASE WHEN count(y) = 5 THEN regr_slope(y, x) END FROM (VALUES {points}) p(x, y)) AS h FROM ms)"""


@query("rolling_hurst", f"WITH {_rolling_hurst_sql()} SELECT symbol, date, {r('h')} AS hurst FROM hurst")
def rolling_hurst(spark, sf):
    return tidy(mo.rolling_hurst(panel.bars(spark, sf)))


@query(
    "phase_macd_hurst",
    f"""WITH {_rolling_hurst_sql()}, {MACD.removeprefix(BARS + ',')},
    p AS (SELECT macd.symbol, macd.date, m, h FROM macd JOIN hurst ON hurst.symbol = macd.symbol AND hurst.date = macd.date WHERE m IS NOT NULL AND h IS NOT NULL)
    SELECT symbol, date, {r('m', 5)} AS momentum, {r('h', 5)} AS reversion, date - min(date) OVER (PARTITION BY symbol) AS elapsed FROM p""",
)
def phase_macd_hurst(spark, sf):
    return tidy(mo.phase_table(panel.bars(spark, sf), "macd", "hurst"), 5)


@query(
    "phase_roc_hurst",
    f"""WITH {_rolling_hurst_sql()}, roc AS (SELECT symbol, date, (close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY date), 0) - 1) * 100 AS m FROM bars),
    p AS (SELECT roc.symbol, roc.date, m, h FROM roc JOIN hurst ON hurst.symbol = roc.symbol AND hurst.date = roc.date WHERE m IS NOT NULL AND h IS NOT NULL)
    SELECT symbol, date, {r('m', 5)} AS momentum, {r('h', 5)} AS reversion, date - min(date) OVER (PARTITION BY symbol) AS elapsed FROM p""",
)
def phase_roc_hurst(spark, sf):
    return tidy(mo.phase_table(panel.bars(spark, sf), "roc", "hurst"), 5)


@query(
    "last_rows",
    f"""WITH {BARS}, b AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS back, count(*) OVER (PARTITION BY symbol) AS n FROM bars)
    SELECT symbol, date, close, least(n, 120) - back AS pos FROM b WHERE back <= 120""",
)
def last_rows(spark, sf):
    return tidy(mo.last_rows(panel.bars(spark, sf).select("symbol", "date", "close"), 120))


# --- anomalies ----------------------------------------------------------------


def _z_sql(source, value, keys):
    ks = ", ".join(keys)
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys)
    return f"""zs AS (SELECT {ks}, avg({value}) AS m, stddev_pop({value}) AS s, quantile_cont({value}, 0.5) AS med FROM {source} GROUP BY {ks}),
    zd AS (SELECT {', '.join('a.' + k for k in keys)}, quantile_cont(abs({value} - med), 0.5) / 0.6744897501960817::DOUBLE AS mad FROM {source} a JOIN zs b ON {on} GROUP BY ALL),
    scored AS (SELECT x.*, ({value} - m) / nullif(s, 0) AS z, 0.6745::DOUBLE * ({value} - med) / nullif(mad, 0) AS mod_z FROM {source} x JOIN zs USING ({ks}) JOIN zd USING ({ks}))"""


_ZLONG = f"""{LAGGED}, zl AS (SELECT symbol, date, 'close' AS measure, close AS value FROM rets UNION ALL SELECT symbol, date, 'volume', CAST(volume AS DOUBLE) FROM rets
  UNION ALL SELECT symbol, date, 'log_return', lr FROM rets WHERE lr IS NOT NULL)"""


@query(
    "z_anomalies",
    f"""WITH {_ZLONG}, {_z_sql('zl', 'value', ['symbol', 'measure'])} SELECT symbol, date, measure, {r('value')} AS value, {r('z')} AS z, {r('mod_z')} AS mod_z,
    coalesce(abs(z) > 3, false) OR coalesce(abs(mod_z) > 3.5, false) AS is_anomaly FROM scored""",
)
def z_anomalies(spark, sf):
    return tidy(an.z_anomalies(panel.bars(spark, sf)))


FEATS = f"""{LAGGED}, f0 AS (SELECT symbol, date, lr AS log_return, ({rolling('stddev_samp(lr)', 'lr', 21)}) * sqrt(252) AS volatility,
  nullif(volume, 0) / lag(nullif(volume, 0)) OVER (PARTITION BY symbol ORDER BY date) - 1 AS volume_pct_change FROM rets),
feats AS (SELECT * FROM f0 WHERE log_return IS NOT NULL AND volatility IS NOT NULL AND volume_pct_change IS NOT NULL)"""


@query(
    "anomaly_features",
    f"WITH {FEATS} SELECT symbol, date, {r('log_return')} AS log_return, {r('volatility')} AS volatility, {r('volume_pct_change')} AS volume_pct_change FROM feats",
)
def anomaly_features(spark, sf):
    return tidy(an.features(panel.bars(spark, sf)))


_NOISE = (
    f"{FEATS}, st AS (SELECT symbol, "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in an.FEATURES)
    + ", "
    + ", ".join(f"corr({an.FEATURES[a]}, {an.FEATURES[b]}) AS c{a}{b}" for a, b in ((0, 1), (0, 2), (1, 2)))
    + " FROM feats GROUP BY symbol), p AS (SELECT f.symbol, date, "
    + ", ".join(f"(f.{c} - m_{c}) / s_{c} AS x{i}" for i, c in enumerate(an.FEATURES))
    + """ FROM feats f JOIN st ON st.symbol = f.symbol),
    near AS (SELECT a.symbol, a.date, b.date AS other FROM p a JOIN p b ON a.symbol = b.symbol AND
      (a.x0 - b.x0) ** 2 + (a.x1 - b.x1) ** 2 + (a.x2 - b.x2) ** 2 <= 0.25),
    core AS (SELECT symbol, date FROM near GROUP BY ALL HAVING count(*) >= 5),
    ok AS (SELECT DISTINCT n.symbol, n.date FROM near n JOIN core c ON c.symbol = n.symbol AND c.date = n.other),
    noise AS (SELECT p.*, ok.date IS NULL AS dbscan_anomaly FROM p LEFT JOIN ok ON ok.symbol = p.symbol AND ok.date = p.date)"""
)


@query("density_noise", f"WITH {_NOISE} SELECT symbol, date, dbscan_anomaly FROM noise")
def density_noise(spark, sf):
    return an.density_noise(an.features(panel.bars(spark, sf)))


# Eigenvalues by the cosine form of the cubic; an eigenvector is the longest cross product of two rows.
_AXES = """ev AS (SELECT *, 1 + 2 * q * cos(phi) AS l1, 1 + 2 * q * cos(phi + 2 * pi() / 3) AS l3 FROM (
      SELECT *, acos(greatest(-1, least(1, c01 * c02 * c12 / q ** 3))) / 3 AS phi FROM (SELECT *, sqrt((c01 ** 2 + c02 ** 2 + c12 ** 2) / 3) AS q FROM st))),
    lam AS (SELECT symbol, c01, c02, c12, 1 AS axis, 1 - l1 AS d FROM ev UNION ALL SELECT symbol, c01, c02, c12, 2, 1 - (3 - l1 - l3) FROM ev),
    cp AS (SELECT symbol, axis, [c01 * c12 - c02 * d, c02 * c01 - d * c12, d * d - c01 * c01] AS v FROM lam
      UNION ALL SELECT symbol, axis, [c01 * d - c02 * c12, c02 * c02 - d * d, d * c12 - c01 * c02] FROM lam
      UNION ALL SELECT symbol, axis, [d * d - c12 * c12, c12 * c02 - c01 * d, c01 * c12 - d * c02] FROM lam),
    best AS (SELECT symbol, axis, v, list_sum(list_transform(v, lambda x: x * x)) AS len FROM cp
      QUALIFY row_number() OVER (PARTITION BY symbol, axis ORDER BY len DESC) = 1),
    axes AS (SELECT symbol, axis, list_transform(v, lambda x: x / sqrt(len) * CASE WHEN list_max(v) >= -list_min(v) THEN 1 ELSE -1 END) AS v FROM best)"""


@query(
    "clustering_table",
    f"""WITH {_NOISE}, {_AXES} SELECT n.symbol, n.date, {r('x0 * a.v[1] + x1 * a.v[2] + x2 * a.v[3]', 5)} AS pca_1,
    {r('x0 * b.v[1] + x1 * b.v[2] + x2 * b.v[3]', 5)} AS pca_2, dbscan_anomaly
    FROM noise n JOIN axes a ON a.symbol = n.symbol AND a.axis = 1 JOIN axes b ON b.symbol = n.symbol AND b.axis = 2""",
)
def clustering_table(spark, sf):
    return tidy(an.clustering_table(an.features(panel.bars(spark, sf))), 5)


def _isolation_sql(trees: int, levels: int) -> str:
    """A table for each level, as many as any series here can need."""
    draw = lambda what: f"(('0x' || substr(md5('{what}/' || symbol || '/' || tree || '/' || node), 1, 12))::BIGINT / 281474976710656::DOUBLE)"
    deep = lambda n: f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + {an.EULER}::DOUBLE) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"
    ctes = [f"""t0 AS (SELECT symbol, date, n, ceil(log2(greatest(n, 2))) AS lim, [{', '.join(an.FEATURES)}] AS x, tree, 1::BIGINT AS node, NULL::DOUBLE AS path
      FROM (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM feats), (SELECT unnest(range(1, {trees} + 1)) AS tree))"""]
    for d in range(levels):
        ctes.append(f"""v{d} AS MATERIALIZED (SELECT *, x[CAST(floor({draw('feature')} * 3) AS INTEGER) + 1] AS v FROM t{d}),
      w{d} AS (SELECT *, count(*) OVER o AS held, min(v) OVER o AS low, max(v) OVER o AS high FROM v{d} WINDOW o AS (PARTITION BY symbol, tree, node)),
      p{d} AS (SELECT * REPLACE (coalesce(path, CASE WHEN held = 1 OR low = high OR lim <= {d} THEN {d} + {deep('held')} END) AS path) FROM w{d}),
      t{d + 1} AS (SELECT symbol, date, n, lim, x, tree, CASE WHEN path IS NOT NULL THEN node ELSE 2 * node + CAST(v >= low + {draw('place')} * (high - low) AS INTEGER) END AS node, path FROM p{d})""")
    ctes.append(f"sc AS (SELECT symbol, date, CASE WHEN n > 1 THEN 2 ** (-avg(path) / ({deep('n')})) END AS score FROM t{levels} GROUP BY symbol, date, n)")
    return ", ".join(ctes)


@query(
    "isolation_flags",
    f"""WITH {FEATS}, {_isolation_sql(20, 12)} SELECT symbol, date, {r('score')} AS score,
    coalesce(score > quantile_cont(score, 0.95) OVER (PARTITION BY symbol), false) AS isolated FROM sc""",
)
def isolation_flags(spark, sf):
    """Days that twenty random trees set apart early, one in twenty of each series."""
    return tidy(an.isolation_scores(an.features(panel.bars(spark, sf)), 20))


# --- spectra ------------------------------------------------------------------


_SPECTRUM = f"""{LAGGED}, s AS (SELECT symbol, lr, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE lr IS NOT NULL),
    f AS (SELECT symbol, regr_slope(lr, t) AS b, regr_intercept(lr, t) AS a FROM s GROUP BY symbol),
    x AS (SELECT s.symbol, t, n, (lr - a - b * t) * (0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * t / n)) AS x FROM s JOIN f ON f.symbol = s.symbol),
    k AS (SELECT symbol, n, CAST(unnest(range(n // 2)) AS BIGINT) AS k FROM (SELECT DISTINCT symbol, n FROM x)),
    sp AS (SELECT x.symbol, k, k / min(x.n) AS f, 2 / min(x.n) * sqrt(sum(x * cos(2 * pi() * ((k * t) % x.n) / x.n)) ** 2 + sum(x * sin(2 * pi() * ((k * t) % x.n) / x.n)) ** 2) AS a
      FROM x JOIN k ON k.symbol = x.symbol GROUP BY x.symbol, k)"""


@query("amplitude_spectrum", f"WITH {_SPECTRUM} SELECT symbol, k, {r('f')} AS frequency, {r('a')} AS amplitude FROM sp")
def amplitude_spectrum(spark, sf):
    return tidy(sp.amplitude_spectrum(sp.spectral_returns(panel.bars(spark, sf))))


@query(
    "spectral_peaks",
    f"""WITH {_SPECTRUM}, w AS (SELECT *, lag(a) OVER o AS b, lead(a) OVER o AS c FROM sp WINDOW o AS (PARTITION BY symbol ORDER BY k)),
    pk AS (SELECT * FROM w WHERE a > b AND a > c),
    higher AS (SELECT p.symbol, p.k, max(o.k) FILTER (o.k < p.k) AS l, min(o.k) FILTER (o.k > p.k) AS r FROM pk p LEFT JOIN sp o ON o.symbol = p.symbol AND o.a > p.a GROUP BY ALL),
    low AS (SELECT h.symbol, h.k, min(o.a) FILTER (o.k < h.k) AS l, min(o.a) FILTER (o.k > h.k) AS r FROM higher h JOIN sp o ON o.symbol = h.symbol AND o.k > coalesce(h.l, -1) AND o.k < coalesce(h.r, 1000000000) GROUP BY ALL),
    pr AS (SELECT pk.symbol, pk.k, f, a, a - greatest(l, r) AS p FROM pk JOIN low ON low.symbol = pk.symbol AND low.k = pk.k),
    rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY p DESC, k) AS rank FROM pr WHERE p >= 0.01)
    SELECT symbol, rank, k, {r('f')} AS frequency, {r('1 / f')} AS period, {r('a')} AS amplitude, {r('p')} AS prominence FROM rk WHERE rank <= 5""",
)
def spectral_peaks(spark, sf):
    """The five most prominent peaks of each spectrum that stand out by 0.01 at least."""
    return tidy(sp.spectral_peaks(sp.amplitude_spectrum(sp.spectral_returns(panel.bars(spark, sf))), 0.01))


@query(
    "uneven_periodogram",
    f"""WITH {BARS}, b AS (SELECT symbol, close AS v, date - min(date) OVER (PARTITION BY symbol) AS t, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i FROM bars WHERE close IS NOT NULL),
    g AS (SELECT symbol, regr_slope(v, i) AS m, regr_intercept(v, i) AS k, max(t) AS span, count(*) AS n FROM b GROUP BY symbol HAVING count(*) >= 3 AND max(t) > 0),
    fr AS (SELECT symbol, span, CAST(unnest(range(cnt)) AS BIGINT) AS j, cnt FROM (SELECT symbol, span, CAST(floor(1 * span * (0.5::DOUBLE - 2.0::DOUBLE / span)) AS BIGINT) AS cnt FROM g) WHERE cnt > 1),
    w AS (SELECT symbol, j, 2 * pi() * (2.0::DOUBLE / span + j * (0.5::DOUBLE - 2.0::DOUBLE / span) / (cnt - 1)) AS w FROM fr),
    x AS (SELECT b.symbol, t, v - k - m * i AS x FROM b JOIN g ON g.symbol = b.symbol),
    e AS (SELECT w.symbol, j, w, x, cos(w * t) AS c, sin(w * t) AS s FROM w JOIN x ON x.symbol = w.symbol),
    q AS (SELECT symbol, j, w, count(*) * covar_pop(x, c) AS xc, count(*) * covar_pop(x, s) AS xs, count(*) * var_pop(c) AS cc, count(*) * var_pop(s) AS ss, count(*) * covar_pop(c, s) AS cs, count(*) * var_pop(x) AS xx FROM e GROUP BY ALL)
    SELECT symbol, j, {r('w / (2 * pi())')} AS frequency, {r('2 * pi() / w')} AS period, {r('(ss * xc * xc + cc * xs * xs - 2 * cs * xc * xs) / (xx * (cc * ss - cs * cs))')} AS power FROM q""",
)
def uneven_periodogram(spark, sf):
    """One frequency a cycle of the span."""
    return tidy(sp.uneven_periodogram(panel.bars(spark, sf), samples=1))


def _taps(taps):
    # Lists count from one; an index beyond an edge comes back from it.
    at = lambda j: f"x[CASE WHEN 2 * k + 1 - {j} < 0 THEN {j} - 2 * k - 1 ELSE least(2 * k + 2 - {j}, 2 * len(x) - (2 * k + 1 - {j})) END] * {taps[j]!r}::DOUBLE"
    return f"list_transform(range((len(x) + 7) // 2), lambda k: {' + '.join(at(j) for j in range(8))})"


@query(
    "discrete_wavelet",
    f"""WITH RECURSIVE {LAGGED}, s AS (SELECT symbol, lr, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS t FROM rets WHERE lr IS NOT NULL),
    f AS (SELECT symbol, regr_slope(lr, t) AS b, regr_intercept(lr, t) AS a FROM s GROUP BY symbol),
    x0 AS (SELECT s.symbol, list(lr - a - b * t ORDER BY t) AS x, greatest(floor(log2(count(*) / 7)), 0) AS most FROM s JOIN f ON f.symbol = s.symbol GROUP BY s.symbol),
    w AS (SELECT symbol, 0 AS level, x, []::DOUBLE[] AS d, most FROM x0
      UNION ALL SELECT symbol, level + 1, {_taps(wv.LOW)}, {_taps(wv.HIGH)}, most FROM w WHERE level < most),
    l AS (SELECT symbol, level, 'approximation' AS part, unnest(range(len(x))) AS k, unnest(x) AS v FROM w WHERE level = most AND most > 0
      UNION ALL SELECT symbol, level, 'detail', unnest(range(len(d))), unnest(d) FROM w WHERE level > 0)
    SELECT symbol, CAST(level AS BIGINT) AS level, part, CAST(k AS BIGINT) AS k, {r('v')} AS coefficient FROM l""",
)
def discrete_wavelet(spark, sf):
    return tidy(wv.discrete_wavelet(sp.spectral_returns(panel.bars(spark, sf))))
