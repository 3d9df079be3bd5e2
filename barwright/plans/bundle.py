"""Every native group of analyses over one stored panel, as one long table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from barwright.operators import anomaly as an, indicators as ind, momentum as mo, spectral as sp, wavelet as wv
from barwright.plans import distribution, price, reports, series  # noqa: F401  their SQL is used below
from barwright.plans.registry import ORACLES, QUERIES, query, tidy
from barwright.plans.sqltext import r
from barwright.session import run_folder
from barwright.sources import panel

ROC_DAYS = (5, 10, 20, 60, 120)


def _latest_sql(name: str, analysis: str, columns, item=None) -> str:
    """Latest value of each column of a registered query; ``item`` is a column that parts the series."""
    keys = f"symbol, {item}" if item else "symbol"
    return " UNION ALL ".join(
        f"SELECT symbol, '{analysis}' AS analysis, {item or repr(c)} AS item, arg_max({c}, date) AS value FROM ({ORACLES[name]}) WHERE {c} IS NOT NULL GROUP BY {keys}" for c in columns
    )


_PARTS = [
    _latest_sql("rolling_correlations", "correlation", ["correlation"], "asset"),
    _latest_sql("rsi", "momentum", ["rsi"]),
    _latest_sql("macd", "momentum", ["macd", "macd_signal", "macd_diff"]),
    _latest_sql("rate_of_change", "momentum", [f"roc_{n}d" for n in ROC_DAYS]),
    _latest_sql("rolling_hurst", "reversion", ["hurst"]),
    f"SELECT symbol, 'autocorrelation', 'return_lag_' || lag, acf FROM ({ORACLES['return_acf']}) WHERE lag > 0",
    f"SELECT symbol, 'autocorrelation', 'volatility_lag_' || lag, acf FROM ({ORACLES['volatility_acf']}) WHERE lag > 0",
    f"SELECT symbol, 'anomaly', 'flagged_' || measure, CAST(count(*) FILTER (is_anomaly) AS DOUBLE) FROM ({ORACLES['z_anomalies']}) GROUP BY symbol, measure",
    f"SELECT symbol, 'anomaly', 'noise_days', CAST(count(*) FILTER (dbscan_anomaly) AS DOUBLE) FROM ({ORACLES['density_noise']}) GROUP BY symbol",
    f"SELECT symbol, 'spectral', 'frequency_' || rank, frequency FROM ({ORACLES['spectral_peaks']})",
    f"SELECT symbol, 'spectral', 'prominence_' || rank, prominence FROM ({ORACLES['spectral_peaks']})",
    f"SELECT symbol, 'wavelet', part || '_' || level, sum(coefficient * coefficient) FROM ({ORACLES['discrete_wavelet']}) GROUP BY symbol, part, level",
    f"SELECT symbol, analysis, item, value FROM ({ORACLES['eda_bundle']})",
]


def _long(df: DataFrame, analysis: str, item: Column, value: str) -> DataFrame:
    return df.select("symbol", F.lit(analysis).alias("analysis"), item.alias("item"), F.col(value).cast("double").alias("value"))


def latest(df: DataFrame, analysis: str, columns: list[str], item: str | None = None) -> DataFrame:
    """Last value of each column that is not NULL, of each symbol and of each ``item`` of it: one aggregate."""
    keys = ["symbol", item] if item else ["symbol"]
    last = df.groupBy(*keys).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date"))).alias(c) for c in columns])
    cells = F.array(*[F.struct((F.col(item) if item else F.lit(c)).alias("item"), F.col(c).alias("value")) for c in columns])
    return last.select("symbol", F.lit(analysis).alias("analysis"), F.inline(cells)).filter("value IS NOT NULL")


@query("eda_bundle_all", f"SELECT symbol, analysis, item, {r('value')} AS value FROM (" + " UNION ALL ".join(_PARTS) + ")")
def eda_bundle_all(spark, sf):
    """Price, volume, volatility, tails, correlation, momentum, reversion, autocorrelation, anomalies, spectrum and wavelet.

    The panel is written once and read by all groups but two, which have tables of their own.
    """
    path = run_folder(spark, "panel")
    panel.bars(spark, sf).write.parquet(path)
    bars = spark.read.parquet(path)
    count = lambda flag: F.count_if(F.col(flag)).alias("n")
    peaks = tidy(sp.spectral_peaks(sp.amplitude_spectrum(sp.spectral_returns(bars)), 0.01))
    waves = tidy(wv.discrete_wavelet(sp.spectral_returns(bars))).filter("level IS NOT NULL")
    energy = waves.groupBy("symbol", "part", "level").agg(F.sum(F.col("coefficient") * F.col("coefficient")).alias("v"))
    ranked = lambda name: F.concat(F.lit(f"{name}_"), F.col("rank").cast("string"))
    lagged = lambda name: F.concat(F.lit(f"{name}_lag_"), F.col("lag").cast("string"))
    parts = [
        latest(QUERIES["rolling_correlations"](spark, sf), "correlation", ["correlation"], "asset"),
        latest(tidy(mo.rsi(bars)), "momentum", ["rsi"]),
        latest(tidy(mo.macd(bars), 5), "momentum", ["macd", "macd_signal", "macd_diff"]),
        latest(tidy(ind.rate_of_change(bars)), "momentum", [f"roc_{n}d" for n in ROC_DAYS]),
        latest(tidy(mo.rolling_hurst(bars)), "reversion", ["hurst"]),
        _long(tidy(mo.acf(bars)).filter("lag > 0"), "autocorrelation", lagged("return"), "acf"),
        _long(tidy(mo.acf(bars, absolute=True)).filter("lag > 0"), "autocorrelation", lagged("volatility"), "acf"),
        _long(an.z_anomalies(bars).groupBy("symbol", "measure").agg(count("is_anomaly")), "anomaly", F.concat(F.lit("flagged_"), "measure"), "n"),
        _long(an.density_noise(an.features(bars)).groupBy("symbol").agg(count("dbscan_anomaly")), "anomaly", F.lit("noise_days"), "n"),
        _long(peaks, "spectral", ranked("frequency"), "frequency"),
        _long(peaks, "spectral", ranked("prominence"), "prominence"),
        _long(energy, "wavelet", F.concat_ws("_", "part", F.col("level").cast("string")), "v"),
        QUERIES["eda_bundle"](spark, sf).select("symbol", "analysis", "item", "value"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return tidy(out)
