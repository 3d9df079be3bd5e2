"""Queries over partial autocorrelation, unit roots, fits by likelihood and local regression; tests hold them against numpy."""

from __future__ import annotations

from pyspark.sql import functions as F

from barwright.operators import smoothing as sm, stationarity as st, tail as ta, volatility as vo
from barwright.plans.registry import query, tidy
from barwright.sources import panel


@query("return_pacf")
def return_pacf(spark, sf):
    return tidy(st.pacf(st.returns_of(panel.bars(spark, sf))))


@query("volatility_pacf")
def volatility_pacf(spark, sf):
    return tidy(st.pacf(st.returns_of(panel.bars(spark, sf), absolute=True)))


@query("rolling_return_pacf")
def rolling_return_pacf(spark, sf):
    """Fifteen lags of each window of 120 rows; the operator takes 30 unless told otherwise, at some sixteen times the cost."""
    return tidy(st.rolling_pacf(st.returns_of(panel.bars(spark, sf)), lags=15), 5)


@query("unit_root_test")
def unit_root_test(spark, sf):
    return tidy(st.unit_root(panel.bars(spark, sf)))


@query("student_var")
def student_var(spark, sf):
    return tidy(ta.student_var(ta.tail_returns(panel.bars(spark, sf))), 5, freedom=2)


@query("var_comparison_all")
def var_comparison_all(spark, sf):
    return tidy(ta.var_comparison(ta.tail_returns(panel.bars(spark, sf)), student=True), 3)


@query("pareto_likelihood")
def pareto_likelihood(spark, sf):
    return tidy(ta.pareto_likelihood(ta.exceedances(ta.tail_returns(panel.bars(spark, sf)))), 5)


@query("return_levels_likelihood")
def return_levels_likelihood(spark, sf):
    return tidy(ta.return_levels(ta.pareto_likelihood(ta.exceedances(ta.tail_returns(panel.bars(spark, sf))))), 4)


@query("lowess_close")
def lowess_close(spark, sf):
    """Trend of closes through the nearest quarter of each series."""
    return tidy(sm.lowess(panel.bars(spark, sf).select("symbol", "date", F.col("close").alias("x"))), 5)


@query("lowess_volatility")
def lowess_volatility(spark, sf):
    """Trend of the annual volatility of the last 21 days."""
    vol = vo.rolling_volatility(panel.bars(spark, sf), [21])
    return tidy(sm.lowess(vol.select("symbol", "date", F.col("vol_21d").alias("x"))), 5)
