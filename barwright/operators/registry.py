"""Model, ensemble and back-test registries, and measures over their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from barwright.functions.series import by_date, simple_return


def search(df: DataFrame, equal: dict[str, object] | None = None, at_least: dict[str, object] | None = None) -> DataFrame:
    """Optional predicates: a value of None leaves its predicate out."""
    for name, value in (equal or {}).items():
        if value is not None:
            df = df.filter(F.col(name) == F.lit(value))
    for name, value in (at_least or {}).items():
        if value is not None:
            df = df.filter(F.col(name) >= F.lit(value))
    return df


def page(df: DataFrame, order: str, key: str, skip: int, limit: int) -> DataFrame:
    """A page of the newest rows, the key breaking ties."""
    return df.orderBy(F.desc(order), key).offset(skip).limit(limit)


def min_return(backtests: DataFrame, least: float | None, column: str = "metrics") -> DataFrame:
    """Back-tests whose JSON metrics report at least this total return."""
    if least is None:
        return backtests
    return backtests.filter(F.get_json_object(column, "$.total_return").cast("double") >= least)


def ensemble_members(ensembles: DataFrame) -> DataFrame:
    """One row per member with its weight; NULL where the weight list is short."""
    zipped = F.slice(F.arrays_zip("model_ids", "weights"), F.lit(1), F.size("model_ids"))
    return ensembles.select("ensemble_id", F.inline(zipped)).withColumnsRenamed({"model_ids": "model_id", "weights": "weight"})


def orphans(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents.select(key), key, "left_anti")


def equity_measures(curve: DataFrame, periods: int = 252) -> DataFrame:
    """Total and annual return, drawdown, Sharpe, Sortino, Calmar and the benchmark measures.

    ``curve`` is (symbol, date, equity, benchmark). Everything before the last
    aggregation is one window over the series.
    """
    top = F.max("equity").over(by_date().rowsBetween(Window.unboundedPreceding, 0))
    df = curve.withColumns({"r": simple_return("equity"), "b": simple_return("benchmark"), "dd": F.try_divide(F.col("equity"), top) - 1})
    annual = F.sqrt(F.lit(float(periods)))
    agg = df.groupBy("symbol").agg(
        F.count("r").alias("n"),
        (F.max_by("equity", "date") / F.min_by("equity", "date") - 1).alias("total_return"),
        F.min("dd").alias("max_drawdown"),
        F.avg("r").alias("m"),
        F.stddev_samp("r").alias("s"),
        F.sqrt(F.avg(F.when(F.col("r") < 0, F.col("r") * F.col("r")).otherwise(F.when(F.col("r").isNotNull(), 0.0)))).alias("down"),
        F.regr_slope("r", "b").alias("beta"),
        F.avg("b").alias("mb"),
        F.stddev_samp(F.col("r") - F.col("b")).alias("te"),
        F.avg(F.col("r") - F.col("b")).alias("active"),
    ).filter("n > 1")
    yearly = F.pow(1 + F.col("total_return"), F.lit(float(periods)) / F.col("n")) - 1
    return agg.select(
        "symbol",
        "total_return",
        yearly.alias("annual_return"),
        "max_drawdown",
        (F.try_divide(F.col("m"), F.col("s")) * annual).alias("sharpe"),
        (F.try_divide(F.col("m"), F.col("down")) * annual).alias("sortino"),
        F.try_divide(yearly, F.abs("max_drawdown")).alias("calmar"),
        "beta",
        ((F.col("m") - F.col("beta") * F.col("mb")) * periods).alias("alpha"),
        (F.try_divide(F.col("active"), F.col("te")) * annual).alias("information_ratio"),
    )


def trade_measures(trades: DataFrame) -> DataFrame:
    """Win rate, profit factor and mean win and loss of (symbol, profit)."""
    p = F.col("profit")
    return trades.groupBy("symbol").agg(
        F.count("*").alias("trades"),
        (F.count_if(p > 0) / F.count("*")).alias("win_rate"),
        F.try_divide(F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p)))).alias("profit_factor"),
        F.avg(F.when(p > 0, p)).alias("mean_win"),
        F.avg(F.when(p < 0, p)).alias("mean_loss"),
    )


def regression_measures(predictions: DataFrame, *keys: str) -> DataFrame:
    """Mean squared and absolute error and the share of variance explained."""
    e = F.col("actual") - F.col("predicted")
    return predictions.groupBy(*keys).agg(
        F.avg(e * e).alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.avg(e * e), F.var_pop("actual"))).alias("r2"),
    )


def ensemble_mean(predictions: DataFrame, members: DataFrame) -> DataFrame:
    """Weighted mean of the member predictions; a missing weight counts as 1."""
    w: Column = F.coalesce("weight", F.lit(1.0))
    return predictions.join(members, "model_id").groupBy("ensemble_id", "symbol", "date").agg(
        F.try_divide(F.sum(F.col("predicted") * w), F.sum(w)).alias("predicted")
    )


def fold_measures(measures: DataFrame, *keys: str) -> DataFrame:
    """Mean and deviation of the squared error over folds."""
    return measures.groupBy(*keys).agg(F.count("*").alias("folds"), F.avg("mse").alias("mean_mse"), F.stddev_samp("mse").alias("std_mse"))
