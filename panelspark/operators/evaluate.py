"""Forecast evaluation (H22–H24): error metrics per series and model, fold scores, user losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def long_errors(df: DataFrame, models, keys=("unique_id",), y: str = "y", extra=()) -> DataFrame:
    """Unpivot model columns → ``(keys…, model, y, yhat, err)``."""
    ids = list(dict.fromkeys([*keys, *extra, y]))
    long = df.unpivot(ids, list(models), "model", "yhat")
    return long.withColumn("err", F.col("yhat") - F.col(y))


def mase_scale(history: DataFrame, season_length: int) -> DataFrame:
    """In-sample seasonal-naive scale ``mean|y_t − y_{t−m}|`` per series."""
    w = Window.partitionBy("unique_id").orderBy("ds")
    d = history.select("unique_id", F.abs(F.col("y") - F.lag("y", season_length).over(w)).alias("__d"))
    return d.groupBy("unique_id").agg(F.avg("__d").alias("__scale"))


def metric_exprs(y: str = "y") -> dict:
    e, a = F.col("err"), F.abs(F.col("err"))
    return {"mae": F.avg(a), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)),
            "mape": F.avg(F.try_divide(a, F.abs(F.col(y)))),
            "smape": F.avg(F.try_divide(a, F.abs(F.col(y)) + F.abs(F.col("yhat"))))}


def evaluate(df: DataFrame, models, history: DataFrame | None = None, season_length: int = 24,
             keys=("unique_id",), losses: dict | None = None) -> DataFrame:
    """Mae, mse, rmse, mape (fraction), smape (|e|/(|y|+|ŷ|)), and mase when ``history`` is given; one row per
    (keys, model).  ``losses``: extra ``name → f(long_df_columns) -> aggregate Column`` (H24)."""
    long = long_errors(df, models, keys)
    aggs = [v.alias(k) for k, v in metric_exprs().items()]
    for name, fn in (losses or {}).items():
        aggs.append(fn().alias(name))
    out = long.groupBy(*keys, "model").agg(*aggs)
    if history is not None:
        out = out.join(mase_scale(history, season_length), "unique_id", "left") \
                 .withColumn("mase", F.try_divide(F.col("mae"), F.col("__scale"))).drop("__scale")
    return out


def fold_scores(cv: DataFrame, models) -> DataFrame:
    """Rmse and mape per (series, model, cutoff), then their mean and population σ across folds."""
    long = long_errors(cv, models, ("unique_id", "cutoff"))
    per = long.groupBy("unique_id", "model", "cutoff").agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"),
                                                           F.avg(F.try_divide(F.abs("err"), F.abs("y"))).alias("mape"))
    return per.groupBy("unique_id", "model").agg(F.avg("rmse").alias("rmse_mean"), F.stddev_pop("rmse").alias("rmse_std"),
                                                 F.avg("mape").alias("mape_mean"), F.stddev_pop("mape").alias("mape_std"),
                                                 F.count("*").alias("folds"))


def wape() -> Column:
    """Example user loss (H24): Σ|e| / Σ|y| — any callable returning an aggregate Column plugs in."""
    return F.try_divide(F.sum(F.abs("err")), F.sum(F.abs("y")))
