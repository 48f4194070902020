"""Forecasting (H-family): closed-form baselines, rolling-origin cross-validation, conformal intervals, scenarios.

Baseline forecasts need only a few values of the history before an origin ``c`` (the last value, the running mean,
the first value, the last season).  Positions are indexed once per series; every forecast row then *joins* the values
it needs on ``(unique_id, pos)``.  Cross-validation therefore never replicates the training prefix per fold — only
the ``n_windows·h`` test rows exist, each joined to its origin — so a 10-window backtest costs about as much as one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.windows import _W
from panelspark.sources.panels import check_panel, future_frame

BASELINES = ("Naive", "SeasonalNaive", "HistoricAverage", "RandomWalkWithDrift")


def index_series(panel: DataFrame, time_bucket: str | None = None) -> DataFrame:
    """``pos`` (0-based), ``n``, running mean and first value per series — one window pass.

    ``time_bucket`` (skew-safe): no window spans a whole series.  Counts and sums per (series, bucket) give prefix
    offsets over that small table; only within-bucket windows run, so a hot series is indexed by many tasks."""
    check_panel(panel)
    if time_bucket:
        b = F.date_trunc(time_bucket, F.col("ds"))
        d = panel.withColumn("__b", b)
        agg = d.groupBy("unique_id", "__b").agg(F.count("*").alias("__c"), F.sum("y").alias("__s"))
        wb = Window.partitionBy("unique_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        agg = agg.select("unique_id", "__b", F.coalesce(F.sum("__c").over(wb), F.lit(0)).alias("__off"),
                         F.coalesce(F.sum("__s").over(wb), F.lit(0.0)).alias("__soff"),
                         F.sum("__c").over(Window.partitionBy("unique_id")).alias("n"))
        wi = Window.partitionBy("unique_id", "__b").orderBy("ds")
        d = d.join(agg, ["unique_id", "__b"]).withColumns({
            "pos": (F.col("__off") + F.row_number().over(wi) - 1).cast("int"),
            "__run": F.col("__soff") + F.sum("y").over(wi.rowsBetween(Window.unboundedPreceding, 0))})
        d = d.withColumn("__cummean", F.col("__run") / (F.col("pos") + 1))
        first = d.filter(F.col("pos") == 0).select("unique_id", F.col("y").alias("__first"))
        return d.join(first, "unique_id").select("unique_id", "ds", "y", "pos", "n", "__cummean", "__first")
    run = _W().rowsBetween(Window.unboundedPreceding, 0)
    return panel.select("unique_id", "ds", "y", (F.row_number().over(_W()) - 1).alias("pos"),
                        F.count("*").over(Window.partitionBy("unique_id")).alias("n"),
                        F.avg("y").over(run).alias("__cummean"), F.first("y").over(run).alias("__first"))


def _predict_from_origin(idx: DataFrame, targets: DataFrame, season_length: int, models=BASELINES) -> DataFrame:
    """``targets``: ``unique_id, __c`` (origin: training is positions < c), ``step`` (1-based) and any payload."""
    anchor = idx.select("unique_id", F.col("pos").alias("__a"), F.col("ds").alias("cutoff"),
                        F.col("y").alias("__last"), F.col("__cummean").alias("__mean"), "__first")
    t = targets.withColumn("__a", F.col("__c") - 1).join(anchor, ["unique_id", "__a"], "left")
    out = {}
    if "SeasonalNaive" in models:
        seas = idx.select("unique_id", F.col("pos").alias("__sp"), F.col("y").alias("SeasonalNaive"))
        sp = F.col("__c") - season_length + (F.col("step") - 1) % season_length
        t = t.withColumn("__sp", F.when(sp >= 0, sp)).join(seas, ["unique_id", "__sp"], "left")
    if "Naive" in models:
        out["Naive"] = F.col("__last")
    if "HistoricAverage" in models:
        out["HistoricAverage"] = F.col("__mean")
    if "RandomWalkWithDrift" in models:
        slope = F.try_divide(F.col("__last") - F.col("__first"), (F.col("__c") - 1).cast("double"))
        out["RandomWalkWithDrift"] = F.col("__last") + F.col("step") * slope
    t = t.withColumns(out)
    return t.drop("__a", "__sp", "__last", "__mean", "__first")


def forecast_baselines(panel: DataFrame, h: int, freq: str, season_length: int, models=BASELINES) -> DataFrame:
    """Future ``h`` stamps per series with the closed-form baselines → ``(unique_id, ds, <model>…)``."""
    idx = index_series(panel)
    fut = future_frame(panel, h, freq)
    n = idx.groupBy("unique_id").agg(F.max("n").alias("__c"))
    t = fut.join(n, "unique_id")
    p = _predict_from_origin(idx, t, season_length, models)
    return p.select("unique_id", "ds", *models)


def cross_validation(panel: DataFrame, h: int, n_windows: int, season_length: int, step: int | None = None,
                     models=BASELINES, time_bucket: str | None = None) -> DataFrame:
    """H6: rolling origins; window i (0…w−1) trains on the first ``n − h − (w−1−i)·step`` rows and tests the next h.

    Output: ``unique_id, ds, cutoff, step, y, <model>…`` (``cutoff`` = last training stamp)."""
    step = step or h
    idx = index_series(panel, time_bucket)
    first_c = F.col("n") - h - (n_windows - 1) * step
    cand = idx.filter(F.col("pos") >= first_c)
    folds = cand.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_windows - 1))).alias("__fold"))
    c = F.col("n") - h - (n_windows - 1 - F.col("__fold")) * step
    t = folds.withColumn("__c", c).filter((F.col("pos") >= F.col("__c")) & (F.col("pos") < F.col("__c") + h)
                                          & (F.col("__c") > 0))
    t = t.select("unique_id", "ds", "y", "__c", (F.col("pos") - F.col("__c") + 1).alias("step"))
    p = _predict_from_origin(idx, t, season_length, models)
    return p.select("unique_id", "ds", "cutoff", "step", "y", *models)


def holdout(panel: DataFrame, h: int, season_length: int, models=BASELINES):
    """Train = all but the last h rows of each series, test = the last h (one CV window)."""
    return cross_validation(panel, h, 1, season_length, models=models)


def conformal_intervals(cv: DataFrame, fcst: DataFrame, models, levels=(80, 95)) -> DataFrame:
    """H4: per (series, horizon step, model) the backtest absolute errors s form the symmetric set {±s}; the interval
    at level L is ŷ + its (100∓L)/2 percentiles.  ``fcst`` must carry ``step``."""
    long = cv.unpivot(["unique_id", "step", "y"], list(models), "model", "yhat")
    z = long.select("unique_id", "step", "model",
                    F.explode(F.array(F.abs(F.col("y") - F.col("yhat")), -F.abs(F.col("y") - F.col("yhat")))).alias("z"))
    probs = []
    for L in levels:
        probs += [(100 - L) / 200, (100 + L) / 200]
    q = z.groupBy("unique_id", "step", "model").agg(F.percentile("z", probs).alias("__q"))
    f = fcst.unpivot(["unique_id", "ds", "step"], list(models), "model", "yhat").join(q, ["unique_id", "step", "model"], "left")
    cols = {}
    for i, L in enumerate(levels):
        cols[f"lo_{L}"] = F.col("yhat") + F.col("__q")[2 * i]
        cols[f"hi_{L}"] = F.col("yhat") + F.col("__q")[2 * i + 1]
    f = f.withColumns(cols).drop("__q")
    # back to the wide table: <model>, <model>_lo_<L>, <model>_hi_<L>
    piv_vals = ["yhat"] + list(cols)
    wide = f.groupBy("unique_id", "ds", "step").pivot("model", list(models)).agg(
        *[F.first(v).alias(v) for v in piv_vals])
    ren = {}
    for m in models:
        ren[f"{m}_yhat"] = m
        for L in levels:
            ren[f"{m}_lo_{L}"] = f"{m}_lo_{L}"
            ren[f"{m}_hi_{L}"] = f"{m}_hi_{L}"
    return wide.withColumnsRenamed({k: v for k, v in ren.items() if k != v})


def forecast_with_step(panel: DataFrame, h: int, freq: str, season_length: int, models=BASELINES) -> DataFrame:
    idx = index_series(panel)
    fut = future_frame(panel, h, freq)
    n = idx.groupBy("unique_id").agg(F.max("n").alias("__c"))
    p = _predict_from_origin(idx, fut.join(n, "unique_id"), season_length, models)
    return p.select("unique_id", "ds", "step", *models)


def merge_forecasts(tables, keys=("unique_id", "ds"), how: str = "full") -> DataFrame:
    """Fold per-model forecast tables into one (outer using-join coalesces the keys)."""
    return reduce(lambda a, b: a.join(b, list(keys), how), tables)


def promo_flag(spine: DataFrame, promo_dates, ds: str = "ds", out: str = "promo") -> DataFrame:
    """1 when the month of ``ds`` holds any of ``promo_dates``.  The month list is a literal dimension."""
    spark = spine.sparkSession
    months = spark.createDataFrame([(d,) for d in promo_dates], "d string") \
                  .select(F.trunc(F.to_date("d"), "month").alias("__m")).distinct()
    j = spine.withColumn("__m", F.trunc(F.col(ds), "month")).join(F.broadcast(months), "__m", "left_semi")
    flagged = j.select(*spine.columns, F.lit(1).alias(out))
    return spine.join(flagged.select(ds, out), ds, "left").withColumn(out, F.coalesce(F.col(out), F.lit(0)))


def uplift(col: str, flag: str, rate: float):
    """``y·(1 + r·flag)``."""
    return F.col(col) * (1 + F.lit(rate) * F.col(flag))
