"""Spark ML queries (rows-only checks in the driver; behaviour pinned by pytest): H1–H3, H7, H8, H10, H18, H20,
H21, J8–J12."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.util import round_doubles
from panelspark.operators import customer as cu
from panelspark.operators import ml
from panelspark.operators import relational as rel
from panelspark.plans.registry import register
from panelspark.sources import panels

LAGS = (1, 2, 3, 24)


def _feats(spark, sf_dir, series_id=False, materialise=False):
    p = panels.events_hourly(spark, sf_dir)
    f = ml.lag_features(p, LAGS)
    if series_id:
        f = ml.add_series_index(f)
    if materialise:  # several fits / scorings read it: checkpoint once (shared folder) instead of recomputing
        from panelspark.session import cut_lineage

        f = cut_lineage(f)
    return f


def _train_test(feats):
    """Train and test filters: the last two calendar days present are the replayed "day t" (one-row aggregate)."""
    last = feats.agg(F.to_date(F.max("ds")).alias("day")).first()["day"]
    cut = F.date_sub(F.lit(last), 1).cast("timestamp_ntz")
    return F.col("ds") < cut, F.col("ds") >= cut


@register("h3_one_step_replay_gbt")
def h3_one_step_replay_gbt(spark, sf_dir):
    f = _feats(spark, sf_dir, materialise=True)
    tr, te = _train_test(f)
    m = ml.fit_global(f.filter(tr), ml.feature_names(LAGS), "gbt", maxIter=20, maxDepth=4)
    return round_doubles(ml.one_step_replay(m, f, te).select("unique_id", "ds", "y", "yhat"), 4)


@register("h2_recursive_forecast_gbt")
def h2_recursive_forecast_gbt(spark, sf_dir):
    f = _feats(spark, sf_dir, materialise=True)
    m = ml.fit_global(f, ml.feature_names(LAGS), "gbt", maxIter=20, maxDepth=4)
    return round_doubles(ml.recursive_forecast(m, panels.events_hourly(spark, sf_dir), 24, "h", LAGS), 4)


@register("h7_insample_fitted_values")
def h7_insample_fitted_values(spark, sf_dir):
    """Fitted values of each cross-validation fold: 3 cutoffs, 24 hours apart, a fit on the rows up to each."""
    f = _feats(spark, sf_dir, materialise=True)
    last = f.agg(F.max("ds").alias("last")).first()["last"]
    out = None
    for k in (3, 2, 1):
        cutoff = F.lit(last - datetime.timedelta(hours=24 * k)).cast("timestamp_ntz")
        m = ml.fit_global(f.filter(F.col("ds") <= cutoff), ml.feature_names(LAGS), "gbt", maxIter=20, maxDepth=4)
        fold = ml.one_step_replay(m, f, F.col("ds") <= cutoff).select(
            "unique_id", "ds", cutoff.alias("cutoff"), "y", F.col("yhat").alias("fitted"))
        out = fold if out is None else out.unionByName(fold)
    return round_doubles(out, 4)


@register("h8_many_models_merged")
def h8_many_models_merged(spark, sf_dir):
    """GBT, random forest, linear and Huber (H10) fitted on the same rows; one-step test predictions merged."""
    f = _feats(spark, sf_dir, materialise=True)
    tr, te = _train_test(f)
    feats = ml.feature_names(LAGS)
    tables, failed = [], []
    for name, kind, kw in (("gbt", "gbt", {"maxIter": 20, "maxDepth": 4}), ("rf", "rf", {"numTrees": 30, "maxDepth": 6}),
                           ("linear", "linear", {}), ("huber", "huber", {"epsilon": 1.35})):
        try:
            m = ml.fit_global(f.filter(tr), feats, kind, **kw)
        except ml.FIT_ERRORS as error:  # reported, its column is null, the others are still merged
            failed.append(f"{name}: {type(error).__name__}")
            tables.append(f.filter(te).select("unique_id", "ds", F.lit(None).cast("double").alias(name)))
            continue
        tables.append(ml.one_step_replay(m, f, te, name).select("unique_id", "ds", name))
    return round_doubles(rel.merge_models(tables).withColumn("failed_models", F.lit("; ".join(failed))), 4)


@register("h18_random_search_trials")
def h18_random_search_trials(spark, sf_dir):
    f = _feats(spark, sf_dir, series_id=True, materialise=True)
    tr, te = _train_test(f)
    return ml.random_search(f, ml.feature_names(LAGS), [(tr, te)], families=("ridge", "huber", "gbt"), n_trials=2)


@register("h20_best_configs")
def h20_best_configs(spark, sf_dir):
    return ml.best_configs(h18_random_search_trials(spark, sf_dir))


# ---------------------------------------------------------------- red-flag classifier

def _classifier(spark, sf_dir):
    from panelspark.session import cut_lineage

    # one row per customer, reused by the scaler fit, the class quantiles, the forest fit and the scoring:
    # materialise it once (reliable checkpoint in the shared folder) instead of re-running the joins per action
    f = cut_lineage(cu.split(cu.customer_features(spark, sf_dir, 1, 3), "CustomerID", 0.8, 42, stratify="RedFlag"))
    cols = cu.feature_cols(cu.products_of(f))
    f = rel.standard_scale(f, cols, fit_filter=F.col("is_train")).fillna(0.0, subset=cols)  # undefined trends → 0
    m = ml.fit_classifier(f.filter("is_train"), cols, "RedFlag", balanced=True, trees=100)
    pred = m.transform(f.filter(~F.col("is_train"))).select("CustomerID", F.col("RedFlag").alias("label"),
                                                            F.col("prediction").cast("int").alias("prediction"),
                                                            "CustomerType", "CompanySize", "OverallGrowthTrend",
                                                            "ProductDiversityTrend", "SignificantShift")
    return m, pred, cols


@register("j8_red_flag_classifier")
def j8_red_flag_classifier(spark, sf_dir):
    _, pred, _ = _classifier(spark, sf_dir)
    return pred


@register("j9_classifier_report")
def j9_classifier_report(spark, sf_dir):
    _, pred, _ = _classifier(spark, sf_dir)
    return cu.classification_report(pred)


@register("j11_feature_importance")
def j11_feature_importance(spark, sf_dir):
    m, _, cols = _classifier(spark, sf_dir)
    return ml.importance_frame(spark, m, cols)


@register("j12_misclassified_summary")
def j12_misclassified_summary(spark, sf_dir):
    _, pred, _ = _classifier(spark, sf_dir)
    mis = pred.filter(F.col("label") != F.col("prediction"))
    return rel.describe(mis, ["OverallGrowthTrend", "ProductDiversityTrend", "SignificantShift", "label"])



# ---------------------------------------------------------------- the reference's replay on minute bars

BAR_LAGS = (1, 2, 3, 4, 5, 15, 30, 60, 120)  # fixed values: the replay's lag set (its band level is 60)


def _minute_replay(spark, sf_dir, level: float = 0.60, n_windows: int = 10, h: int = 5):
    """Fit on day t−1, replay day t one step at a time with the true history; band = ± the ``level`` quantile of the
    absolute one-step errors of a backtest over the last ``n_windows`` × ``h`` bars of day t−1, by a model fitted on the
    bars before them (one refit serves all windows); the band tested at row i is the forecast for row i+1."""
    from panelspark.operators import backtest as bt
    from panelspark.operators import relational as rel2

    from panelspark.session import cut_lineage

    bars = panels.last_two_days(panels.minute_bars(spark, sf_dir))
    feats = cut_lineage(ml.lag_features(bars.drop("day_rank"), BAR_LAGS, date_feats=("hour", "minute")).join(
        bars.select("unique_id", "ds", "day_rank"), ["unique_id", "ds"]))  # read by the fit and two replays
    names = ml.feature_names(BAR_LAGS, ("hour", "minute"))
    m = ml.fit_global(feats.filter("day_rank = 2"), names, "gbt", maxIter=20, maxDepth=4)
    end = feats.filter("day_rank = 2").groupBy("unique_id").agg(F.max("ds").alias("__end"))
    day = feats.filter("day_rank = 2").join(end, "unique_id")
    tested = F.col("ds") > F.col("__end") - F.expr(f"INTERVAL {n_windows * h} MINUTES")
    past = ml.fit_global(day.filter(~tested), names, "gbt", maxIter=20, maxDepth=4)
    errors = ml.one_step_replay(past, day, tested)
    q = rel2.exact_percentiles(errors.select("unique_id", F.abs(F.col("y") - F.col("yhat")).alias("e")),
                               ["unique_id"], "e", [level], ["q"])
    rep = ml.one_step_replay(m, feats, F.col("day_rank") == 1).join(q, "unique_id", "left")
    w = Window.partitionBy("unique_id").orderBy("ds")
    rep = rep.withColumn("next_pred", F.lead("yhat").over(w)) \
             .withColumns({"lower": F.col("next_pred") - F.col("q"), "upper": F.col("next_pred") + F.col("q")})
    return bt.signals(rep)


@register("h3_replay_minute_bars")
def h3_replay_minute_bars(spark, sf_dir):
    r = _minute_replay(spark, sf_dir)
    return round_doubles(r.select("unique_id", "ds", "y", "yhat", "lower", "upper", "signal"), 4)


@register("i3_replay_minute_bars_summary")
def i3_replay_minute_bars_summary(spark, sf_dir):
    from panelspark.operators import backtest as bt

    r = _minute_replay(spark, sf_dir)
    return round_doubles(bt.summary(bt.position_fold(r), r), 4)


@register("h4_conformal_gbt_one_step")
def h4_conformal_gbt_one_step(spark, sf_dir):
    """The replay's interval setting for the boosted-tree model: 10 refitted one-step windows, level 99."""
    f = _feats(spark, sf_dir, materialise=True)
    out = ml.conformal_one_step(f, panels.events_hourly(spark, sf_dir), ml.feature_names(LAGS), LAGS, "h", 10, (99,),
                                maxIter=10, maxDepth=4)
    return round_doubles(out, 4)
