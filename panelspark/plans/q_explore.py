"""Exploration / diagnostics / user-function queries.
Rows-only unless an oracle is given; closed forms are pinned by pytest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelspark.functions.util import round_doubles
from panelspark.operators import evaluate as ev
from panelspark.operators import explore
from panelspark.operators import forecast as fc
from panelspark.operators import regression as rg
from panelspark.operators import relational as rel
from panelspark.operators import userfn
from panelspark.operators import windows as wn
from panelspark.plans.registry import register
from panelspark.plans.sqlkit import W, with_ctes
from panelspark.sources import panels
from panelspark.sources.tables import read_table


def _pacf_sql():
    from panelspark.plans.q_series import _acf_sql

    body = with_ctes(
        "events_hourly", *_acf_sql("events_hourly"),
        "rl AS (SELECT unique_id, list(acf ORDER BY lag) AS r, max(lag) AS kmax FROM acf_l GROUP BY 1)",
        "dl(unique_id, k, phi, pkk) AS (SELECT unique_id, 1, [r[2]], r[2] FROM rl WHERE kmax >= 1 UNION ALL "
        "SELECT unique_id, k + 1, list_append(list_transform(phi, lambda x, i: x - p * phi[k + 1 - i]), p), p FROM ("
        "SELECT d.unique_id, d.k, d.phi, (rl.r[d.k + 2] - list_dot_product(d.phi, list_reverse(list_slice(rl.r, 2, d.k + 1)))) "
        "/ (1 - list_dot_product(d.phi, list_slice(rl.r, 2, d.k + 1))) AS p FROM dl d JOIN rl ON d.unique_id = rl.unique_id "
        "WHERE d.k < rl.kmax))",
        "SELECT unique_id, 0 AS lag, 1.0::DOUBLE AS pacf FROM rl UNION ALL SELECT unique_id, k AS lag, round(pkk, 6) AS pacf FROM dl")
    return "WITH RECURSIVE " + body[len("WITH "):]


@register("f17_pacf_hourly", _pacf_sql())
def f17_pacf_hourly(spark, sf_dir):
    return round_doubles(explore.pacf(explore.acf(panels.events_hourly(spark, sf_dir))), 6)


@register("f11_auto_differences")
def f11_auto_differences(spark, sf_dir):
    return explore.auto_differences(panels.orders_monthly(spark, sf_dir), 12, 1)


@register("f22_insight_report")
def f22_insight_report(spark, sf_dir):
    return explore.insight_report(panels.events_daily(spark, sf_dir))


def _residuals(spark, sf_dir):
    """In-sample seasonal-naive residuals of the hourly panel (m = 24)."""
    p = panels.events_hourly(spark, sf_dir)
    return p.select("unique_id", "ds", (F.col("y") - F.lag("y", 24).over(wn.series_window())).alias("y")).dropna()


_RESID = f"res AS (SELECT unique_id, ds, y FROM (SELECT unique_id, ds, y - lag(y, 24) OVER {W()} AS y FROM events_hourly) WHERE y IS NOT NULL)"


def _acklam_sql(p: str) -> str:
    """Inverse normal CDF in SQL (Acklam's rational approximation, relative error ≈ 1e-9)."""
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]

    def horner(coefs, v):
        out = f"{coefs[0]!r}"
        for k in coefs[1:]:
            out = f"({out}) * {v} + {k!r}"
        return out

    tail = lambda q: f"({horner(c, q)}) / (({horner(d, q)}) * {q} + 1)"
    ql, qu = f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    r = f"(({p}) - 0.5) * (({p}) - 0.5)"
    mid = f"({horner(a, r)}) * (({p}) - 0.5) / (({horner(b, r)}) * {r} + 1)"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(ql)} WHEN {p} > 0.97575 THEN -({tail(qu)}) ELSE {mid} END"


_QQ_SQL = with_ctes(
    "events_hourly", _RESID,
    "o AS (SELECT unique_id, y AS sample, row_number() OVER (PARTITION BY unique_id ORDER BY y) AS i, count(*) OVER (PARTITION BY unique_id) AS n FROM res)",
    "m AS (SELECT *, CASE WHEN i = 1 THEN 1 - pow(0.5, 1.0 / n) WHEN i = n THEN pow(0.5, 1.0 / n) ELSE (i - 0.3175) / (n + 0.365) END AS pm FROM o)",
    f"t AS (SELECT unique_id, i, sample, {_acklam_sql('pm')} AS theoretical FROM m)",
    "l AS (SELECT unique_id, regr_slope(sample, theoretical) AS slope, regr_intercept(sample, theoretical) AS intercept FROM t GROUP BY 1)",
    "SELECT t.unique_id, CAST(i AS INTEGER) AS i, round(theoretical, 6) AS theoretical, round(sample, 6) AS sample, round(slope, 6) AS slope, "
    "round(intercept, 6) AS intercept FROM t JOIN l ON t.unique_id = l.unique_id")


@register("d18_qq_points", _QQ_SQL)
def d18_qq_points(spark, sf_dir):
    return round_doubles(explore.qq_points(_residuals(spark, sf_dir), "y"), 6)




def _resid_acf_sql():
    from panelspark.plans.q_series import _acf_sql

    return with_ctes("events_hourly", _RESID, *_acf_sql("res", K=48), "SELECT unique_id, lag, round(acf, 6) AS acf FROM acf_l")


@register("h17_residual_acf", _resid_acf_sql())
def h17_residual_acf(spark, sf_dir):
    return round_doubles(explore.acf(_residuals(spark, sf_dir), nlags=48), 6)


@register("h17_residual_histogram", with_ctes(
    "events_hourly", _RESID, "st AS (SELECT unique_id, min(y) AS lo, max(y) AS hi, count(y) AS n FROM res GROUP BY 1)",
    "b AS (SELECT p.unique_id, lo, hi, n, CAST(COALESCE(least(floor((y - lo) / NULLIF((hi - lo) / 20, 0)), 19), 0) AS INTEGER) AS bin "
    "FROM res p JOIN st ON p.unique_id = st.unique_id)",
    "SELECT unique_id, bin, round(lo + bin * ((hi - lo) / 20), 6) AS \"left\", round(lo + (bin + 1) * ((hi - lo) / 20), 6) AS \"right\", "
    "count(*) AS count, round(count(*) / (n * ((hi - lo) / 20)), 6) AS density FROM b GROUP BY unique_id, bin, lo, hi, n"))
def h17_residual_histogram(spark, sf_dir):
    return round_doubles(rel.histogram(_residuals(spark, sf_dir), "y", 20, "unique_id"), 6)


@register("h17_residual_density", with_ctes(
    "events_hourly", _RESID,
    "st AS (SELECT unique_id, count(y) AS n, min(y) AS lo, max(y) AS hi, stddev_samp(y) * pow(count(y), -0.2) AS bw FROM res GROUP BY 1)",
    "g AS (SELECT unique_id, i, lo - 3 * bw + i * ((hi - lo) + 6 * bw) / 199 AS x, n, bw FROM st, range(200) t(i) WHERE bw > 0)",
    "SELECT g.unique_id, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - r.y) / bw, 2))) / (n * bw * sqrt(2 * pi())), 6) AS density "
    "FROM g JOIN res r ON r.unique_id = g.unique_id GROUP BY g.unique_id, i, x, n, bw"))
def h17_residual_density(spark, sf_dir):
    return round_doubles(rel.kde(_residuals(spark, sf_dir), "unique_id", "y", 200), 6)


def _design(spark, sf_dir, k=3):
    p = panels.orders_monthly(spark, sf_dir)
    d = explore.trend_fourier(p, panels.future_frame(p, 12, "ME"), 12, k)
    d = d.join(p, ["unique_id", "ds"], "left").withColumns({"one": F.lit(1.0), "trend": F.col("trend").cast("double")})
    return d, ["one", "trend", *[f"{f}{j}_12" for j in range(1, k + 1) for f in ("sin", "cos")]]


@register("h5_split_conformal")
def h5_split_conformal(spark, sf_dir):
    d, x = _design(spark, sf_dir)
    fit = rg.split_conformal(d.filter(~F.col("is_future")), ["unique_id"], x, "y", 0.1, 5)
    pr = rg.predict_linear(d.filter("is_future"), fit, ["unique_id"], x, "yhat").join(fit.select("unique_id", "q"), "unique_id")
    return round_doubles(pr.select("unique_id", "ds", "yhat", (F.col("yhat") - F.col("q")).alias("lo_90"),
                                   (F.col("yhat") + F.col("q")).alias("hi_90")), 2)


@register("h19_per_series_alpha_search")
def h19_per_series_alpha_search(spark, sf_dir):
    d, x = _design(spark, sf_dir)
    return rg.ridge_alpha_search(d.filter(~F.col("is_future")), x, "y", 12, 3)


def _h13_sql():
    body = with_ctes(
        "events_daily",
        f"l2 AS (SELECT unique_id, max(y) FILTER (WHERE r = 1) AS a, max(y) FILTER (WHERE r = 2) AS b FROM "
        f"(SELECT unique_id, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS r FROM events_daily) GROUP BY 1)",
        "rec(unique_id, step, a, b) AS (SELECT unique_id, 0, a, b FROM l2 UNION ALL "
        "SELECT unique_id, step + 1, 50.0 + 0.6 * a + 0.3 * b, a FROM rec WHERE step < 7)",
        "SELECT unique_id, step, round(a, 4) AS yhat FROM rec WHERE step >= 1")
    return "WITH RECURSIVE " + body[len("WITH "):]


@register("h13_forecast_from_given_coefficients", _h13_sql())
def h13_forecast_from_given_coefficients(spark, sf_dir):
    p = panels.events_daily(spark, sf_dir)
    # one row of given coefficients for every series of the panel
    given = p.select("unique_id").distinct().withColumn("coef", F.array(F.lit(50.0), F.lit(0.6), F.lit(0.3)))
    f = rg.ar_forecast(p, given, 7, 2, freq="D")
    return round_doubles(f.withColumn("step", F.col("step").cast("int")), 4)


def _theta_sql() -> str:
    grid = ", ".join(f"({a})" for a in rg.ALPHAS)
    body = with_ctes(
        "orders_monthly", f"s AS (SELECT *, row_number() OVER {W()} AS r, count(*) OVER (PARTITION BY unique_id) AS n FROM orders_monthly)",
        f"a AS (SELECT * FROM (VALUES {grid}) v(alpha))",
        "ses(unique_id, alpha, r, level, sse) AS (SELECT unique_id, CAST(alpha AS DOUBLE), r, y, CAST(0.0 AS DOUBLE) FROM s, a WHERE r = 1 UNION ALL "
        "SELECT e.unique_id, alpha, s.r, alpha * s.y + (1 - alpha) * level, sse + (s.y - level) * (s.y - level) FROM ses e JOIN s "
        "ON s.unique_id = e.unique_id AND s.r = e.r + 1)",
        "z AS (SELECT e.* FROM ses e JOIN s ON e.unique_id = s.unique_id AND e.r = s.r WHERE s.r = s.n)",
        "b AS (SELECT unique_id, arg_min(alpha, sse) AS alpha, arg_min(level, sse) AS level FROM z GROUP BY 1)",
        "t AS (SELECT unique_id, regr_slope(y, CAST(r AS DOUBLE)) AS slope, max(ds) AS mx FROM s GROUP BY 1)",
        "SELECT b.unique_id, CAST(last_day(date_trunc('month', mx) + to_months(CAST(k AS INTEGER))) AS TIMESTAMP) AS ds, "
        "CAST(k AS INTEGER) AS step, round(level + slope / 2 * k, 2) AS Theta, round(alpha, 2) AS alpha "
        "FROM b JOIN t ON b.unique_id = t.unique_id, range(1, 13) g(k)")
    return "WITH RECURSIVE " + body[len("WITH "):]


@register("h16_theta_plain", _theta_sql())
def h16_theta_plain(spark, sf_dir):
    f = rg.theta_forecast(panels.orders_monthly(spark, sf_dir), 12, "ME")
    return round_doubles(f.withColumn("step", F.col("step").cast("int")), 2)


@register("h16_theta_plain_chunked", _theta_sql())
def h16_theta_plain_chunked(spark, sf_dir):
    """The same by chunks of seven months whose smoothing maps are composed."""
    f = rg.theta_forecast(panels.orders_monthly(spark, sf_dir), 12, "ME", chunk_rows=7)
    return round_doubles(f.withColumn("step", F.col("step").cast("int")), 2)


@register("h16_theta")
def h16_theta(spark, sf_dir):
    return round_doubles(rg.theta_forecast(panels.orders_monthly(spark, sf_dir), 12, "ME", 12), 4)


def _baseline_comparison_sql() -> str:
    from panelspark.plans.q_forecast import _METRICS, _cv_ctes, MODELS

    return with_ctes(
        "orders_monthly", *_cv_ctes("orders_monthly", 12, 1, 12),
        f"lg AS (SELECT unique_id, y, model, yhat, yhat - y AS e FROM (UNPIVOT cv ON {', '.join(MODELS)} INTO NAME model VALUE yhat))",
        f"m AS (SELECT unique_id, model, {_METRICS} FROM lg GROUP BY 1, 2)",
        "SELECT unique_id, model, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape FROM m")


@register("h25_baseline_comparison", _baseline_comparison_sql())
def h25_baseline_comparison(spark, sf_dir):
    """The closed-form methods on the 12-month holdout (the comparison below adds Theta)."""
    ho = fc.holdout(panels.orders_monthly(spark, sf_dir), 12, 12)
    e = ev.evaluate(ho, list(fc.BASELINES)).select("unique_id", "model", "mae", "rmse", "mape", "smape")
    return round_doubles(e, 2, {"mape": 6, "smape": 6})


@register("h25_forecast_comparison")
def h25_forecast_comparison(spark, sf_dir):
    """Several methods on the same 12-month holdout, errors per method (baselines, Theta, ridge on Fourier terms)."""
    p = panels.orders_monthly(spark, sf_dir)
    ho = fc.holdout(p, 12, 12)
    hist = ho.select("unique_id").distinct()
    n = p.groupBy("unique_id").agg(F.count("*").alias("__n"))
    idx = p.join(n, "unique_id").withColumn("__r", F.row_number().over(wn.series_window()))
    train = idx.filter(F.col("__r") <= F.col("__n") - 12).select("unique_id", "ds", "y")
    th = rg.theta_forecast(train, 12, "ME", 12).select("unique_id", "ds", "Theta")
    j = ho.join(th, ["unique_id", "ds"], "left").join(hist, "unique_id", "left_semi")
    models = [*fc.BASELINES, "Theta"]
    return round_doubles(ev.evaluate(j, models, history=train, season_length=12), 6)


@register("e6_random_order_dates", "SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) "
          "ORDER BY ((CAST(d - DATE '1970-01-01' AS BIGINT) * 2654435761 + 1713471) % 4294967296), d LIMIT 10")
def e6_random_order_dates(spark, sf_dir):
    """k random distinct order dates without replacement (seeded hash order; the limit is the sampling feature)."""
    o = read_table(spark, sf_dir, "orders", ["o_orderdate"]).select(F.to_date("o_orderdate").alias("date"))
    return rel.random_distinct(o, "date", 10, 42).select(F.date_format("date", "yyyy-MM-dd").alias("date"))


def _detrend(pdf: pd.DataFrame) -> pd.DataFrame:
    t = np.arange(len(pdf), dtype=float)
    pdf = pdf.sort_values("ds")
    if len(pdf) > 1:
        b = np.polyfit(t, pdf["y"].to_numpy(float), 1)
        pdf = pdf.assign(detrended=pdf["y"].to_numpy(float) - np.polyval(b, t))
    else:
        pdf = pdf.assign(detrended=0.0)
    return pdf[["unique_id", "day", "ds", "y", "detrended"]]


@register("l1_apply_per_group", with_ctes(
    "events_hourly", "g AS (SELECT unique_id, CAST(ds AS DATE) AS day, ds, y, CAST(row_number() OVER (PARTITION BY unique_id, CAST(ds AS DATE) ORDER BY ds) - 1 AS DOUBLE) AS t FROM events_hourly)",
    "c AS (SELECT unique_id, day, regr_slope(y, t) AS b, regr_intercept(y, t) AS a, count(*) AS n FROM g GROUP BY 1, 2)",
    "SELECT g.unique_id, strftime(g.day, '%Y-%m-%d') AS day, g.ds, round(g.y, 4) AS y, round(CASE WHEN n > 1 THEN g.y - (a + b * t) ELSE 0.0 END, 4) AS detrended "
    "FROM g JOIN c ON g.unique_id = c.unique_id AND g.day = c.day"))
def l1_apply_per_group(spark, sf_dir):
    p = panels.events_hourly(spark, sf_dir).withColumn("day", F.to_date("ds"))
    out = userfn.apply_per_group(p, ["unique_id", "day"], _detrend,
                                 "unique_id string, day date, ds timestamp_ntz, y double, detrended double")
    return round_doubles(out.withColumn("day", F.date_format("day", "yyyy-MM-dd")), 4)


@register("l2_group_transform", with_ctes("events_daily", "SELECT unique_id, ds, round(y - avg(y) OVER (PARTITION BY unique_id), 4) AS y_demeaned, "
                                          "round(y / max(y) OVER (PARTITION BY unique_id), 6) AS y_share_of_max FROM events_daily"))
def l2_group_transform(spark, sf_dir):
    d = userfn.group_transform(panels.events_daily(spark, sf_dir), "unique_id",
                               {"y_demeaned": lambda w: F.col("y") - F.avg("y").over(w),
                                "y_share_of_max": lambda w: F.try_divide(F.col("y"), F.max("y").over(w))})
    return round_doubles(d.select("unique_id", "ds", "y_demeaned", "y_share_of_max"), 4, {"y_share_of_max": 6})


@register("l3_feature_registry", with_ctes("events_hourly", "SELECT unique_id, ds, CAST(hour(ds) AS INTEGER) AS hour_index, "
                                           "CAST(month(ds) AS INTEGER) AS month FROM events_hourly"))
def l3_feature_registry(spark, sf_dir):
    return userfn.add_features(panels.events_hourly(spark, sf_dir), ["hour_index", "month"]).select("unique_id", "ds", "hour_index", "month")
