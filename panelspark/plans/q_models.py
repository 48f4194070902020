"""Gram-kernel model queries (F21, H5, H9, H11–H15, H19) and their oracles where SQL can state them."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.util import round_doubles
from panelspark.operators import arima, explore
from panelspark.operators import regression as rg
from panelspark.operators import windows as wn
from panelspark.plans.registry import register
from panelspark.plans.sqlkit import W, with_ctes
from panelspark.session import cut_lineage
from panelspark.sources import panels


@register("f21_adf_daily")
def f21_adf_daily(spark, sf_dir):
    return rg.adf(panels.events_daily(spark, sf_dir))


@register("f21_adf_monthly")
def f21_adf_monthly(spark, sf_dir):
    return rg.adf(panels.orders_monthly(spark, sf_dir))


@register("f21_adf_no_lags", with_ctes(
    "events_daily", f"d AS (SELECT unique_id, y - lag(y) OVER {W()} AS dy, lag(y) OVER {W()} AS x FROM events_daily)",
    "r AS (SELECT unique_id, regr_slope(dy, x) AS g, regr_sxx(dy, x) AS sxx, regr_syy(dy, x) AS syy, regr_sxy(dy, x) AS sxy, "
    "regr_count(dy, x) AS n FROM d GROUP BY 1)",
    "SELECT unique_id, round(g / sqrt((syy - sxy * sxy / sxx) / (n - 2) / sxx), 6) AS adf_stat, CAST(n AS INTEGER) AS nobs FROM r"))
def f21_adf_no_lags(spark, sf_dir):
    """Dickey–Fuller without augmentation: the t-statistic of the lagged level."""
    return round_doubles(rg.adf(panels.events_daily(spark, sf_dir), 0).select("unique_id", "adf_stat", "nobs"), 6)


def _trend(panel):
    return panel.withColumns({"one": F.lit(1.0), "trend": F.row_number().over(wn.series_window()).cast("double")})


@register("h9_linear_trend", with_ctes("orders_monthly", f"t AS (SELECT unique_id, y, row_number() OVER {W()} AS trend FROM orders_monthly)",
                                       "SELECT unique_id, round(regr_intercept(y, trend), 2) AS intercept, round(regr_slope(y, trend), 4) AS slope "
                                       "FROM t GROUP BY 1"))
def h9_linear_trend(spark, sf_dir):
    c = rg.fit_linear(_trend(panels.orders_monthly(spark, sf_dir)), ["unique_id"], ["one", "trend"], "y")
    return round_doubles(c.select("unique_id", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope")), 2,
                         {"slope": 4})


@register("h9_ridge_trend", with_ctes(
    "orders_monthly", f"t AS (SELECT unique_id, y, row_number() OVER {W()} AS trend FROM orders_monthly)",
    "r AS (SELECT unique_id, regr_sxy(y, trend) / (regr_sxx(y, trend) + 1000.0) AS b, avg(y) AS my, avg(trend) AS mt FROM t GROUP BY 1)",
    "SELECT unique_id, round(my - b * mt, 2) AS intercept, round(b, 4) AS slope FROM r"))
def h9_ridge_trend(spark, sf_dir):
    c = rg.fit_linear(_trend(panels.orders_monthly(spark, sf_dir)), ["unique_id"], ["one", "trend"], "y", "ridge", 1000.0)
    return round_doubles(c.select("unique_id", F.col("coef")[0].alias("intercept"), F.col("coef")[1].alias("slope")), 2,
                         {"slope": 4})


_ALPHAS = (0.0, 100.0, 10000.0)


def _alpha_search_sql(h: int = 12, windows: int = 3) -> str:
    """Rolling origins of a ridge trend line: each fold's slope from the rows before it, its error on the h rows after."""
    return with_ctes(
        "orders_monthly", f"t AS (SELECT unique_id, y, CAST(row_number() OVER {W()} AS DOUBLE) AS x, row_number() OVER {W()} AS r, "
        "count(*) OVER (PARTITION BY unique_id) AS n FROM orders_monthly)",
        f"f AS (SELECT t.*, i, n - {windows * h} + i * {h} AS o FROM t, range({windows}) g(i))",
        "k AS (SELECT unique_id, i, regr_sxy(y, x) AS sxy, regr_sxx(y, x) AS sxx, avg(y) AS my, avg(x) AS mx FROM f WHERE r <= o GROUP BY 1, 2)",
        f"a AS (SELECT * FROM (VALUES {', '.join(f'({a})' for a in _ALPHAS)}) v(alpha))",
        "e AS (SELECT f.unique_id, alpha, f.i, avg(pow(y - (my + sxy / (sxx + alpha) * (x - mx)), 2)) AS mse FROM f JOIN k "
        f"ON f.unique_id = k.unique_id AND f.i = k.i, a WHERE r > o AND r <= o + {h} GROUP BY 1, 2, 3)",
        "s AS (SELECT unique_id, alpha, avg(mse) AS mse FROM e GROUP BY 1, 2)",
        "SELECT unique_id, CAST(arg_min(alpha, mse) AS DOUBLE) AS alpha, round(sqrt(min(mse)), 0) AS cv_rmse FROM s GROUP BY 1")


@register("h19_trend_alpha_search", _alpha_search_sql())
def h19_trend_alpha_search(spark, sf_dir):
    """Every series its own ridge strength for a trend line, by rolling-origin error."""
    out = rg.ridge_alpha_search(_trend(panels.orders_monthly(spark, sf_dir)), ["one", "trend"], "y", 12, 3, _ALPHAS)
    return round_doubles(out, 0)


def _ar1_forecast_sql(h: int = 7) -> str:
    body = with_ctes(
        "events_daily", f"l AS (SELECT unique_id, ds, y, lag(y) OVER {W()} AS x FROM events_daily)",
        "f AS (SELECT unique_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c, "
        "(regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / (regr_count(y, x) - 2) AS s2, "
        "max(ds) AS mx, arg_max(y, ds) AS last FROM l GROUP BY 1)",
        "rec(unique_id, step, yhat, var, psi2) AS (SELECT unique_id, 0, last, CAST(0.0 AS DOUBLE), CAST(1.0 AS DOUBLE) FROM f UNION ALL "
        "SELECT r.unique_id, step + 1, c + phi * yhat, var + s2 * psi2, psi2 * phi * phi FROM rec r JOIN f ON r.unique_id = f.unique_id "
        f"WHERE step < {h})",
        "SELECT r.unique_id, r.step, mx + to_days(CAST(r.step AS INTEGER)) AS ds, round(yhat, 4) AS yhat, "
        "round(yhat - 1.959963984540054 * sqrt(var), 4) AS lo_95, round(yhat + 1.959963984540054 * sqrt(var), 4) AS hi_95, "
        "'(1,0,0)' AS \"order\" FROM rec r JOIN f ON r.unique_id = f.unique_id WHERE step > 0")
    return "WITH RECURSIVE " + body[len("WITH "):]


@register("h11_ar1_forecast", _ar1_forecast_sql())
def h11_ar1_forecast(spark, sf_dir):
    f = arima.arima_forecast(panels.events_daily(spark, sf_dir), arima.Order(1), 7, "D")
    return round_doubles(f.withColumn("step", F.col("step").cast("int")), 4)


def _fourier_design(spark, sf_dir, k=3, h=12):
    p = panels.orders_monthly(spark, sf_dir)
    d = explore.trend_fourier(p, panels.future_frame(p, h, "ME"), 12, k)
    d = d.join(p, ["unique_id", "ds"], "left").withColumns({"one": F.lit(1.0), "trend": F.col("trend").cast("double")})
    xcols = ["one", "trend", *[f"{f}{j}_12" for j in range(1, k + 1) for f in ("sin", "cos")]]
    return d, xcols


@register("h9_regularised_family")
def h9_regularised_family(spark, sf_dir):
    """Linear, ridge, lasso and elastic-net per series on trend + Fourier terms, forecasting the 12 future months."""
    d, xcols = _fourier_design(spark, sf_dir)
    hist = d.filter(~F.col("is_future"))
    out = None
    for name, kw in {"linear": {}, "ridge": {"method": "ridge", "alpha": 1.0},
                     "lasso": {"method": "lasso", "alpha": 0.1}, "elastic": {"method": "elastic", "alpha": 0.1}}.items():
        c = rg.fit_linear(hist, ["unique_id"], xcols, "y", **kw)
        pr = rg.predict_linear(d.filter("is_future"), c, ["unique_id"], xcols, name).select("unique_id", "ds", name)
        out = pr if out is None else out.join(pr, ["unique_id", "ds"])
    return out


@register("h15_model_comparison", with_ctes(
    "orders_monthly",
    f"ar AS (SELECT unique_id, y, lag(y) OVER {W()} AS x FROM orders_monthly)",
    f"tr AS (SELECT unique_id, y, CAST(row_number() OVER {W()} AS DOUBLE) AS x FROM orders_monthly)",
    "ca AS (SELECT unique_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ar GROUP BY 1)",
    "ct AS (SELECT unique_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM tr GROUP BY 1)",
    "s AS (SELECT ar.unique_id, 'AR(1)' AS model, sum(pow(y - a - b * x, 2)) AS ssr, count(*) AS n FROM ar JOIN ca ON ar.unique_id = ca.unique_id "
    "WHERE x IS NOT NULL GROUP BY 1 UNION ALL SELECT tr.unique_id, 'linear trend', sum(pow(y - a - b * x, 2)), count(*) FROM tr JOIN ct "
    "ON tr.unique_id = ct.unique_id GROUP BY 1)",
    "l AS (SELECT unique_id, model, n, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM s)",
    "SELECT unique_id, model, round(ll, 4) AS loglik, round(6 - 2 * ll, 4) AS aic, round(3 * ln(n) - 2 * ll, 4) AS bic, n FROM l"))
def h15_model_comparison(spark, sf_dir):
    return round_doubles(rg.model_comparison(panels.orders_monthly(spark, sf_dir)), 4)


@register("h14_auto_arma_order")
def h14_auto_arma_order(spark, sf_dir):
    """Order search on the monthly panel with D = 1, m = 12: all (p,0,q)(P,1,Q)[12] with p, q ≤ 2 and P, Q ≤ 1."""
    most = arima.Order(2, 0, 2, 1, 1, 1, 12)
    return arima.arma_grid_aic(panels.orders_monthly(spark, sf_dir), most, 6, best=True).select("unique_id", "order", "aic")


@register("h11_arma_hannan_rissanen")
def h11_arma_hannan_rissanen(spark, sf_dir):
    out = arima.hannan_rissanen(panels.events_daily(spark, sf_dir), arima.Order(1, 1, 1), long_ar=4)
    return out.select("unique_id", "order", "coef", "sigma2", "n")


def _centred(x: str, y: str) -> str:
    return f"covar_pop({x}, {y})"


def _ar1_exog_sql() -> str:
    """AR(1) and one exogenous column, both seasonally differenced: the two-regressor normal equations by covariances."""
    from panelspark.plans.q_forecast import _SPINE, _promo_sql

    a, b, ab = _centred("l", "l"), _centred("x", "x"), _centred("l", "x")
    det = f"({a} * {b} - {ab} * {ab})"
    phi = f"({_centred('w', 'l')} * {b} - {_centred('w', 'x')} * {ab}) / {det}"
    beta = f"({_centred('w', 'x')} * {a} - {_centred('w', 'l')} * {ab}) / {det}"
    return with_ctes(
        "orders_monthly", _SPINE, _promo_sql("sp"),
        f"j AS (SELECT o.unique_id, o.ds, y - lag(y, 12) OVER {W('').replace('unique_id', 'o.unique_id').replace('BY ds', 'BY o.ds')} AS w, "
        f"CAST(promo AS DOUBLE) - lag(CAST(promo AS DOUBLE), 12) OVER {W('').replace('unique_id', 'o.unique_id').replace('BY ds', 'BY o.ds')} AS x "
        "FROM orders_monthly o LEFT JOIN promo p ON o.ds = p.ds)",
        f"k AS (SELECT *, lag(w) OVER {W()} AS l FROM j)",
        "g AS (SELECT * FROM k WHERE w IS NOT NULL AND x IS NOT NULL AND l IS NOT NULL)",
        f"f AS (SELECT unique_id, {phi} AS phi, {beta} AS beta, avg(w) AS mw, avg(l) AS ml, avg(x) AS mx, count(*) AS n FROM g GROUP BY 1)",
        "SELECT unique_id, '(1,0,0)(0,1,0)[12]' AS \"order\", round(mw - phi * ml - beta * mx, 2) AS c, round(phi, 4) AS phi, "
        "round(beta, 2) AS beta, n FROM f")


@register("h12_arma_with_exog_promo", _ar1_exog_sql())
def h12_arma_with_exog_promo(spark, sf_dir):
    """AR(1) with the promo flag as regressor, series and flag seasonally differenced alike (D = 1, m = 12)."""
    from panelspark.plans.q_forecast import _promo_calendar

    p = panels.orders_monthly(spark, sf_dir).join(_promo_calendar(spark, sf_dir), "ds", "left")
    out = arima.hannan_rissanen(p, arima.Order(1, 0, 0, 0, 1, 0, 12), exog=("promo",))
    return round_doubles(out.select("unique_id", "order", F.col("coef")[0].alias("c"), F.col("coef")[1].alias("phi"),
                                    F.col("coef")[2].alias("beta"), "n"), 2, {"phi": 4})


@register("h15_model_comparison_ship_daily", with_ctes(
    "ship_daily",
    f"ar AS (SELECT unique_id, y, lag(y) OVER {W()} AS x FROM ship_daily)",
    f"tr AS (SELECT unique_id, y, CAST(row_number() OVER {W()} AS DOUBLE) AS x FROM ship_daily)",
    "ca AS (SELECT unique_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ar GROUP BY 1)",
    "ct AS (SELECT unique_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM tr GROUP BY 1)",
    "s AS (SELECT ar.unique_id, 'AR(1)' AS model, sum(pow(y - a - b * x, 2)) AS ssr, count(*) AS n FROM ar JOIN ca ON ar.unique_id = ca.unique_id "
    "WHERE x IS NOT NULL GROUP BY 1 UNION ALL SELECT tr.unique_id, 'linear trend', sum(pow(y - a - b * x, 2)), count(*) FROM tr JOIN ct "
    "ON tr.unique_id = ct.unique_id GROUP BY 1)",
    "l AS (SELECT unique_id, model, n, -n / 2 * (ln(2 * pi()) + ln(ssr / n) + 1) AS ll FROM s)",
    "SELECT unique_id, model, round(ll, 4) AS loglik, round(6 - 2 * ll, 4) AS aic, round(3 * ln(n) - 2 * ll, 4) AS bic, n FROM l"))
def h15_model_comparison_ship_daily(spark, sf_dir):
    return round_doubles(rg.model_comparison(panels.ship_daily(spark, sf_dir)), 4)


@register("h11_arima_forecast_bounds")
def h11_arima_forecast_bounds(spark, sf_dir):
    """ARIMA(1,1,1) on the daily event panel: 7-day forecasts with 80 % and 95 % bounds."""
    f = arima.arima_forecast(panels.events_daily(spark, sf_dir), arima.Order(1, 1, 1), 7, "D", long_ar=4, levels=(80, 95))
    return round_doubles(f, 4)


@register("h11_seasonal_arima_forecast")
def h11_seasonal_arima_forecast(spark, sf_dir):
    """(1,1,1)(1,1,1)[12] on the monthly panel, 12 months with 95 % bounds."""
    f = arima.arima_forecast(panels.orders_monthly(spark, sf_dir), arima.Order(1, 1, 1, 1, 1, 1, 12), 12, "ME", long_ar=4)
    return round_doubles(f, 2)


def _seasonal_walk_sql() -> str:
    return with_ctes(
        "orders_monthly", f"w AS (SELECT *, y - lag(y, 12) OVER {W()} AS z, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS back FROM orders_monthly)",
        "c AS (SELECT unique_id, avg(z) AS c, count(z) AS n, var_samp(z) AS s2, max(ds) AS mx FROM w GROUP BY 1)",
        "SELECT c.unique_id, CAST(k AS INTEGER) AS step, CAST(last_day(date_trunc('month', mx) + to_months(CAST(k AS INTEGER))) AS TIMESTAMP) AS ds, "
        "round(y + c * (1 + (k - 1) // 12), 2) AS yhat, round(y + c * (1 + (k - 1) // 12) - 1.959963984540054 * sqrt(s2 * (1 + (k - 1) // 12)), 2) AS lo_95, "
        "round(y + c * (1 + (k - 1) // 12) + 1.959963984540054 * sqrt(s2 * (1 + (k - 1) // 12)), 2) AS hi_95, '(0,0,0)(0,1,0)[12]' AS \"order\" "
        "FROM c, range(1, 25) t(k) JOIN w ON w.back = 12 - (k - 1) % 12 WHERE w.unique_id = c.unique_id")


@register("h11_seasonal_walk_forecast", _seasonal_walk_sql())
def h11_seasonal_walk_forecast(spark, sf_dir):
    """(0,0,0)(0,1,0)[12] with drift, 24 months: the seasonal inverse and the bounds of two seasons ahead."""
    f = arima.arima_forecast(panels.orders_monthly(spark, sf_dir), arima.Order(D=1, m=12), 24, "ME")
    return round_doubles(f.withColumn("step", F.col("step").cast("int")), 2)



@register("h12_forecast_with_future_promo")
def h12_forecast_with_future_promo(spark, sf_dir):
    """AR(1) + promo flag, both seasonally differenced, on the monthly panel, 12 months ahead with the known future promo calendar (A5 + B4)."""
    from panelspark.plans.q_forecast import _promo_calendar

    cal = _promo_calendar(spark, sf_dir).withColumn("promo", F.col("promo").cast("double"))
    p = panels.orders_monthly(spark, sf_dir).join(cal, "ds", "left")
    f = arima.arima_forecast(p, arima.Order(1, 0, 0, 0, 1, 0, 12), 12, "ME", exog=("promo",), future_exog=cal)
    return round_doubles(f, 2)


@register("h14_auto_arima_forecast")
def h14_auto_arima_forecast(spark, sf_dir):
    """Per-series best ARIMA(p,1,q), p,q ≤ 2, on the daily event panel; 7-day forecasts with 95 % bounds."""
    return round_doubles(arima.auto_arima_forecast(panels.events_daily(spark, sf_dir), 7, "D", arima.Order(2, 1, 2), 4), 4)


def _trend_intervals_sql(h: int = 12, windows: int = 4, levels=(80, 95)) -> str:
    """Trend lines refitted at each origin, their errors pooled by step, percentiles of the symmetric pools."""
    bounds = ", ".join(f"round(f.a + f.b * x + quantile_{side}_{level}, 2) AS yhat_{side}_{level}"
                       for level in levels for side in ("lo", "hi"))
    quantiles = ", ".join(f"quantile_cont(s, {(100 + sign * level) / 200}) AS quantile_{side}_{level}"
                          for level in levels for side, sign in (("lo", -1), ("hi", 1)))
    return with_ctes(
        "orders_monthly", f"t AS (SELECT unique_id, ds, y, CAST(row_number() OVER {W()} AS DOUBLE) AS x, "
        "count(*) OVER (PARTITION BY unique_id) AS n FROM orders_monthly)",
        f"o AS (SELECT t.*, i, n - {windows * h} + i * {h} AS o FROM t, range({windows}) g(i))",
        "k AS (SELECT unique_id, i, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM o WHERE x <= o GROUP BY 1, 2)",
        "e AS (SELECT o.unique_id, CAST(x - o AS INTEGER) AS step, abs(y - a - b * x) AS e FROM o JOIN k ON o.unique_id = k.unique_id "
        f"AND o.i = k.i WHERE x > o AND x <= o + {h})",
        f"q AS (SELECT unique_id, step, {quantiles} FROM (SELECT unique_id, step, unnest([e, -e]) AS s FROM e) GROUP BY 1, 2)",
        "f AS (SELECT unique_id, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, max(n) AS n, max(ds) AS mx FROM t GROUP BY 1)",
        f"u AS (SELECT f.*, CAST(k AS INTEGER) AS step, n + k AS x FROM f, range(1, {h + 1}) r(k))",
        "SELECT f.unique_id, CAST(last_day(date_trunc('month', mx) + to_months(f.step)) AS TIMESTAMP) AS ds, f.step, "
        f"round(f.a + f.b * x, 2) AS yhat, {bounds} FROM u f JOIN q ON f.unique_id = q.unique_id AND f.step = q.step")


@register("h9_trend_intervals", _trend_intervals_sql())
def h9_trend_intervals(spark, sf_dir):
    """Trend lines per series, 12 months ahead, with conformal bounds from four windows of twelve months."""
    p = panels.orders_monthly(spark, sf_dir)
    n = p.groupBy("unique_id").agg(F.count("*").alias("n"))
    ahead = panels.future_frame(p, 12, "ME").join(n, "unique_id").withColumns(
        {"one": F.lit(1.0), "trend": (F.col("n") + F.col("step")).cast("double"), "step": F.col("step").cast("int")})
    return round_doubles(rg.linear_intervals(_trend(p), ahead, ["one", "trend"], "y", 12, 4, (80, 95)), 2)


@register("h9_family_intervals")
def h9_family_intervals(spark, sf_dir):
    """Linear and ridge, lasso and elastic-net models on trend and Fourier terms, with conformal bounds of four windows."""
    d, xcols = _fourier_design(spark, sf_dir)
    d = cut_lineage(d)  # read by every member of the family
    steps = F.row_number().over(wn.series_window()).cast("int")
    hist, ahead = d.filter(~F.col("is_future")), d.filter("is_future").withColumn("step", steps)
    out = None
    for name, kw in {"linear": {}, "ridge": {"method": "ridge", "alpha": 1.0}, "lasso": {"method": "lasso", "alpha": 0.1},
                     "elastic": {"method": "elastic", "alpha": 0.1}}.items():
        one = rg.linear_intervals(hist, ahead, xcols, "y", 12, 4, (95,), name=name, **kw)
        out = one if out is None else out.join(one, ["unique_id", "ds", "step"])
    return out


@register("h10_huber_per_series")
def h10_huber_per_series(spark, sf_dir):
    """Robust regression of each monthly series on trend and Fourier terms, forecasting 12 months."""
    d, xcols = _fourier_design(spark, sf_dir)
    d = cut_lineage(d)  # read by the fit and the forecast
    fits = rg.fit_huber(d.filter(~F.col("is_future")), ["unique_id"], xcols, "y")
    ahead = rg.predict_linear(d.filter("is_future"), fits, ["unique_id"], xcols, "huber")
    return ahead.select("unique_id", "ds", "huber").join(fits.select("unique_id", "scale", "n_outliers", "converged"), "unique_id")


def _kpss_sql(most: int = 30) -> str:
    """Partial sums by a window, autocovariances by a join of each row with the one k rows on."""
    return with_ctes(
        "events_daily", f"e AS (SELECT unique_id, y - avg(y) OVER (PARTITION BY unique_id) AS e, row_number() OVER {W()} AS r, "
        "count(*) OVER (PARTITION BY unique_id) AS n FROM events_daily)",
        "s AS (SELECT unique_id, sum(e) OVER (PARTITION BY unique_id ORDER BY r) AS s FROM e)",
        "t AS (SELECT unique_id, sum(s * s) AS s2 FROM s GROUP BY 1)",
        "l AS (SELECT unique_id, any_value(n) AS n, CAST(floor(4 * pow(any_value(n) / 100.0, 0.25)) AS INTEGER) AS lags FROM e GROUP BY 1)",
        f"g AS (SELECT a.unique_id, k, sum(a.e * b.e) AS g FROM e a, range(0, {most}) q(k) JOIN e b ON b.r = a.r + k "
        "WHERE b.unique_id = a.unique_id GROUP BY 1, 2)",
        "v AS (SELECT g.unique_id, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lags + 1)) * g END) / any_value(n) AS v FROM g JOIN l "
        "ON g.unique_id = l.unique_id WHERE k <= lags GROUP BY 1)",
        "SELECT l.unique_id, l.n, l.lags, round(s2 / (n * n) / v, 6) AS kpss FROM l JOIN t ON l.unique_id = t.unique_id "
        "JOIN v ON l.unique_id = v.unique_id")


@register("h14_kpss", _kpss_sql())
def h14_kpss(spark, sf_dir):
    """The level-stationarity statistic that chooses d, by chunks of 50 rows."""
    return round_doubles(arima.kpss(panels.events_daily(spark, sf_dir), chunk_rows=50), 6)


@register("h14_chosen_differences")
def h14_chosen_differences(spark, sf_dir):
    """d and D of each monthly series (m = 12)."""
    return arima.choose_differences(panels.orders_monthly(spark, sf_dir), 12)


@register("h14_auto_order_forecast")
def h14_auto_order_forecast(spark, sf_dir):
    """(p,d,q)(P,D,Q)[12] with d and D chosen for each monthly series, 12 months ahead."""
    most = arima.Order(1, 2, 1, 1, 1, 0, 12)
    return round_doubles(arima.auto_order_forecast(panels.orders_monthly(spark, sf_dir), 12, "ME", most, 4), 2)


@register("h19_family_search")
def h19_family_search(spark, sf_dir):
    """The best of linear, ridge, lasso and elastic net (eleven settings) for each monthly series, by three windows of a year."""
    d, xcols = _fourier_design(spark, sf_dir)
    return rg.family_search(d.filter(~F.col("is_future")), xcols, "y", 12, 3).drop("coef")
