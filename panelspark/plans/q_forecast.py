"""Forecast, evaluation, scenario and signal queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.util import round_doubles
from panelspark.operators import backtest as bt
from panelspark.operators import evaluate as ev
from panelspark.operators import forecast as fc
from panelspark.operators import relational as rel
from panelspark.plans.registry import register
from panelspark.plans.sqlkit import W, with_ctes
from panelspark.sources import panels
from panelspark.sources.tables import read_table

MODELS = list(fc.BASELINES)
# fixed values: promotion dates used by the scenario queries (a user-supplied list in the reference)
PROMO_DATES = ["1996-11-15", "1997-06-01", "1998-11-20", "1999-12-05", "2000-06-10", "2001-11-25", "2002-06-15",
               "2002-11-29", "2003-06-01"]
UW = "(PARTITION BY unique_id)"


# ---------------------------------------------------------------- SQL generators for the oracle side

def _idx(src: str, out: str = "idx") -> str:
    run = W("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return (f"{out} AS (SELECT unique_id, ds, y, row_number() OVER {W()} - 1 AS pos, count(*) OVER {UW} AS n, "
            f"avg(y) OVER {run} AS cm, first_value(y) OVER {run} AS fv FROM {src})")


def _predict(targets: str, m: int, models=MODELS, idx: str = "idx") -> str:
    cols = {"Naive": "a.y AS Naive", "SeasonalNaive": "s.y AS SeasonalNaive", "HistoricAverage": "a.cm AS HistoricAverage",
            "RandomWalkWithDrift": "a.y + t.step * ((a.y - a.fv) / NULLIF(CAST(t.c - 1 AS DOUBLE), 0)) AS RandomWalkWithDrift"}
    return (f"SELECT t.*, a.ds AS cutoff, {', '.join(cols[x] for x in models)} FROM {targets} t "
            f"LEFT JOIN {idx} a ON a.unique_id = t.unique_id AND a.pos = t.c - 1 "
            f"LEFT JOIN {idx} s ON s.unique_id = t.unique_id AND s.pos = t.c - {m} + (t.step - 1) % {m} "
            f"AND t.c - {m} + (t.step - 1) % {m} >= 0")


def _cv_ctes(src: str, h: int, w: int, m: int, models=MODELS, out: str = "cv", step: int | None = None) -> list[str]:
    step = step or h
    return [_idx(src, f"{out}_idx"),
            f"{out}_t AS (SELECT unique_id, ds, y, pos, n - {h} - ({w - 1} - f) * {step} AS c FROM {out}_idx, range({w}) r(f) "
            f"WHERE pos >= n - {h} - {(w - 1) * step})",
            f"{out}_t2 AS (SELECT unique_id, ds, y, c, pos - c + 1 AS step FROM {out}_t WHERE pos >= c AND pos < c + {h} AND c > 0)",
            f"{out} AS ({_predict(out + '_t2', m, models, out + '_idx')})"]


def _future_ctes(src: str, h: int, m: int, freq_sql: str, models=MODELS, out: str = "fut") -> list[str]:
    return [_idx(src, f"{out}_idx"),
            f"{out}_t AS (SELECT unique_id, CAST({freq_sql} AS TIMESTAMP) AS ds, CAST(k AS INTEGER) AS step, n AS c FROM "
            f"(SELECT unique_id, max(ds) AS mx, max(n) AS n FROM {out}_idx GROUP BY 1), range(1, {h + 1}) r(k))",
            f"{out} AS ({_predict(out + '_t', m, models, out + '_idx')})"]


ME_STEP = "last_day(date_trunc('month', mx) + to_months(k))"
D_STEP = "mx + to_days(CAST(k AS INTEGER))"


def _sel(models, digits=4, extra=()):
    return ", ".join([*extra, *[f"round({x}, {digits}) AS {x}" for x in models]])


# ---------------------------------------------------------------- baselines, CV, merges

@register("h_forecast_baselines", with_ctes("orders_monthly", *_future_ctes("orders_monthly", 12, 12, ME_STEP),
                                            f"SELECT unique_id, ds, {_sel(MODELS, 2)} FROM fut"))
def h_forecast_baselines(spark, sf_dir):
    f = fc.forecast_baselines(panels.orders_monthly(spark, sf_dir), 12, "ME", 12)
    return round_doubles(f, 2)


@register("h6_cross_validation", with_ctes("events_hourly", *_cv_ctes("events_hourly", 24, 3, 24),
                                           f"SELECT unique_id, ds, cutoff, CAST(step AS INTEGER) AS step, round(y, 4) AS y, {_sel(MODELS)} FROM cv"))
def h6_cross_validation(spark, sf_dir):
    cv = fc.cross_validation(panels.events_hourly(spark, sf_dir), 24, 3, 24)
    return round_doubles(cv.withColumn("step", F.col("step").cast("int")), 4)


@register("h6_cross_validation_bucketed", with_ctes("events_hourly", *_cv_ctes("events_hourly", 24, 3, 24),
                                                    f"SELECT unique_id, ds, cutoff, CAST(step AS INTEGER) AS step, round(y, 4) AS y, {_sel(MODELS)} FROM cv"))
def h6_cross_validation_bucketed(spark, sf_dir):
    """H6 with skew-safe indexing (per-day buckets: no window over a whole series)."""
    cv = fc.cross_validation(panels.events_hourly(spark, sf_dir), 24, 3, 24, time_bucket="day")
    return round_doubles(cv.withColumn("step", F.col("step").cast("int")), 4)


@register("b12_rename_model_columns", with_ctes("events_hourly", *_cv_ctes("events_hourly", 24, 3, 24),
                                                "SELECT unique_id, ds, cutoff, " + ", ".join(f"round({x}, 4) AS {x}_cv" for x in MODELS) + " FROM cv"))
def b12_rename_model_columns(spark, sf_dir):
    cv = fc.cross_validation(panels.events_hourly(spark, sf_dir), 24, 3, 24)
    r = cv.withColumnsRenamed({x: f"{x}_cv" for x in MODELS})
    return round_doubles(r.select("unique_id", "ds", "cutoff", *[f"{x}_cv" for x in MODELS]), 4)


_TRAIN7 = f"tr AS (SELECT unique_id, ds, y FROM (SELECT *, row_number() OVER {W()} AS r, count(*) OVER {UW} AS n FROM events_daily) WHERE r <= n - 7)"
_TEST7 = f"te AS (SELECT unique_id, ds, y FROM (SELECT *, row_number() OVER {W()} AS r, count(*) OVER {UW} AS n FROM events_daily) WHERE r > n - 7)"


def _split7(spark, sf_dir):
    p = panels.events_daily(spark, sf_dir)
    w = Window.partitionBy("unique_id")
    d = p.withColumns({"__r": F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")), "__n": F.count("*").over(w)})
    return (d.filter(F.col("__r") <= F.col("__n") - 7).select("unique_id", "ds", "y"),
            d.filter(F.col("__r") > F.col("__n") - 7).select("unique_id", "ds", "y"))


@register("c1_predictions_vs_actuals", with_ctes(
    "events_daily", _TRAIN7, _TEST7, *_future_ctes("tr", 7, 7, D_STEP),
    "SELECT f.unique_id, f.ds, round(te.y, 4) AS y, round(f.SeasonalNaive, 4) AS SeasonalNaive, round(te.y - f.SeasonalNaive, 4) AS error "
    "FROM fut f LEFT JOIN te ON f.unique_id = te.unique_id AND f.ds = te.ds"))
def c1_predictions_vs_actuals(spark, sf_dir):
    train, test = _split7(spark, sf_dir)
    f = fc.forecast_baselines(train, 7, "D", 7, ["SeasonalNaive"])
    j = f.join(test, ["unique_id", "ds"], "left")
    return round_doubles(j.select("unique_id", "ds", "y", "SeasonalNaive", (F.col("y") - F.col("SeasonalNaive")).alias("error")), 4)


@register("c2_full_outer_merge", with_ctes(
    "events_daily", _TRAIN7, *_future_ctes("tr", 7, 7, D_STEP),
    f"SELECT unique_id, ds, {_sel(MODELS)} FROM fut"))
def c2_full_outer_merge(spark, sf_dir):
    train, _ = _split7(spark, sf_dir)
    tables = [fc.forecast_baselines(train, 7, "D", 7, [m]) for m in MODELS]
    return round_doubles(fc.merge_forecasts(tables), 4)


_A, _B = ["Naive", "SeasonalNaive"], ["HistoricAverage", "RandomWalkWithDrift"]


@register("c3_inner_merge_cv", with_ctes(
    "events_hourly", *_cv_ctes("events_hourly", 24, 3, 24, _A, "cva"), *_cv_ctes("events_hourly", 24, 3, 24, _B, "cvb"),
    "SELECT a.unique_id, a.ds, a.cutoff, round(a.y, 4) AS y, round(a.Naive, 4) AS Naive, round(a.SeasonalNaive, 4) AS SeasonalNaive, "
    "round(b.HistoricAverage, 4) AS HistoricAverage, round(b.RandomWalkWithDrift, 4) AS RandomWalkWithDrift FROM cva a JOIN cvb b "
    "ON a.unique_id = b.unique_id AND a.ds = b.ds AND a.cutoff = b.cutoff"))
def c3_inner_merge_cv(spark, sf_dir):
    p = panels.events_hourly(spark, sf_dir)
    a = fc.cross_validation(p, 24, 3, 24, models=_A).drop("step")
    b = fc.cross_validation(p, 24, 3, 24, models=_B).drop("step", "y")
    return round_doubles(a.join(b, ["unique_id", "ds", "cutoff"], "inner"), 4)


# ---------------------------------------------------------------- promo calendar, scenario

def _promo_sql(src_spine: str) -> str:
    vals = ", ".join(f"(DATE '{d}')" for d in PROMO_DATES)
    return (f"pm AS (SELECT DISTINCT date_trunc('month', d) AS m FROM (VALUES {vals}) v(d)), "
            f"promo AS (SELECT s.ds, CAST(CASE WHEN pm.m IS NULL THEN 0 ELSE 1 END AS INTEGER) AS promo FROM {src_spine} s "
            f"LEFT JOIN pm ON date_trunc('month', s.ds) = pm.m)")


_SPINE = ("sp AS (SELECT CAST(last_day(m) AS TIMESTAMP) AS ds FROM (SELECT UNNEST(generate_series(date_trunc('month', min(o_orderdate)), "
          "date_trunc('month', max(o_orderdate)) + INTERVAL 24 MONTH, INTERVAL 1 MONTH)) AS m FROM orders))")


def _promo_calendar(spark, sf_dir):
    spine = panels.calendar_spine(read_table(spark, sf_dir, "orders", ["o_orderdate"]), "o_orderdate", 24)
    return fc.promo_flag(spine, PROMO_DATES)


@register("b4_promo_month_flag", f"WITH {_SPINE}, {_promo_sql('sp')} SELECT ds, promo FROM promo")
def b4_promo_month_flag(spark, sf_dir):
    return _promo_calendar(spark, sf_dir)


@register("c4_join_different_keys", with_ctes("orders_monthly", _SPINE, _promo_sql("sp"),
                                              "SELECT o.unique_id, o.ds, round(o.y, 2) AS y, p.promo FROM orders_monthly o LEFT JOIN "
                                              "(SELECT ds AS date, promo FROM promo) p ON o.ds = p.date"))
def c4_join_different_keys(spark, sf_dir):
    cal = _promo_calendar(spark, sf_dir).withColumnRenamed("ds", "date")
    o = panels.orders_monthly(spark, sf_dir)
    j = o.join(F.broadcast(cal), o.ds == cal.date, "left")  # the calendar is months-of-data + 24 rows
    return round_doubles(j.select("unique_id", "ds", "y", "promo"), 2)


@register("h26_promo_scenario", with_ctes(
    "orders_monthly", _SPINE, _promo_sql("sp"), *_future_ctes("orders_monthly", 24, 12, ME_STEP, ["SeasonalNaive"]),
    "s AS (SELECT f.unique_id, f.ds, f.SeasonalNaive AS base, f.SeasonalNaive * (1 + 0.1 * p.promo) AS with_promo, p.promo "
    "FROM fut f JOIN promo p ON f.ds = p.ds)",
    "SELECT unique_id, ds, round(base, 2) AS base, round(with_promo, 2) AS with_promo, round(with_promo - base, 2) AS difference, "
    "round((with_promo - base) / NULLIF(base, 0) * 100, 4) AS pct FROM s WHERE promo = 1"))
def h26_promo_scenario(spark, sf_dir):
    f = fc.forecast_baselines(panels.orders_monthly(spark, sf_dir), 24, "ME", 12, ["SeasonalNaive"])
    cal = _promo_calendar(spark, sf_dir)
    s = f.join(cal, "ds").select("unique_id", "ds", F.col("SeasonalNaive").alias("base"),
                                 fc.uplift("SeasonalNaive", "promo", 0.1).alias("with_promo"), "promo")
    s = s.filter("promo = 1").select("unique_id", "ds", "base", "with_promo", (F.col("with_promo") - F.col("base")).alias("difference"),
                                     (F.try_divide(F.col("with_promo") - F.col("base"), F.col("base")) * 100).alias("pct"))
    return round_doubles(s, 2, {"pct": 4})


@register("h26_promo_scenario_mape", with_ctes(
    "orders_monthly", _SPINE, _promo_sql("sp"), *_future_ctes("orders_monthly", 24, 12, ME_STEP, ["SeasonalNaive"]),
    "b AS (SELECT unique_id, ds, y AS base, 'history' AS part FROM orders_monthly UNION ALL "
    "SELECT unique_id, ds, SeasonalNaive, 'horizon' FROM fut)",
    "s AS (SELECT b.*, base * (1 + 0.1 * p.promo) AS with_promo FROM b JOIN promo p ON b.ds = p.ds)",
    "SELECT unique_id, part, count(*) AS months, round(avg(abs(with_promo - base) / NULLIF(abs(base), 0)) * 100, 4) AS mape, "
    "round(sum(with_promo - base), 2) AS difference FROM s GROUP BY 1, 2"))
def h26_promo_scenario_mape(spark, sf_dir):
    """The scenario over history and horizon: mean absolute percentage and total difference with and without promotion."""
    o = panels.orders_monthly(spark, sf_dir)
    f = fc.forecast_baselines(o, 24, "ME", 12, ["SeasonalNaive"])
    b = o.select("unique_id", "ds", F.col("y").alias("base"), F.lit("history").alias("part")).unionByName(
        f.select("unique_id", "ds", F.col("SeasonalNaive").alias("base"), F.lit("horizon").alias("part")))
    s = b.join(_promo_calendar(spark, sf_dir), "ds").withColumn("with_promo", fc.uplift("base", "promo", 0.1))
    diff = F.col("with_promo") - F.col("base")
    out = s.groupBy("unique_id", "part").agg(F.count("*").alias("months"), (F.avg(F.try_divide(
        F.abs(diff), F.abs("base"))) * 100).alias("mape"), F.sum(diff).alias("difference"))
    return round_doubles(out, 2, {"mape": 4})


@register("e2_stack_history_forecast", with_ctes("orders_monthly", *_future_ctes("orders_monthly", 12, 12, ME_STEP, ["SeasonalNaive"]),
                                                 "SELECT unique_id, ds, round(y, 2) AS y, NULL::DOUBLE AS SeasonalNaive FROM orders_monthly "
                                                 "UNION ALL SELECT unique_id, ds, NULL, round(SeasonalNaive, 2) FROM fut"))
def e2_stack_history_forecast(spark, sf_dir):
    p = panels.orders_monthly(spark, sf_dir)
    f = fc.forecast_baselines(p, 12, "ME", 12, ["SeasonalNaive"])
    return round_doubles(rel.stack([p, f]), 2)


# ---------------------------------------------------------------- evaluation

_METRICS = ("avg(abs(e)) AS mae, avg(e * e) AS mse, sqrt(avg(e * e)) AS rmse, avg(abs(e) / NULLIF(abs(y), 0)) AS mape, "
            "avg(abs(e) / NULLIF(abs(y) + abs(yhat), 0)) AS smape")
_MROUND = "round(mae, 4) AS mae, round(mse, 4) AS mse, round(rmse, 4) AS rmse, round(mape, 6) AS mape, round(smape, 6) AS smape"


def _long_sql(src: str, keys: str) -> str:
    return f"lg AS (SELECT {keys}, y, model, yhat, yhat - y AS e FROM (UNPIVOT {src} ON {', '.join(MODELS)} INTO NAME model VALUE yhat))"


@register("h22_metrics", with_ctes(
    "events_hourly", *_cv_ctes("events_hourly", 24, 1, 24), _long_sql("cv", "unique_id"),
    f"sc AS (SELECT unique_id, avg(abs(y - l)) AS scale FROM (SELECT unique_id, y, lag(y, 24) OVER {W()} AS l FROM "
    f"(SELECT *, row_number() OVER {W()} AS r, count(*) OVER {UW} AS n FROM events_hourly) WHERE r <= n - 24) GROUP BY 1)",
    f"m AS (SELECT unique_id, model, {_METRICS} FROM lg GROUP BY 1, 2)",
    f"SELECT m.unique_id, model, {_MROUND}, round(mae / NULLIF(scale, 0), 6) AS mase FROM m LEFT JOIN sc ON m.unique_id = sc.unique_id"))
def h22_metrics(spark, sf_dir):
    p = panels.events_hourly(spark, sf_dir)
    ho = fc.holdout(p, 24, 24)
    n = F.count("*").over(Window.partitionBy("unique_id"))
    hist = p.withColumns({"__r": F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")), "__n": n}) \
            .filter(F.col("__r") <= F.col("__n") - 24).select("unique_id", "ds", "y")
    m = ev.evaluate(ho, MODELS, history=hist, season_length=24)
    return round_doubles(m, 4, {"mape": 6, "smape": 6, "mase": 6})


@register("h23_fold_scores", with_ctes(
    "events_hourly", *_cv_ctes("events_hourly", 24, 3, 24), _long_sql("cv", "unique_id, cutoff"),
    "f AS (SELECT unique_id, model, cutoff, sqrt(avg(e * e)) AS rmse, avg(abs(e) / NULLIF(abs(y), 0)) AS mape FROM lg GROUP BY 1, 2, 3)",
    "SELECT unique_id, model, round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std, round(avg(mape), 6) AS mape_mean, "
    "round(stddev_pop(mape), 6) AS mape_std, count(*) AS folds FROM f GROUP BY 1, 2"))
def h23_fold_scores(spark, sf_dir):
    cv = fc.cross_validation(panels.events_hourly(spark, sf_dir), 24, 3, 24)
    return round_doubles(ev.fold_scores(cv, MODELS), 4, {"mape_mean": 6, "mape_std": 6})


@register("h24_custom_loss", with_ctes(
    "events_hourly", *_cv_ctes("events_hourly", 24, 3, 24), _long_sql("cv", "unique_id"),
    f"SELECT model, {_MROUND.replace('(mae', '(avg_mae')}, round(wape, 6) AS wape FROM (SELECT model, {_METRICS}, "
    "sum(abs(e)) / NULLIF(sum(abs(y)), 0) AS wape FROM lg GROUP BY 1) t".replace("round(avg_mae", "round(mae")))
def h24_custom_loss(spark, sf_dir):
    cv = fc.cross_validation(panels.events_hourly(spark, sf_dir), 24, 3, 24)
    m = ev.evaluate(cv, MODELS, keys=(), losses={"wape": ev.wape})
    return round_doubles(m, 4, {"mape": 6, "smape": 6, "wape": 6})


# ---------------------------------------------------------------- conformal intervals

_CM = ["Naive", "SeasonalNaive"]


def _conformal_sql(panel="orders_monthly", h=12, w=4, m=12, step_sql=ME_STEP, levels=(80, 95), models=tuple(_CM)):
    qs = ", ".join(f"quantile_cont(z, {(100 - L) / 200!r}) AS lo{L}, quantile_cont(z, {(100 + L) / 200!r}) AS hi{L}" for L in levels)
    body = [
        "sc AS (SELECT unique_id, step, model, z FROM (SELECT unique_id, step, model, abs(y - yhat) AS s FROM "
        f"(UNPIVOT cv ON {', '.join(models)} INTO NAME model VALUE yhat)), LATERAL (SELECT UNNEST([s, -s]) AS z))",
        f"q AS (SELECT unique_id, step, model, {qs} FROM sc GROUP BY 1, 2, 3)",
        f"fl AS (SELECT unique_id, ds, step, model, yhat FROM (UNPIVOT fut ON {', '.join(models)} INTO NAME model VALUE yhat))",
        "j AS (SELECT fl.*, " + ", ".join(f"yhat + lo{L} AS lo_{L}, yhat + hi{L} AS hi_{L}" for L in levels) + " FROM fl "
        "LEFT JOIN q ON fl.unique_id = q.unique_id AND fl.step = q.step AND fl.model = q.model)",
    ]
    cols = []
    for mdl in models:
        cols.append(f"round(max(yhat) FILTER (WHERE model = '{mdl}'), 2) AS {mdl}")
        for L in levels:
            cols.append(f"round(max(lo_{L}) FILTER (WHERE model = '{mdl}'), 2) AS {mdl}_lo_{L}")
            cols.append(f"round(max(hi_{L}) FILTER (WHERE model = '{mdl}'), 2) AS {mdl}_hi_{L}")
    return with_ctes(panel, *_cv_ctes(panel, h, w, m, list(models)), *_future_ctes(panel, h, m, step_sql, list(models)),
                     *body, f"SELECT unique_id, ds, step, {', '.join(cols)} FROM j GROUP BY unique_id, ds, step")


H_STEP = "mx + to_hours(CAST(k AS BIGINT))"


@register("h4_conformal_one_step_hourly", _conformal_sql("events_hourly", 1, 10, 24, H_STEP, (99,)))
def h4_conformal_one_step_hourly(spark, sf_dir):
    """The replay's setting: 10 one-step backtest windows, level 99, next-hour intervals."""
    p = panels.events_hourly(spark, sf_dir)
    cv = fc.cross_validation(p, 1, 10, 24, models=_CM)
    f = fc.forecast_with_step(p, 1, "h", 24, _CM)
    out = fc.conformal_intervals(cv, f, _CM, (99,))
    return round_doubles(out.withColumn("step", F.col("step").cast("int")), 2)


@register("h4_conformal_intervals", _conformal_sql())
def h4_conformal_intervals(spark, sf_dir):
    p = panels.orders_monthly(spark, sf_dir)
    cv = fc.cross_validation(p, 12, 4, 12, models=_CM)
    f = fc.forecast_with_step(p, 12, "ME", 12, _CM)
    out = fc.conformal_intervals(cv, f, _CM, (80, 95))
    return round_doubles(out.withColumn("step", F.col("step").cast("int")), 2)


# ---------------------------------------------------------------- signals and breaches

def _band_sql():
    return [f"bd0 AS (SELECT *, row_number() OVER {W()} AS pos, count(*) OVER {UW} AS n, abs(y - lag(y, 24) OVER {W()}) AS err, "
            f"lag(y, 23) OVER {W()} AS next_pred FROM events_hourly)",
            "bq AS (SELECT unique_id, quantile_cont(err, 0.9) AS q FROM bd0 WHERE pos <= floor(n * 0.8) GROUP BY 1)",
            "bd AS (SELECT bd0.*, next_pred - q AS lower, next_pred + q AS upper FROM bd0 LEFT JOIN bq ON bd0.unique_id = bq.unique_id)"]


@register("i1_trade_signals", with_ctes(
    "events_hourly", *_band_sql(),
    "SELECT unique_id, ds, round(y, 4) AS y, round(next_pred, 4) AS next_pred, round(lower, 4) AS lower, round(upper, 4) AS upper, "
    "CASE WHEN row_number() OVER (PARTITION BY unique_id, CAST(ds AS DATE) ORDER BY ds) <= 11 THEN 'HOLD' "
    "WHEN y < lower AND next_pred > y THEN 'BUY' WHEN y > upper AND next_pred < y THEN 'SELL' "
    "ELSE 'HOLD' END AS signal FROM bd"))
def i1_trade_signals(spark, sf_dir):
    b = bt.seasonal_one_step_band(panels.events_hourly(spark, sf_dir), 24, 0.9, 0.8)
    s = bt.signals(b)
    return round_doubles(s.select("unique_id", "ds", "y", "next_pred", "lower", "upper", "signal"), 4)


@register("g7_interval_breach", with_ctes(
    "events_hourly", *_band_sql(),
    f"SELECT unique_id, ds, COALESCE(lead(y) OVER {W()} < lower OR lead(y) OVER {W()} > upper, false) AS breach FROM bd"))
def g7_interval_breach(spark, sf_dir):
    b = bt.breach(bt.seasonal_one_step_band(panels.events_hourly(spark, sf_dir), 24, 0.9, 0.8))
    return b.select("unique_id", "ds", "breach")


# ---------------------------------------------------------------- I2 / I3 (rows-only; the fold is pinned by pytest)

def _fold_sql(extra_body: str, extra_ctes=()) -> str:
    sig = ("sg AS (SELECT unique_id, ds, y, CAST(ds AS DATE) AS session, row_number() OVER (PARTITION BY unique_id, CAST(ds AS DATE) ORDER BY ds) AS rn, "
           "next_pred, CASE WHEN row_number() OVER (PARTITION BY unique_id, CAST(ds AS DATE) ORDER BY ds) <= 11 THEN 'HOLD' WHEN y < lower AND next_pred > y THEN 'BUY' WHEN y > upper AND next_pred < y THEN 'SELL' "
           "ELSE 'HOLD' END AS signal FROM bd)")

    def step(cash, shares):
        buy = f"(s.signal = 'BUY' AND {cash} > s.y AND s.y > 0)"
        sell = f"(s.signal = 'SELL' AND {shares} > 0)"
        return (f"CASE WHEN {buy} THEN {cash} - floor({cash} / s.y) * s.y WHEN {sell} THEN {cash} + s.y * {shares} ELSE {cash} END",
                f"CASE WHEN {buy} THEN {shares} + floor({cash} / s.y) WHEN {sell} THEN 0.0 ELSE {shares} END",
                f"CASE WHEN {buy} THEN 'BUY' WHEN {sell} THEN 'SELL' ELSE 'HOLD' END")

    c0, s0, a0 = step("10000.0", "0.0")
    c1, s1, a1 = step("r.cash", "r.shares")
    rec = (f"fold(unique_id, session, rn, ds, y, signal, action, cash, shares) AS ("
           f"SELECT s.unique_id, s.session, s.rn, s.ds, s.y, s.signal, {a0}, {c0}, {s0} FROM sg s WHERE s.rn = 1 UNION ALL "
           f"SELECT s.unique_id, s.session, s.rn, s.ds, s.y, s.signal, {a1}, {c1}, {s1} FROM fold r JOIN sg s "
           f"ON s.unique_id = r.unique_id AND s.session = r.session AND s.rn = r.rn + 1)")
    body = with_ctes("events_hourly", *_band_sql(), sig, rec, *extra_ctes, extra_body)
    return "WITH RECURSIVE " + body[len("WITH "):]


@register("i2_position_fold", _fold_sql(
    "SELECT unique_id, strftime(session, '%Y-%m-%d') AS session, ds, round(y, 4) AS y, signal, action, round(cash, 4) AS cash, "
    "round(shares, 4) AS shares, round(cash + shares * y, 4) AS value FROM fold"))
def i2_position_fold(spark, sf_dir):
    s = bt.signals(bt.seasonal_one_step_band(panels.events_hourly(spark, sf_dir), 24, 0.9, 0.8))
    f = bt.position_fold(s).withColumn("session", F.date_format("session", "yyyy-MM-dd"))
    return round_doubles(f, 4)


@register("i3_backtest_summary", _fold_sql(
    "SELECT fs.unique_id, strftime(fs.session, '%Y-%m-%d') AS session, round(final_value, 4) AS final_value, trades, buys, sells, "
    "round((final_value - 10000.0) / 10000.0 * 100, 4) AS total_return_pct, round(mae, 4) AS mae, round(rmse, 4) AS rmse "
    "FROM fs LEFT JOIN em ON fs.unique_id = em.unique_id AND fs.session = em.session",
    ["fs AS (SELECT unique_id, session, max_by(cash + shares * y, ds) AS final_value, CAST(sum(CASE WHEN action <> 'HOLD' THEN 1 ELSE 0 END) AS BIGINT) AS trades, "
     "CAST(sum(CASE WHEN action = 'BUY' THEN 1 ELSE 0 END) AS BIGINT) AS buys, CAST(sum(CASE WHEN action = 'SELL' THEN 1 ELSE 0 END) AS BIGINT) AS sells FROM fold GROUP BY 1, 2)",
     f"er AS (SELECT unique_id, CAST(ds AS DATE) AS session, lead(y) OVER {W()} - next_pred AS e FROM bd)",
     "em AS (SELECT unique_id, session, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse FROM er GROUP BY 1, 2)"]))
def i3_backtest_summary(spark, sf_dir):
    b = bt.seasonal_one_step_band(panels.events_hourly(spark, sf_dir), 24, 0.9, 0.8)
    s = bt.signals(b)
    out = bt.summary(bt.position_fold(s), b).withColumn("session", F.date_format("session", "yyyy-MM-dd"))
    return round_doubles(out, 4)



# ---------------------------------------------------------------- B13 report strings: money, percent, interval

@register("b13_report_strings", with_ctes(
    "orders_monthly", *_future_ctes("orders_monthly", 12, 12, ME_STEP, ["SeasonalNaive"]),
    "SELECT unique_id, strftime(ds, '%Y-%m') AS month, printf('$%.2f', round(SeasonalNaive, 2)) AS forecast, "
    "printf('[%.2f, %.2f]', round(SeasonalNaive * 0.9, 2), round(SeasonalNaive * 1.1, 2)) AS band, "
    "printf('%.2f%%', round(100.0 * SeasonalNaive / sum(SeasonalNaive) OVER (PARTITION BY ds), 2)) AS share FROM fut"))
def b13_report_strings(spark, sf_dir):
    """Forecast report lines: money, a ±10 % interval string and each segment's share of the month (values are
    rounded half-up first, so the text never depends on a formatter's tie rule)."""
    from panelspark.functions.util import rnd

    f = fc.forecast_baselines(panels.orders_monthly(spark, sf_dir), 12, "ME", 12, ["SeasonalNaive"])
    share = 100.0 * F.col("SeasonalNaive") / F.sum("SeasonalNaive").over(Window.partitionBy("ds"))
    return f.select("unique_id", F.date_format("ds", "yyyy-MM").alias("month"),
                    F.format_string("$%.2f", rnd("SeasonalNaive", 2)).alias("forecast"),
                    F.format_string("[%.2f, %.2f]", rnd(F.col("SeasonalNaive") * 0.9, 2),
                                    rnd(F.col("SeasonalNaive") * 1.1, 2)).alias("band"),
                    F.format_string("%.2f%%", rnd(share, 2)).alias("share"))
