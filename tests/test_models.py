"""Models and detectors checked against brute force / closed forms on small frames."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import panel_df
from panelspark.functions.linalg import norm_ppf
from panelspark.operators import anomaly, arima, backtest as bt, regression as rg


def _frame(spark, series: dict, freq="D"):
    rows = []
    for uid, ys in series.items():
        ds = pd.date_range("2020-01-01", periods=len(ys), freq=freq)
        rows += [(uid, d.to_pydatetime(), float(v)) for d, v in zip(ds, ys)]
    return panel_df(spark, rows)


def test_adf_random_walk_vs_white_noise(spark):
    rng = np.random.default_rng(0)
    df = _frame(spark, {"rw": np.cumsum(rng.normal(size=300)), "wn": rng.normal(size=300)})
    r = {x.unique_id: x for x in rg.adf(df).collect()}
    assert not r["rw"].stationary and r["rw"].p_value > 0.1
    assert r["wn"].stationary and r["wn"].p_value < 0.01


def test_fit_linear_matches_numpy_and_ridge_shrinks(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=200)
    y = 3 + 2 * x + rng.normal(scale=0.1, size=200)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "one": 1.0, "x": x, "y": y}))
    c = rg.fit_linear(df, ["k"], ["one", "x"], "y").first().coef
    want = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)[0]
    assert np.allclose(c, want, atol=1e-10)
    r = rg.fit_linear(df, ["k"], ["one", "x"], "y", method="ridge", alpha=1000.0).first().coef
    assert abs(r[1]) < abs(c[1])
    las = rg.fit_linear(df, ["k"], ["one", "x"], "y", method="lasso", alpha=10.0).first().coef
    assert las[1] == 0.0


def test_model_comparison_loglik(spark):
    rng = np.random.default_rng(5)
    y = np.cumsum(rng.normal(size=100))
    r = rg.model_comparison(_frame(spark, {"a": y})).filter("model = 'AR(1)'").first()
    X = np.c_[np.ones(99), y[:-1]]
    b = np.linalg.lstsq(X, y[1:], rcond=None)[0]
    ssr = np.sum((y[1:] - X @ b) ** 2)
    ll = -99 / 2 * (math.log(2 * math.pi) + math.log(ssr / 99) + 1)
    assert math.isclose(r.loglik, ll, rel_tol=1e-9)
    assert math.isclose(r.aic, 6 - 2 * ll, rel_tol=1e-9)


def test_isolation_forest_and_kernel_novelty_flag_the_spike(spark):
    rng = np.random.default_rng(7)
    y = rng.normal(size=400)
    y[123] = 15.0
    df = _frame(spark, {"a": y})
    iso = anomaly.isolation_forest(df, n_trees=50).orderBy(F.desc("iso_score")).first()
    assert iso.ds == pd.Timestamp("2020-01-01") + pd.Timedelta(days=123)
    assert iso.iso_forest_anomaly
    nov = anomaly.kernel_novelty(df).filter(F.col("ds") == F.lit("2020-05-03").cast("timestamp_ntz")).first()
    assert nov.svm_anomaly
    share = anomaly.kernel_novelty(df).agg(F.avg(F.col("svm_anomaly").cast("double"))).first()[0]
    assert abs(share - 0.1) < 0.02


def test_inverse_normal():
    from math import erfc, sqrt
    p = np.array([1e-6, 0.01, 0.3, 0.5, 0.9, 0.999])
    x = norm_ppf(p)
    assert np.allclose([0.5 * erfc(-v / sqrt(2)) for v in x], p, rtol=1e-9, atol=1e-12)


def test_hand_computed_portfolio(spark):
    rows = [("a", f"2024-01-01 0{i}:00:00", p, s) for i, (p, s) in
            enumerate([(100.0, "BUY"), (90.0, "BUY"), (120.0, "SELL"), (50.0, "SELL"), (60.0, "BUY")])]
    df = spark.createDataFrame(rows, "unique_id string, ds string, y double, signal string") \
              .withColumn("ds", F.col("ds").cast("timestamp_ntz"))
    f = bt.position_fold(df, 1000.0).orderBy("ds").toPandas()
    # 1000 → buy 10 @100 (cash 0); BUY @90 not executable; SELL @120 → 1200; SELL with no shares; BUY 20 @60
    assert f["action"].tolist() == ["BUY", "HOLD", "SELL", "HOLD", "BUY"]
    assert f["cash"].tolist() == [0.0, 0.0, 1200.0, 1200.0, 0.0]
    assert f["shares"].tolist() == [10.0, 10.0, 0.0, 0.0, 20.0]
    assert f["value"].tolist() == [1000.0, 900.0, 1200.0, 1200.0, 1200.0]


def test_arima_forecast_matches_closed_form_ar1(spark):
    rng = np.random.default_rng(31)
    y = np.zeros(400)
    for t in range(1, 400):
        y[t] = 2.0 + 0.8 * y[t - 1] + rng.normal()
    df = _frame(spark, {"a": y})
    f = arima.arima_forecast(df, arima.Order(1), 5, "D", long_ar=4, levels=(95,)).orderBy("step").toPandas()
    fit = rg.fit_ar(df, 1).first()
    c, phi = fit.coef
    want, v = [], y[-1]
    for _ in range(5):
        v = c + phi * v
        want.append(v)
    assert np.allclose(f["yhat"], want, atol=1e-9)
    sd = np.sqrt(fit.sigma2 * np.cumsum([phi ** (2 * j) for j in range(5)]))
    assert np.allclose(f["hi_95"] - f["yhat"], 1.959963985 * sd, rtol=1e-6)


def test_arima_forecast_uses_future_exog(spark):
    rng = np.random.default_rng(32)
    n = 300
    x = (rng.random(n + 5) < 0.3).astype(float)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 1.0 + 0.5 * y[t - 1] + 4.0 * x[t] + rng.normal(scale=0.1)
    ds = pd.date_range("2020-01-01", periods=n + 5, freq="D")
    df = spark.createDataFrame(pd.DataFrame({"unique_id": "a", "ds": ds[:n], "y": y, "x": x[:n]}))
    fut = spark.createDataFrame(pd.DataFrame({"ds": ds[n:], "x": x[n:]}))
    f = arima.arima_forecast(df, arima.Order(1), 5, "D", exog=("x",), future_exog=fut).orderBy("step").toPandas()
    c, phi, b = rg.fit_linear(rg.ar_design(df, 1).withColumn("one", F.lit(1.0)), ["unique_id"], ["one", "ar1", "x"], "y").first().coef
    v, want = y[-1], []
    for t in range(5):
        v = c + phi * v + b * x[n + t]
        want.append(v)
    assert abs(b - 4.0) < 0.1 and np.allclose(f["yhat"], want, atol=1e-9)


def test_conformal_halfwidths_table(spark):
    from panelspark.operators import ml

    sc = spark.createDataFrame([("a", i, float(i)) for i in range(11)] + [("b", 0, 2.0)], "unique_id string, window int, score double")
    got = {r.unique_id: r.q for r in ml.conformal_halfwidths(sc, 0.9).collect()}
    assert got == {"a": 9.0, "b": 2.0}


def test_auto_arima_uses_the_aic_best_order(spark):
    rng = np.random.default_rng(41)
    y = np.zeros(500)
    for t in range(1, 500):
        y[t] = 0.85 * y[t - 1] + rng.normal()
    df = _frame(spark, {"a": y})
    f = arima.auto_arima_forecast(df, 4, "D", arima.Order(2, 0, 1), 6).toPandas()
    grid = arima.arma_grid_aic(df, arima.Order(2, 0, 1), 6).toPandas()
    best = grid.sort_values("aic", kind="stable").iloc[0]
    assert len(f) == 4 and set(f["order"]) == {f"({best.p},0,{best.q})"}
    assert np.all(f["lo_95"] < f["yhat"]) and np.all(f["yhat"] < f["hi_95"])


def _arima_by_definition(y, x, order, coef, sigma2, ahead, h):
    """Forecast by iterating the differenced equation, with bounds from simulated unit shocks."""
    def diff(v):
        for lag in order.steps:
            v = v[lag:] - v[:-lag]
        return v

    def path(shock):
        full_y, full_x = list(y), np.concatenate([x, ahead])
        xw = diff(full_x)[-h:]
        for t in range(h):
            w = list(diff(np.array(full_y)))
            nxt = coef[0] + sum(c * w[-k] for c, k in zip(coef[1:], order.ar)) + coef[-1] * xw[t] + (shock if t == 0 else 0.0)
            probe = np.array([*full_y, 0.0])  # the level that makes the differenced value nxt
            full_y.append(nxt - diff(probe)[-1])
        return np.array(full_y[-h:])

    base = path(0.0)
    psi = path(1.0) - base
    return base, np.sqrt(sigma2 * np.cumsum(psi ** 2))


@pytest.mark.parametrize("order", [(1, 0, 0), (2, 1, 0), (1, 2, 0), (1, 1, 0, 1, 1, 0, 4), (0, 0, 0, 1, 2, 0, 3)])
def test_seasonal_arima_with_exog_equals_its_definition(spark, order):
    rng = np.random.default_rng(7)
    n, h, order = 160, 9, arima.Order(*order)
    x = rng.normal(size=n + h)
    y = np.cumsum(rng.normal(size=n)) + 5 * np.sin(np.arange(n) * 2 * np.pi / max(order.m, 4)) + 3 * x[:n]
    ds = pd.date_range("2024-01-01", periods=n + h)
    frame = spark.createDataFrame([("a", d.to_pydatetime(), float(v), float(w)) for d, v, w in zip(ds, y, x)],
                                  "unique_id string, ds timestamp_ntz, y double, x double")
    fut = spark.createDataFrame([(d.to_pydatetime(), float(w)) for d, w in zip(ds[n:], x[n:])], "ds timestamp_ntz, x double")
    fit = arima.hannan_rissanen(frame, order, exog=("x",)).first()
    got = arima.arima_forecast(frame, order, h, "D", exog=("x",), future_exog=fut).orderBy("step").toPandas()
    want, sd = _arima_by_definition(y, x[:n], order, list(fit["coef"]), fit["sigma2"], x[n:], h)
    assert np.allclose(got["yhat"], want, rtol=1e-8) and np.allclose(got["hi_95"] - got["yhat"], 1.959963985 * sd, rtol=1e-6)
    assert set(got["order"]) == {str(order)}


def test_arima_refuses_what_it_cannot_do(spark):
    df = _frame(spark, {"a": np.arange(30.0)}).withColumn("x", F.lit(1.0))
    with pytest.raises(ValueError):
        arima.arima_forecast(df, arima.Order(1, -1, 0), 3, "D")
    with pytest.raises(ValueError):
        arima.arima_forecast(df, arima.Order(P=1), 3, "D")
    with pytest.raises(ValueError):
        arima.arima_forecast(df, arima.Order(1), 3, "D", exog=("x",))
    few = spark.createDataFrame([("2024-01-31", 1.0)], "ds string, x double").withColumn("ds", F.to_timestamp_ntz("ds"))
    with pytest.raises(Exception, match="lacks a future value"):
        arima.arima_forecast(df, arima.Order(1), 3, "D", exog=("x",), future_exog=few).collect()
