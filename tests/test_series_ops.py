"""Closed-form checks of the series operators."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import panel_df
from panelspark.operators import explore, windows as wn
from panelspark.sources import panels


def _frame(spark, series: dict, start="2020-01-01", freq="D"):
    rows = []
    for uid, ys in series.items():
        ds = pd.date_range(start, periods=len(ys), freq=freq)
        rows += [(uid, d.to_pydatetime(), float(v)) for d, v in zip(ds, ys)]
    return panel_df(spark, rows)


def test_savgol_keeps_a_cubic(spark):
    t = np.arange(60, dtype=float)
    y = 0.01 * t ** 3 - 0.5 * t ** 2 + 3 * t + 7
    out = wn.savgol(_frame(spark, {"c": y}), 11, 3).orderBy("ds").toPandas()
    assert np.allclose(out["savgol"], y, atol=1e-7)


def test_acf_of_a_sine_peaks_at_the_period(spark):
    t = np.arange(240)
    y = np.sin(2 * np.pi * t / 12)
    a = explore.acf(_frame(spark, {"s": y}), nlags=40)
    peaks = explore.acf_peaks(a).orderBy("rank").toPandas()
    assert int(peaks["lag"].iloc[0]) == 12
    got = a.orderBy("lag").toPandas()["acf"].to_numpy()
    yc = y - y.mean()
    want = [1.0] + [np.sum(yc[k:] * yc[:-k]) / np.sum(yc * yc) for k in range(1, 41)]
    assert np.allclose(got, want, atol=1e-12)


def test_decomposition_of_trend_plus_season_has_zero_residual(spark):
    t = np.arange(84)
    season = np.tile([3.0, -1.0, 0.5, -2.5, 1.0, -1.0, 0.0], 12)
    y = 2.0 + 0.5 * t + season
    d = explore.decompose(_frame(spark, {"a": y}), 7).orderBy("ds").toPandas()
    inner = d.dropna(subset=["resid"])
    assert len(inner) == 84 - 6
    assert np.allclose(inner["resid"], 0, atol=1e-9)
    assert np.allclose(d["seasonal"].to_numpy()[:7], season[:7] - season[:7].mean(), atol=1e-9)


def test_even_period_trend_weights(spark):
    y = np.arange(48, dtype=float) ** 1.5
    d = explore.decompose(_frame(spark, {"a": y}), 12).orderBy("ds").toPandas()
    i = 20
    want = (0.5 * y[i - 6] + y[i - 5:i + 6].sum() + 0.5 * y[i + 6]) / 12
    assert math.isclose(d["trend"].iloc[i], want, rel_tol=1e-12)


def test_difference_then_undifference_is_identity(spark):
    rng = np.random.default_rng(1)
    y = np.cumsum(rng.normal(size=40)) + 50
    df = _frame(spark, {"r": y})
    hist = df.filter(F.col("ds") < F.lit("2020-01-31").cast("timestamp_ntz"))
    fut = wn.difference(df, 1).filter(F.col("ds") >= F.lit("2020-01-31").cast("timestamp_ntz"))
    back = wn.undifference(fut, hist, 1).orderBy("ds").toPandas()
    assert np.allclose(back["y"], y[30:], atol=1e-9)
    # seasonal lag 7 as well
    fut7 = wn.difference(df, 1, lag=7).filter(F.col("ds") >= F.lit("2020-01-31").cast("timestamp_ntz"))
    back7 = wn.undifference(fut7, hist, 7).orderBy("ds").toPandas()
    assert np.allclose(back7["y"], y[30:], atol=1e-9)


def test_fill_gaps_and_build_panel(spark):
    raw = spark.createDataFrame([("a", "2024-01-01 00:03:00", 1.0), ("a", "2024-01-01 00:31:00", 2.0),
                                 ("a", "2024-01-01 01:02:00", 4.0)], "k string, t string, v double") \
               .withColumn("t", F.col("t").cast("timestamp_ntz"))
    p = panels.build_panel(raw, "k", "t", "v", "15min")
    f = panels.fill_gaps(p, "15min").orderBy("ds").toPandas()
    assert f["y"].tolist() == [1.0, 0.0, 2.0, 0.0, 4.0]
    m = panels.fill_gaps(panels.build_panel(raw.withColumn("t", F.add_months("t", 0).cast("timestamp_ntz")), "k", "t", "v", "ME"), "ME")
    assert m.count() == 1


def test_frequency_inference(spark):
    daily = _frame(spark, {"d": np.ones(10)})
    monthly = _frame(spark, {"m": np.ones(10)}, freq="ME")
    quarterly = _frame(spark, {"q": np.ones(10)}, freq="QE")
    hourly = _frame(spark, {"h": np.ones(10)}, freq="h")
    u = daily.unionByName(monthly).unionByName(quarterly).unionByName(hourly)
    got = {r.unique_id: r.freq for r in explore.infer_frequency(u).collect()}
    assert got == {"d": "D", "m": "M", "q": "Q", "h": "Unknown"}


def test_repartitioning_does_not_change_results(spark):
    rng = np.random.default_rng(3)
    df = _frame(spark, {"a": rng.normal(size=50), "b": rng.normal(size=50)})
    a = explore.decompose(df, 7).orderBy("unique_id", "ds").toPandas()
    b = explore.decompose(df.repartition(7).sortWithinPartitions(F.rand(1)), 7).orderBy("unique_id", "ds").toPandas()
    pd.testing.assert_frame_equal(a, b)


def test_auto_differences_where_no_series_has_a_period(spark):
    """Constant series have no ACF peak: a row each, without season or strength; an empty panel gives no rows."""
    flat = _frame(spark, {"five": np.full(60, 5.0), "zero": np.zeros(60)})
    rows = {r["unique_id"]: r for r in explore.auto_differences(flat).collect()}
    assert set(rows) == {"five", "zero"}
    assert all((r["season_length"], r["strength"], r["seasonal_diff"], r["diffs"]) == (None, None, False, 0) for r in rows.values())
    assert explore.auto_differences(flat.where("false")).count() == 0
