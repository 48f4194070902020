"""Further closed-form / brute-force checks: sources, PACF, quantiles, chunking, recursion, search, sampling."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF001, panel_df
from panelspark.functions import chunking
from panelspark.operators import explore, forecast as fc, regression as rg, relational as rel, windows as wn
from panelspark.sources import tables


def _frame(spark, series: dict, freq="D"):
    rows = []
    for uid, ys in series.items():
        ds = pd.date_range("2020-01-01", periods=len(ys), freq=freq)
        rows += [(uid, d.to_pydatetime(), float(v)) for d, v in zip(ds, ys)]
    return panel_df(spark, rows)


def test_read_series_csv(spark):
    d = tempfile.mkdtemp(prefix="csv-")
    p = os.path.join(d, "s.csv")
    pd.DataFrame({"ds": ["2024-01-01", "2024-01-02"], "y": [1.5, 2.5]}).to_csv(p, index=False)
    df = tables.read_series_csv(spark, p)
    assert df.dtypes == [("unique_id", "string"), ("ds", "timestamp_ntz"), ("y", "double")]
    assert [r.y for r in df.orderBy("ds").collect()] == [1.5, 2.5]


def test_read_series_csv_by_name(spark, tmp_path):
    p = str(tmp_path / "s.csv")
    pd.DataFrame({"note": ["x", "z"], "y": [1.5, 2.5], "unique_id": ["a", "b"], "ds": ["2024-01-01", "2024-01-02"]}).to_csv(p, index=False)
    assert [(r.unique_id, r.y) for r in tables.read_series_csv(spark, p).orderBy("ds").collect()] == [("a", 1.5), ("b", 2.5)]


def test_range_count(spark):
    assert spark.range(1_000_000).count() == 1_000_000


def test_pacf_of_ar1_vanishes_after_lag_one(spark):
    rng = np.random.default_rng(11)
    e = rng.normal(size=5000)
    y = np.zeros(5000)
    for t in range(1, 5000):
        y[t] = 0.7 * y[t - 1] + e[t]
    p = explore.pacf(explore.acf(_frame(spark, {"a": y}), nlags=10)).orderBy("lag").toPandas()["pacf"].to_numpy()
    assert abs(p[1] - 0.7) < 0.05 and np.all(np.abs(p[2:]) < 0.05)


def test_exact_percentiles_match_numpy_on_a_skewed_key(spark):
    rng = np.random.default_rng(4)
    big = pd.DataFrame({"k": "hot", "v": rng.normal(size=20000)})
    small = pd.DataFrame({"k": "cold", "v": rng.normal(size=7)})
    df = spark.createDataFrame(pd.concat([big, small])).repartition(16)
    got = {r.k: r for r in rel.exact_percentiles(df, ["k"], "v", [0.1, 0.5, 0.99], ["a", "b", "c"]).collect()}
    for k, g in (("hot", big), ("cold", small)):
        want = np.quantile(g["v"], [0.1, 0.5, 0.99])
        assert np.allclose([got[k].a, got[k].b, got[k].c], want, rtol=0, atol=1e-12)


def test_chunked_windows_equal_plain_windows(spark):
    rng = np.random.default_rng(8)
    df = _frame(spark, {"a": rng.normal(size=500), "b": rng.normal(size=37)}, freq="h")
    plain = wn.moving_average(wn.add_lags(df, [1, 5, 20]), 9).orderBy("unique_id", "ds").toPandas()
    ch = chunking.chunked(df, lambda d: wn.moving_average(wn.add_lags(d, [1, 5, 20]), 9), back=20, fwd=4,
                          chunk_rows=25, time_bucket="day").orderBy("unique_id", "ds").toPandas()
    pd.testing.assert_frame_equal(plain[ch.columns], ch)


def test_ar_recursion_from_given_coefficients(spark):
    df = _frame(spark, {"a": [1.0, 2.0, 4.0]})
    coefs = spark.createDataFrame([("a", [1.0, 0.5, 0.25])], "unique_id string, coef array<double>")
    got = rg.ar_forecast(df, coefs, 3, 2).orderBy("step").toPandas()["yhat"].tolist()
    h = [2.0, 4.0]
    for _ in range(3):
        h.append(1.0 + 0.5 * h[-1] + 0.25 * h[-2])
    assert np.allclose(got, h[2:])


def test_cross_validation_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=60).cumsum()
    cv = fc.cross_validation(_frame(spark, {"a": y}), 5, 3, 7).orderBy("ds").toPandas()
    n, rows = 60, []
    for i in range(3):
        c = n - 5 - (2 - i) * 5
        tr = y[:c]
        for k in range(1, 6):
            rows.append((tr[-1], tr[c - 7 + (k - 1) % 7], tr.mean(), tr[-1] + k * (tr[-1] - tr[0]) / (c - 1)))
    want = np.array(rows)
    assert np.allclose(cv[["Naive", "SeasonalNaive", "HistoricAverage", "RandomWalkWithDrift"]].to_numpy(), want)


def test_ridge_alpha_search_picks_small_alpha_for_clean_data(spark):
    t = np.arange(1, 81, dtype=float)  # row_number is 1-based
    y = 5 + 0.3 * t + np.sin(2 * np.pi * t / 12)
    df = _frame(spark, {"a": y}).withColumns({"one": F.lit(1.0), "t": F.row_number().over(wn.series_window()).cast("double"),
                                              "s": F.sin(2 * np.pi * F.row_number().over(wn.series_window()) / 12)})
    r = rg.ridge_alpha_search(df, ["one", "t", "s"], "y", 10, 3, alphas=(0.0, 100.0)).first()
    assert r.alpha == 0.0 and r.cv_rmse < 1e-6


def test_random_distinct_dates(spark):
    o = spark.read.parquet(f"{SF001}/orders.parquet").select(F.to_date("o_orderdate").alias("d"))
    a = [r.d for r in rel.random_distinct(o, "d", 5, 1).collect()]
    assert a == sorted(a) and len(set(a)) == 5
    assert a == [r.d for r in rel.random_distinct(o, "d", 5, 1).collect()]
    with pytest.raises(ValueError):
        rel.random_distinct(o.limit(3), "d", 10, 1)


def test_qq_points_of_normal_sample_have_unit_slope(spark):
    rng = np.random.default_rng(12)
    q = explore.qq_points(_frame(spark, {"a": rng.normal(size=2000)}), "y").first()
    assert abs(q.slope - 1) < 0.05 and abs(q.intercept) < 0.05


def test_theta_on_a_line_continues_the_line(spark):
    t = np.arange(1, 61, dtype=float)
    y = 10 + 2 * t + np.random.default_rng(1).normal(scale=1e-3, size=60)
    f = rg.theta_forecast(_frame(spark, {"a": y}, freq="ME"), 3, "ME").orderBy("step").toPandas()
    # Theta = mean of the regression line (slope b) and SES of the θ=2 line (flat at y_n): slope b/2 from y_n
    assert np.allclose(f["Theta"], y[-1] + 1.0 * f["step"], atol=0.05)
    assert np.all((f["alpha"] >= 0) & (f["alpha"] <= 1))


@pytest.mark.parametrize("model", ["additive", "multiplicative"])
def test_chunked_decomposition_equals_windowed(spark, model):
    rng = np.random.default_rng(21)
    y = 50 + np.tile(rng.normal(size=12), 20) + rng.normal(size=240).cumsum() * 0.1
    df = _frame(spark, {"a": y, "b": y[:40] + 1.0}, freq="h")
    a = explore.decompose(df, 12, model).orderBy("unique_id", "ds").toPandas()
    b = explore.decompose(df, 12, model, chunk_rows=13).orderBy("unique_id", "ds").toPandas()
    pd.testing.assert_frame_equal(a[b.columns], b, check_exact=False, rtol=1e-9, atol=1e-9)


def test_bucketed_index_equals_windowed(spark):
    rng = np.random.default_rng(22)
    df = _frame(spark, {"a": rng.normal(size=300), "b": rng.normal(size=5)}, freq="h")
    a = fc.index_series(df).orderBy("unique_id", "ds").toPandas()
    b = fc.index_series(df, "day").orderBy("unique_id", "ds").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-12, atol=1e-12)


def test_chunked_fill_gaps_and_bucketed_split_equal_plain(spark):
    from panelspark.sources import panels

    rng = np.random.default_rng(23)
    days = pd.date_range("2020-01-01", periods=400, freq="D")
    keep = rng.random(400) < 0.6
    rows = [("a", d.to_pydatetime(), float(v)) for d, v, k in zip(days, rng.normal(size=400), keep) if k]
    rows += [("b", days[3].to_pydatetime(), 1.0), ("b", days[9].to_pydatetime(), 2.0)]
    df = panel_df(spark, rows)
    a = panels.fill_gaps(df, "D").orderBy("unique_id", "ds").toPandas()
    b = panels.fill_gaps(df, "D", chunk_rows=17, time_bucket="month").orderBy("unique_id", "ds").toPandas()
    pd.testing.assert_frame_equal(a, b[a.columns])
    s1 = wn.train_test_flag(df, 0.8).orderBy("unique_id", "ds").toPandas()
    s2 = wn.train_test_flag(df, 0.8, time_bucket="month").orderBy("unique_id", "ds").toPandas()
    pd.testing.assert_frame_equal(s1, s2[s1.columns])


@pytest.mark.parametrize("op", ["acf", "cv", "flags", "percentiles"])
def test_results_do_not_depend_on_row_order_or_partitioning(spark, op):
    from panelspark.operators import anomaly

    rng = np.random.default_rng(40)
    df = _frame(spark, {"a": rng.normal(size=120).cumsum(), "b": rng.normal(size=90)})
    shuffled = df.repartition(7).sortWithinPartitions(F.rand(3))
    fns = {"acf": lambda d: explore.acf(d, nlags=20),
           "cv": lambda d: fc.cross_validation(d, 5, 3, 7),
           "flags": lambda d: anomaly.detect_anomalies(d).select("unique_id", "ds", "ma_anomaly", "decomp_anomaly",
                                                                  "zscore_anomaly", "anomaly_count"),
           "percentiles": lambda d: rel.exact_percentiles(d, ["unique_id"], "y", [0.1, 0.5, 0.9])}
    a = fns[op](df).toPandas()
    b = fns[op](shuffled).toPandas()
    keys = [c for c in ("unique_id", "ds", "lag") if c in a.columns]
    a = a.sort_values(keys).reset_index(drop=True)
    b = b.sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, rtol=1e-9, atol=1e-9)


def test_conformal_intervals_collapse_on_a_perfectly_seasonal_series(spark):
    season = np.array([5.0, 1.0, 3.0, 8.0, 2.0, 6.0, 4.0])
    df = _frame(spark, {"s": np.tile(season, 10)})
    cv = fc.cross_validation(df, 7, 3, 7, models=["SeasonalNaive"])
    f = fc.forecast_with_step(df, 7, "D", 7, ["SeasonalNaive"])
    out = fc.conformal_intervals(cv, f, ["SeasonalNaive"], (80, 95)).orderBy("step").toPandas()
    assert np.allclose(out["SeasonalNaive"], season)
    for L in (80, 95):
        assert np.allclose(out[f"SeasonalNaive_lo_{L}"], season) and np.allclose(out[f"SeasonalNaive_hi_{L}"], season)


def test_stratified_split_leaves_rows_where_they_are(spark):
    """A class of nearly all rows stays in many partitions; the classes' thresholds travel instead."""
    from panelspark.operators import customer as cu

    rows = [(i, int(i % 50 == 0) if i % 7 else None) for i in range(2000)]
    df = spark.createDataFrame(rows, "CustomerID long, flag int").repartition(8, "CustomerID")
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    old = [spark.conf.get(k) for k in keys]
    for k, v in zip(keys, ("-1", "false")):
        spark.conf.set(k, v)
    try:
        got = cu.split(df, "CustomerID", 0.8, 42, stratify="flag").withColumn("part", F.spark_partition_id()).toPandas()
    finally:
        for k, v in zip(keys, old):
            spark.conf.set(k, v)
    assert len(got) == 2000 and got[got["flag"] == 0]["part"].nunique() == 8
    share = got.dropna(subset=["flag"]).groupby("flag")["is_train"].apply(lambda x: x.astype(bool).mean())
    assert all(abs(share - 0.8) < 0.05) and got[got["flag"].isna()]["is_train"].isna().all()
