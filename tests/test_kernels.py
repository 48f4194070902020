"""Percentiles and forest scores do not depend on partitioning, caching, ties or a hot key."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import anomaly
from panelspark.operators.relational import exact_percentiles
from panelspark.sources import panels

SF1 = "/root/testdata/sf0.1"


@pytest.fixture
def many_partitions(spark):
    keys = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("cached", [False, True])
def test_percentiles_equal_duckdb_over_many_partitions(many_partitions, duck, cached):
    p = panels.events_hourly(many_partitions, SF1)
    p = p.cache() if cached else p
    probs = [0.0, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {r[0]: list(r[1:]) for r in exact_percentiles(p, ["unique_id"], "y", probs, list("abcdef")).collect()}
    pdf = p.toPandas()
    assert len(got) == pdf["unique_id"].nunique()
    for uid, g in pdf.groupby("unique_id"):
        assert np.allclose(got[uid], np.quantile(g["y"], probs), rtol=1e-12)
    if cached:
        p.unpersist()


def test_percentiles_with_ties_skew_and_a_hot_key(many_partitions):
    rng = np.random.default_rng(0)
    rows = [("hot", float(x)) for x in np.exp(rng.normal(0, 4, 30_000))] + [("hot", 7.0)] * 20_000
    rows += [("one", 1.5)] + [("tied", 2.0)] * 999 + [("wide", x) for x in (-1e300, -1.0, 0.0, 1e-300, 1e300)]
    rows += [("none", None), ("big", 1e17), ("big", 1e17 + 64)]
    df = many_partitions.createDataFrame(rows, "k string, v double").repartition(16)
    probs = [0.01, 0.5, 0.75, 0.999]
    got = {r[0]: list(r[1:]) for r in exact_percentiles(df, ["k"], "v", probs, list("abcd")).collect()}
    assert set(got) == {"hot", "one", "tied", "wide", "big"}
    for k in got:
        want = np.quantile(np.array([v for kk, v in rows if kk == k]), probs)
        assert np.allclose(got[k], want, rtol=1e-9), k


@pytest.mark.parametrize("sketch", [10_000, 50])
def test_percentiles_of_heavy_tails_and_an_outlier(many_partitions, sketch):
    """Log-normal values and one huge one: the brackets follow ranks, so few values are left whatever the range."""
    rng = np.random.default_rng(1)
    rows = [("s2", float(x)) for x in np.exp(rng.normal(0, 2, 40_000))] + [("s2", 1e15)]
    rows += [("s3", float(x)) for x in np.exp(rng.normal(0, 3, 15_000))]
    rows += [("ties", float(x)) for x in rng.integers(0, 3, 20_000)] + [("inf", float("inf")), ("inf", 1.0), ("inf", float("-inf"))]
    df = many_partitions.createDataFrame(rows, "k string, v double").repartition(16)
    probs = [0.0, 0.001, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r[0]: list(r[1:]) for r in exact_percentiles(df, ["k"], "v", probs, list("abcdefg"), sketch).collect()}
    for k in ("s2", "s3", "ties"):
        assert np.allclose(got[k], np.quantile([v for kk, v in rows if kk == k], probs), rtol=1e-12), k
    assert got["inf"][0] == float("-inf") and got["inf"][3] == 1.0 and got["inf"][-1] == float("inf")


def test_percentiles_read_their_input_twice(spark):
    df = spark.read.parquet(f"{SF1}/events.parquet")
    plan = exact_percentiles(df, ["event_type"], "value", [0.25, 0.5, 0.75])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") <= 2 and plan.count("Exchange") <= 8


def _brute_scores(steps, panel, sample, n_trees):
    out = {}
    for uid, g in panel.groupby("unique_id"):
        s = steps[steps["unique_id"] == uid]
        norm = anomaly._c(min(sample, len(g)))
        for ds, y in zip(g["ds"], g["y"]):
            out[uid, ds] = 2.0 ** (-(s["delta"][s["b"] <= y].sum() / n_trees) / norm)
    return out


def test_isolation_scores_equal_brute_force_over_many_partitions(many_partitions):
    daily = panels.events_daily(many_partitions, SF1)
    for sample in (256, 16):
        got = anomaly.isolation_forest(daily, n_trees=25, sample=sample)
        steps = anomaly.forest_steps(daily, 25, sample).toPandas()
        want = _brute_scores(steps, daily.toPandas(), sample, 25)
        rows = got.toPandas()
        assert len(rows) == len(want) > 0
        assert np.allclose(rows["iso_score"], [want[k] for k in zip(rows["unique_id"], rows["ds"])])


def test_isolation_forest_on_constant_and_tiny_series(spark):
    rows = [("c", f"2024-01-{d:02d}", 3.0) for d in range(1, 20)] + [("t", "2024-01-01", 1.0), ("o", "2024-01-01", 0.0)]
    rows += [("s", f"2024-01-{d:02d}", 100.0 if d == 15 else float(d % 3)) for d in range(1, 29)]
    p = spark.createDataFrame(rows, "unique_id string, ds string, y double").withColumn("ds", F.to_timestamp_ntz("ds"))
    got = anomaly.isolation_forest(p).toPandas()
    assert len(got) == len(rows)
    s = got[got.unique_id == "s"]
    assert s.loc[s.iso_score.idxmax(), "y"] == 100.0
