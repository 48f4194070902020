"""Moments, robust regression and intervals against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.functions.linalg import Moments, gram
from panelspark.operators import regression as rg


def _lines(level, n=2000, seed=0, columns=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, columns)) + np.arange(n)[:, None] / 10
    return x, level + 0.5 * x.sum(axis=1) + rng.normal(size=n)


@pytest.mark.parametrize("columns", [1, 8])
@pytest.mark.parametrize("level", [0.0, 1e6, 1e8, 1e9])
def test_residual_sums_at_high_levels(spark, level, columns):
    x, y = _lines(level, columns=columns)
    names = [f"x{i}" for i in range(columns)]
    df = spark.createDataFrame([("a", 1.0, *map(float, r), float(v)) for r, v in zip(x, y)],
                               "k string, one double, " + ", ".join(f"{c} double" for c in names) + ", y double").repartition(7)
    got = rg.fit_linear(df, ["k"], ["one", *names], "y").first()
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(design, y - level, rcond=None)[0]  # the level is the intercept's
    ssr = float(((y - level - design @ beta) ** 2).sum())
    assert got.n == len(y) and np.isclose(got.ssr, ssr, rtol=1e-6)
    assert np.allclose(got.coef[1:], beta[1:], rtol=1e-6) and np.isclose(got.coef[0], level + beta[0], rtol=1e-9)


def test_moments_merge_like_one_pass():
    rng = np.random.default_rng(1)
    z, w = rng.normal(1e7, 1, (50, 4)), rng.uniform(0, 2, 50)
    none = np.zeros((50, 0))
    whole = Moments.over(z, w, none)
    cut = Moments.over(z[:0], w[:0], none[:0])
    for a, b in ((0, 1), (1, 20), (20, 50)):
        cut = cut.merge(Moments.over(z[a:b], w[a:b], none[a:b]))
    assert whole.n == cut.n and np.allclose(whole.mean, cut.mean, rtol=1e-14) and np.allclose(whole.c, cut.c, rtol=1e-6)


def test_moments_of_many_keys_and_null_keys(spark):
    rng = np.random.default_rng(2)
    rows = [(None if i % 7 == 0 else f"k{i % 40}", i % 3, *map(float, rng.normal(size=7))) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, s int, " + ", ".join(f"z{i} double" for i in range(7))).repartition(5)
    got = {(r.k, r.s): Moments.of(r) for r in gram(df, ["k", "s"], [f"z{i}" for i in range(6)], "z6").collect()}
    assert len(got) == len({r[:2] for r in rows})
    for key, m in got.items():
        z = np.array([r[2:] for r in rows if r[:2] == key])
        d = z - z.mean(axis=0)
        assert m.n == len(z) and np.allclose(m.mean, z.mean(axis=0)) and np.allclose(m.c, d.T @ d)


def test_weighted_ones_are_a_constant_column():
    rng = np.random.default_rng(6)
    for _ in range(50):
        z = np.column_stack([np.ones(97), rng.normal(1e6, 1, 97), rng.normal(size=97)])
        w = rng.uniform(0.01, 1, 97)
        m = Moments.over(z[:40], w[:40], np.zeros((40, 0))).merge(Moments.over(z[40:], w[40:], np.zeros((57, 0))))
        assert m.constant_first


def _huber(x, y, epsilon, alpha):
    """Numpy: the same minimum by iteration to the last digit."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    scale = np.sqrt(((y - design @ beta) ** 2).mean())
    for _ in range(5000):
        r = np.abs(y - design @ beta)
        beyond = r > epsilon * scale
        w = np.where(beyond, epsilon * scale / np.maximum(r, 1e-300), 1.0)
        ridge = np.diag([0.0] + [alpha * scale] * x.shape[1])
        beta = np.linalg.solve((design * w[:, None]).T @ design + ridge, (design * w[:, None]).T @ y)
        scale = np.sqrt((r[~beyond] ** 2).sum() / (len(y) - epsilon ** 2 * beyond.sum()))
    return beta, scale


def test_huber_per_series_equals_numpy(spark):
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for k, epsilon in (("a", 1.35), ("b", 1.35)):
        x = rng.normal(size=(150, 2)) + np.arange(150)[:, None] / 50
        y = 3 + x @ [2.0, -1.0] + rng.normal(size=150) * (0.3 if k == "a" else 0.6)
        y[::15] += 40.0
        want[k] = _huber(x, y, epsilon, 1e-4)
        rows += [(k, 1.0, *map(float, r), float(v)) for r, v in zip(x, y)]
    rows += [("exact", 1.0, float(i), float(i % 2), 5.0 + i) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, one double, x0 double, x1 double, y double").repartition(4)
    got = {r.k: r for r in rg.fit_huber(df, ["k"], ["one", "x0", "x1"], "y", max_iter=30).collect()}
    for k, (beta, scale) in want.items():
        assert got[k].converged and np.allclose(got[k].coef, beta, rtol=1e-3, atol=1e-3) and np.isclose(got[k].scale, scale, rtol=1e-3)
    assert got["a"].n_outliers >= 10 and len({r.rounds for r in got.values()}) > 1
    assert np.allclose(got["exact"].coef, [5.0, 1.0, 0.0], atol=1e-6)
    # the minimum is one: no direction lowers the loss
    x, y, k = np.array([r[1:4] for r in rows if r[0] == "b"]), np.array([r[4] for r in rows if r[0] == "b"]), got["b"]

    def loss(theta):
        r = (y - x @ theta[:3]) / theta[3]
        h = np.where(np.abs(r) <= 1.35, r ** 2, 2 * 1.35 * np.abs(r) - 1.35 ** 2)
        return (theta[3] * (1 + h)).sum() + 1e-4 * (theta[1:3] ** 2).sum()

    at = np.array([*k.coef, k.scale])
    assert all(loss(at) <= loss(at + step * np.eye(4)[i]) + 1e-4 for i in range(4) for step in (1e-2, -1e-2))


def test_linear_intervals_equal_refits(spark):
    rng = np.random.default_rng(4)
    rows, h, windows = [], 5, 4
    for k, n in (("a", 60), ("b", 43), ("short", 21)):
        rows += [(k, i, 1.0, float(i), float(np.sin(i)), float(2 * i + 3 * np.sin(i) + rng.normal() * 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "unique_id string, i int, one double, t double, s double, y double")
    df = df.withColumn("ds", F.expr("timestampadd(DAY, i, timestamp_ntz'2024-01-01')"))
    last = df.groupBy("unique_id").agg(F.max("i").alias("m"))
    fut = last.select("unique_id", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"), "m").select(
        "unique_id", "step", (F.col("m") + F.col("step")).alias("i")).withColumns(
        {"one": F.lit(1.0), "t": F.col("i").cast("double"), "s": F.sin("i"), "ds": F.expr("timestampadd(DAY, i, timestamp_ntz'2024-01-01')")})
    xs = ["one", "t", "s"]
    got = {(r.unique_id, r.step): r for r in rg.linear_intervals(df, fut, xs, "y", h, windows, (80,)).collect()}
    assert len(got) == 3 * h
    for k in ("a", "b", "short"):
        z = np.array([r[2:] for r in rows if r[0] == k])
        pools = {s: [] for s in range(1, h + 1)}
        for w in range(windows):
            o = len(z) - (windows - w) * h
            if o <= 3:
                continue
            beta = np.linalg.lstsq(z[:o, :3], z[:o, 3], rcond=None)[0]
            for s in range(h):
                pools[s + 1].append(abs(z[o + s, 3] - z[o + s, :3] @ beta))
        beta = np.linalg.lstsq(z[:, :3], z[:, 3], rcond=None)[0]
        for s in range(1, h + 1):
            i = len(z) - 1 + s
            yhat = np.array([1.0, i, np.sin(i)]) @ beta
            q = np.quantile([*pools[s], *[-x for x in pools[s]]], [0.1, 0.9]) if pools[s] else [np.nan] * 2
            r = got[k, s]
            assert np.isclose(r.yhat, yhat) and np.allclose([r.yhat_lo_80, r.yhat_hi_80], yhat + q)


@pytest.mark.parametrize("season", [None, 6])
def test_theta_by_chunks_equals_plain(spark, season):
    rng = np.random.default_rng(7)
    rows = [(k, i, float(level + 3 * np.sin(i) + rng.normal()))
            for k, n, level in (("a", 60, 0.0), ("b", 37, 1e7), ("one", 1, 5.0)) for i in range(n)]
    df = spark.createDataFrame(rows, "unique_id string, i int, y double")
    df = df.select("unique_id", F.expr("timestampadd(DAY, i, timestamp_ntz'2024-01-01')").alias("ds"), "y")
    plain, cut = (rg.theta_forecast(df, 4, "D", season, chunk_rows=c).orderBy("unique_id", "step").collect() for c in (None, 9))
    assert len(plain) == len(cut) == 12
    for p, c in zip(plain, cut):
        assert p.alpha == c.alpha and np.isclose(p.Theta, c.Theta, rtol=1e-9)


def test_differences_are_chosen_for_planted_series(spark):
    from panelspark.operators import arima

    rng = np.random.default_rng(8)
    n, made = 240, {}
    noise = rng.normal(size=(3, n))
    made["level"] = 50 + noise[0]
    made["walk"] = np.cumsum(np.random.default_rng(2).normal(size=n) + 0.2)  # a twentieth of all walks would get d = 2
    made["twice"] = np.cumsum(np.cumsum(noise[2]))
    season = 10 * np.sin(2 * np.pi * np.arange(n) / 12)
    made["season"] = 30 + season + rng.normal(size=n)
    made["season walk"] = season + np.cumsum(rng.normal(size=n))
    made["constant"] = np.full(n, 7.0)
    rows = [(k, i, float(v)) for k, y in made.items() for i, v in enumerate(y)]
    df = spark.createDataFrame(rows, "unique_id string, i int, y double")
    df = df.select("unique_id", F.expr("timestampadd(DAY, i, timestamp_ntz'2024-01-01')").alias("ds"), "y").repartition(3)
    got = {r.unique_id: r for r in arima.kpss(df, chunk_rows=17).collect()}
    for k in ("level", "walk", "season"):
        e = made[k] - made[k].mean()
        lags = int(4 * (n / 100) ** 0.25)
        spread = (e @ e + 2 * sum((1 - j / (lags + 1)) * (e[j:] @ e[:-j]) for j in range(1, lags + 1))) / n
        assert got[k].lags == lags and np.isclose(got[k].kpss, (np.cumsum(e) ** 2).sum() / n ** 2 / spread)
    assert got["constant"].kpss is None
    chosen = {r.unique_id: (r.d, r.seasonal_d) for r in arima.choose_differences(df, 12).collect()}
    walk = chosen.pop("season walk")  # its season is seen through a walk: only the sum of differences is sure
    assert chosen == {"level": (0, 0), "walk": (1, 0), "twice": (2, 0), "season": (0, 1), "constant": (0, 0)} and sum(walk) >= 1


def test_family_search_equals_refits(spark):
    rng = np.random.default_rng(9)
    rows, h, windows = [], 6, 3
    for k, n, noise in (("few", 40, 3.0), ("line", 80, 0.01), ("none", 5, 1.0)):
        x = rng.normal(size=(n, 9))
        rows += [(k, i, 1.0, *map(float, x[i]), float(4 + 2 * x[i, 0] + noise * rng.normal())) for i in range(n)]
    names = ["one", *[f"x{i}" for i in range(9)]]
    df = spark.createDataFrame(rows, "unique_id string, i int, " + ", ".join(f"{c} double" for c in names) + ", y double")
    df = df.withColumn("ds", F.expr("timestampadd(DAY, i, timestamp_ntz'2024-01-01')"))
    got = {r.unique_id: r for r in rg.family_search(df, names, "y", h, windows).collect()}
    assert set(got) == {"few", "line"} and got["few"].family != "linear"
    for k in got:
        z = np.array([r[2:] for r in rows if r[0] == k])

        def fit(part, family, alpha, share):
            x, y = part[:, 1:-1], part[:, -1]
            xc, yc = x - x.mean(axis=0), y - y.mean()
            if family in ("linear", "ridge"):
                b = np.linalg.solve(xc.T @ xc + alpha * np.eye(9), xc.T @ yc)
            else:  # proximal gradient
                b, step = np.zeros(9), len(yc) / np.linalg.eigvalsh(xc.T @ xc).max()
                step = 1 / (1 / step + alpha * (1 - share))
                for _ in range(4000):
                    g = b - step * (xc.T @ (xc @ b - yc) / len(yc) + alpha * (1 - share) * b)
                    b = np.sign(g) * np.maximum(np.abs(g) - step * alpha * share, 0)
            return np.concatenate([[y.mean() - x.mean(axis=0) @ b], b])

        def error(one):
            scores = []
            for w in range(windows):
                o = len(z) - (windows - w) * h
                if o > len(names):
                    scores.append(((z[o:o + h, -1] - z[o:o + h, :-1] @ fit(z[:o], *one)) ** 2).mean())
            return np.mean(scores)

        errors = [error(one) for one in rg.FAMILIES]
        best = rg.FAMILIES[int(np.argmin(errors))]
        assert (got[k].family, got[k].alpha) == best[:2] and np.isclose(got[k].cv_rmse, np.sqrt(min(errors)), rtol=1e-5)
        assert np.allclose(got[k].coef, fit(z, *best), rtol=1e-4, atol=1e-5)


def _outlying(spark):
    rng = np.random.default_rng(7)
    rows = []
    for k, n in (("a", 90), ("b", 140), ("few", 4)):
        x = rng.normal(size=(n, 2))
        y = 1 + x @ [2.0, -1.0] + rng.standard_t(2, size=n)
        rows += [(k, 1.0, *map(float, r), float(v)) for r, v in zip(x, y)]
    return spark.createDataFrame(rows, "k string, one double, x0 double, x1 double, y double").repartition(3)


def test_huber_in_one_task_equals_rounds_over_all(spark, monkeypatch):
    df = _outlying(spark)
    got = []
    for most in (rg.HUBER_ROWS, 100, 0):
        monkeypatch.setattr(rg, "HUBER_ROWS", most)
        got.append(sorted(rg.fit_huber(df, ["k"], ["one", "x0", "x1"], "y", max_iter=8).collect()))
    assert [r.k for r in got[0]] == ["a", "b", "few"]
    for a, b, c in zip(*got):
        assert np.allclose(a.coef, c.coef, rtol=1e-9) and np.allclose(b.coef, c.coef, rtol=1e-9)
        assert np.isclose(a.scale, c.scale, rtol=1e-9)
        assert a[3:] == b[3:] == c[3:]


def test_huber_rounds_of_short_series_take_no_jobs(spark):
    """Rounds that never settle (tol below 0) cost jobs only for keys that no task holds."""
    df, context = _outlying(spark), spark.sparkContext
    context.setJobGroup("huber-rounds", "")
    try:
        rounds = {r.rounds for r in rg.fit_huber(df, ["k"], ["one", "x0", "x1"], "y", max_iter=15, tol=-1.0).collect()}
        jobs = len(context.statusTracker().getJobIdsForGroup("huber-rounds"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert 15 in rounds and jobs < 15
