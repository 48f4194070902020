"""Anomaly detectors (G1–G7) and their vote, all keyed per series (``unique_id``) and ordered by ``ds``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.operators.explore import decompose
from panelspark.operators.windows import rolling_band
from panelspark.sources.panels import check_panel

def _by_series():
    return Window.partitionBy("unique_id")


def _series_stats(df: DataFrame, col: str, chunk_rows) -> tuple:
    """Mean and population σ of ``col`` per series: a window over the series, or — skew-safe — an aggregate
    (partial before the shuffle) joined back."""
    if not chunk_rows:
        return df, F.avg(col).over(_by_series()), F.stddev_pop(col).over(_by_series())
    st = df.groupBy("unique_id").agg(F.avg(col).alias(f"__mu_{col}"), F.stddev_pop(col).alias(f"__sd_{col}"))
    return df.join(st, "unique_id"), F.col(f"__mu_{col}"), F.col(f"__sd_{col}")


def band_flag(df: DataFrame, window: int = 20, n_sigmas: float = 2.0, chunk_rows: int | None = None) -> DataFrame:
    """G1: ``y`` outside the trailing mean ± kσ band (null band → false)."""
    d = rolling_band(df, window, n_sigmas, chunk_rows=chunk_rows)
    return d.withColumn("ma_anomaly",
                        F.coalesce((F.col("y") < F.col("ma_lower")) | (F.col("y") > F.col("ma_upper")), F.lit(False)))


def residual_flag(df: DataFrame, period: int = 7, n_sigmas: float = 2.0, model: str = "additive",
                  chunk_rows: int | None = None) -> DataFrame:
    """Decomposition residual outside its series mean ± k·(population σ); nulls skipped, null resid → false."""
    d = decompose(df, period, model, chunk_rows=chunk_rows)
    d, mu, sd = _series_stats(d, "resid", chunk_rows)
    flag = (F.col("resid") < mu - n_sigmas * sd) | (F.col("resid") > mu + n_sigmas * sd)
    return d.withColumn("decomp_anomaly", F.coalesce(flag, F.lit(False))).drop("__mu_resid", "__sd_resid")


def zscore_flag(df: DataFrame, threshold: float = 3.0, chunk_rows: int | None = None) -> DataFrame:
    """|z| > threshold with the series' population σ."""
    check_panel(df)
    d, mu, sd = _series_stats(df, "y", chunk_rows)
    z = F.try_divide(F.col("y") - mu, sd)
    return d.withColumn("z_score", z).withColumn("zscore_anomaly", F.coalesce(F.abs(F.col("z_score")) > threshold,
                                                                               F.lit(False))).drop("__mu_y", "__sd_y")


def interval_breach(df: DataFrame, actual: str = "y", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Actual outside the forecast band."""
    return df.withColumn("breach", F.coalesce((F.col(actual) < F.col(lo)) | (F.col(actual) > F.col(hi)), F.lit(False)))


FLAG_COLS = ("ma_anomaly", "decomp_anomaly", "zscore_anomaly")


def detect_anomalies(panel: DataFrame, ma_window: int = 20, ma_n_sigmas: float = 2.0, decomp_period: int = 7,
                     decomp_n_sigmas: float = 2.0, zscore_threshold: float = 3.0, extra_flags=(),
                     chunk_rows: int | None = None) -> DataFrame:
    """Band, residual and z-score flags on one pass (all windows share ``partitionBy(unique_id)``: one shuffle).
    ``chunk_rows``: skew-safe mode — windows chunk-wise with halos, series statistics by aggregates."""
    d = band_flag(panel, ma_window, ma_n_sigmas, chunk_rows=chunk_rows)
    d = residual_flag(d, decomp_period, decomp_n_sigmas, chunk_rows=chunk_rows)
    d = zscore_flag(d, zscore_threshold, chunk_rows=chunk_rows)
    flags = list(FLAG_COLS) + list(extra_flags)
    count = sum((F.col(c).cast("int") for c in flags[1:]), F.col(flags[0]).cast("int"))
    return d.withColumn("anomaly_count", count)


def vote(df: DataFrame, flags, min_votes: int = 3, keep_only: bool = True) -> DataFrame:
    """Count of flags, anomaly iff ≥ ``min_votes``; optionally keep only the anomalies."""
    count = sum((F.col(c).cast("int") for c in flags[1:]), F.col(flags[0]).cast("int"))
    d = df.withColumn("anomaly_count", count).withColumn("is_anomaly", F.col("anomaly_count") >= min_votes)
    return d.filter("is_anomaly") if keep_only else d


# ---------------------------------------------------------------- G3 isolation forest (1-D, per series)

def _c(n: float) -> float:
    """Average unsuccessful-search path length of a BST with n nodes: 2H(n−1) − 2(n−1)/n."""
    import math

    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow_tree_deltas(pdf, sample: int, seed: int):
    """One isolation tree on the sampled values of a (series, tree) group, returned as its step function:
    the path length left of every split point (``base``) and the jump at each breakpoint (``delta``)."""
    import math
    import zlib

    import numpy as np
    import pandas as pd

    uid, tree = pdf["unique_id"].iat[0], int(pdf["tree"].iat[0])
    max_depth = int(math.ceil(math.log2(max(min(sample, int(pdf["n"].iat[0])), 2))))
    rng = np.random.default_rng([seed, tree, zlib.crc32(str(uid).encode())])
    vals = np.sort(pdf["y"].to_numpy(dtype=float))
    segs = []  # (lo_exclusive_left_bound, path) in ascending order of the interval

    def grow(v, depth, lo):
        if depth >= max_depth or len(v) <= 1 or v[0] == v[-1]:
            segs.append((lo, depth + _c(len(v))))
            return
        split = rng.uniform(v[0], v[-1])
        k = int(np.searchsorted(v, split, side="left"))  # x < split goes left
        grow(v[:k], depth + 1, lo)
        grow(v[k:], depth + 1, split)

    grow(vals, 0, -np.inf)
    base = segs[0][1]
    rows = [(uid, tree, float(b), float(p - prev)) for (b, p), (_, prev) in zip(segs[1:], segs[:-1])]
    rows.append((uid, tree, float("-inf"), float(base)))  # the base path length, at −∞
    return pd.DataFrame(rows, columns=["unique_id", "tree", "b", "delta"])


#: Equal parts of a series' value range by which rows meet the steps of its forest.
SCORE_BUCKETS = 1024


def forest_steps(panel: DataFrame, n_trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """The trees of G3 as steps ``(unique_id, tree, b, delta)``: the path length at y sums the deltas with b ≤ y.

    A tree sees about ``sample`` rows of its series (the algorithm's own sample), or all of them if there are fewer.
    The trees that take a row are drawn from hashes of (row, tree) before anything is copied."""
    size = panel.groupBy("unique_id").agg(F.count("*").alias("n"))
    d = panel.select("unique_id", "ds", "y").where(F.col("y").isNotNull()).join(size, "unique_id")
    odds = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("n")) * 1000003.0
    drawn = F.filter(F.sequence(F.lit(0), F.lit(n_trees - 1)),
                     lambda t: F.pmod(F.xxhash64(F.col("unique_id"), F.col("ds"), t, F.lit(seed)), F.lit(1000003)) < odds)
    sampled = d.select("unique_id", "y", "n", F.explode(drawn).alias("tree"))
    return sampled.groupBy("unique_id", "tree").applyInPandas(
        lambda p: _grow_tree_deltas(p, sample, seed), "unique_id string, tree int, b double, delta double")


def isolation_forest(panel: DataFrame, n_trees: int = 100, sample: int = 256, contamination: float = 0.01,
                     seed: int = 42, col: str = "y") -> DataFrame:
    """Per-series isolation forest on ``y``; ``iso_score`` = 2^(−E[h]/c(min(sample, n))); ``iso_forest_anomaly``
    when the score exceeds the series' (1−contamination) quantile.

    Trees grow in parallel (one small ``applyInPandas`` group per (series, tree)), and a 1-D tree is a step function of
    y.  The steps of a series (bounded by trees × sample) are gathered by equal parts of its value range, each part with
    the path length at its start; a row joins its part, and adds the steps up to its value.  Parts depend on the values
    alone, so scores don't depend on the partitioning, and a long series is spread over its parts."""
    check_panel(panel)
    d = panel.select("unique_id", "ds", F.col(col).alias("y"))
    size = d.groupBy("unique_id").agg(F.count("*").alias("__n"), F.min("y").alias("__lo"), F.max("y").alias("__hi"))

    def bucket(value):
        at = F.try_divide(value - F.col("__lo"), F.col("__hi") - F.col("__lo")) * SCORE_BUCKETS
        return F.greatest(F.least(F.coalesce(F.floor(at), F.lit(0)), F.lit(SCORE_BUCKETS - 1)), F.lit(0)).cast("int")

    steps = forest_steps(d, n_trees, sample, seed).join(size, "unique_id")
    first = F.col("b") == float("-inf")
    steps = steps.select("unique_id", "b", "delta", F.when(first, -1).otherwise(bucket(F.col("b"))).alias("__b"))
    held = steps.groupBy("unique_id", "__b").agg(
        F.sum("delta").alias("__sum"), F.collect_list(F.struct("b", "delta")).alias("__steps"))
    # the path length where each part begins: parts without steps of their own take the last one before
    upto = Window.partitionBy("unique_id").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("unique_id").orderBy("__b")
    held = held.withColumns({"__start": F.coalesce(F.sum("__sum").over(upto), F.lit(0.0)),
                             "__next": F.coalesce(F.lead("__b").over(ahead), F.lit(SCORE_BUCKETS))})
    parts = held.select("unique_id", "__b", F.explode(F.sequence(F.col("__b"), F.col("__next") - 1)).alias("__part"),
                        "__start", "__sum", "__steps")
    own = F.col("__part") == F.col("__b")
    parts = parts.select("unique_id", "__part", F.when(own, F.col("__start")).otherwise(
        F.col("__start") + F.col("__sum")).alias("__start"),
        F.when(own, F.col("__steps")).otherwise(F.array().cast("array<struct<b:double,delta:double>>")).alias("__steps"))
    rows = d.join(size, "unique_id").withColumn("__part", bucket(F.col("y")))
    depth = F.col("__start") + F.aggregate("__steps", F.lit(0.0), lambda acc, s: acc + F.when(
        s["b"] <= F.col("y"), s["delta"]).otherwise(0.0))
    m = F.least(F.col("__n"), F.lit(sample)).cast("double")
    norm = F.when(m <= 1, F.lit(0.0)).when(m == 2, F.lit(1.0)).otherwise(
        2.0 * (F.log(m - 1) + 0.5772156649015329) - 2.0 * (m - 1) / m)
    s = rows.join(parts, ["unique_id", "__part"]).select(
        "unique_id", "ds", F.pow(F.lit(2.0), -F.try_divide(depth / n_trees, norm)).alias("iso_score"))
    from panelspark.operators.relational import exact_percentiles

    cut = exact_percentiles(s, ["unique_id"], "iso_score", [1 - contamination], ["__cut"])
    s = s.join(cut, "unique_id", "left").withColumn("iso_forest_anomaly", F.coalesce(
        F.col("iso_score") > F.col("__cut"), F.lit(False))).drop("__cut")
    return panel.join(s, ["unique_id", "ds"], "left")


# ---------------------------------------------------------------- G4 kernel novelty by random Fourier features

def fourier_features(n_features: int = 64, gamma: float = 1.0, seed: int = 42):
    """The seeded frequencies and phases of the random Fourier features."""
    import numpy as np

    rng = np.random.default_rng(seed)
    return rng.normal(0.0, np.sqrt(2 * gamma), n_features), rng.uniform(0.0, 2 * np.pi, n_features)


def kernel_novelty(panel: DataFrame, nu: float = 0.1, n_features: int = 64, gamma: float = 1.0, seed: int = 42,
                   col: str = "y") -> DataFrame:
    """G4 (re-aim of the one-class SVM): z-score y per series, map to ``n_features`` seeded random Fourier features of
    the RBF kernel exp(−γ·Δz²), score each row by its mean kernel similarity to its series (φ(z)·mean φ), flag the
    lowest ``nu`` share (below the exact quantile).  All JVM-side expressions."""
    import numpy as np

    w, b = fourier_features(n_features, gamma, seed)
    # series statistics and mean embeddings are aggregates (partial before the shuffle) joined back: no
    # whole-series window, so a hot series is spread over many tasks
    st = panel.groupBy("unique_id").agg(F.avg(col).alias("__mu"), F.stddev_pop(col).alias("__sd"))
    d = panel.join(st, "unique_id")
    z = F.try_divide(F.col(col) - F.col("__mu"), F.col("__sd"))
    d = d.withColumn("__z", F.coalesce(z, F.lit(0.0)))
    scale = float(np.sqrt(2.0 / n_features))
    phi = {f"__phi{i}": scale * F.cos(float(w[i]) * F.col("__z") + float(b[i])) for i in range(n_features)}
    d = d.withColumns(phi)
    emb = d.groupBy("unique_id").agg(*[F.avg(f"__phi{i}").alias(f"__m{i}") for i in range(n_features)])
    d = d.join(emb, "unique_id")
    score = sum((F.col(f"__phi{i}") * F.col(f"__m{i}") for i in range(n_features)), F.lit(0.0))
    d = d.withColumn("svm_score", score).drop("__z", "__mu", "__sd", *phi, *[f"__m{i}" for i in range(n_features)])
    from panelspark.operators.relational import exact_percentiles

    cut = exact_percentiles(d, ["unique_id"], "svm_score", [nu], ["__cut"])
    return d.join(cut, "unique_id").withColumn("svm_anomaly", F.col("svm_score") < F.col("__cut")).drop("__cut")


def detect_anomalies_all(panel: DataFrame, min_votes: int = 3, keep_only: bool = True, **kw) -> DataFrame:
    """The five detectors (band, residual, isolation forest, kernel novelty, z-score) and their vote."""
    d = band_flag(panel)
    d = residual_flag(d, kw.get("decomp_period", 7))
    d = zscore_flag(d)
    base = d.select("unique_id", "ds", "y", "ma_anomaly", "decomp_anomaly", "zscore_anomaly")
    iso = isolation_forest(panel.select("unique_id", "ds", "y")).select("unique_id", "ds", "iso_forest_anomaly")
    svm = kernel_novelty(panel.select("unique_id", "ds", "y")).select("unique_id", "ds", "svm_anomaly")
    allf = base.join(iso, ["unique_id", "ds"]).join(svm, ["unique_id", "ds"])
    return vote(allf, ["ma_anomaly", "decomp_anomaly", "iso_forest_anomaly", "svm_anomaly", "zscore_anomaly"],
                min_votes, keep_only)
