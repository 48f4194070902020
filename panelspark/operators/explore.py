"""Series exploration (F14–F22): decomposition, autocorrelation, peaks, seasonality, frequency, stationarity.

All statistics are keyed by ``unique_id``: the id loop of a notebook becomes one keyed shuffle.  Sums over a series
(ACF numerators, Gram matrices) are plain aggregates, so Spark combines them partially before the shuffle and a very
long series is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.chunking import chunked
from panelspark.operators.windows import _W
from panelspark.sources.panels import check_panel, epoch_seconds


# ---------------------------------------------------------------- F14 classical decomposition

def centered_trend(col: str, period: int):
    """Centred moving average of length ``period`` (even: m+1 rows weighted ½,1,…,1,½ over m); null at the ends."""
    h = period // 2
    if period % 2:
        frame = _W().rowsBetween(-h, h)
        return F.when(F.count(col).over(frame) == period, F.avg(col).over(frame))
    frame = _W().rowsBetween(-h, h)
    ends = F.lag(col, h).over(_W()) + F.lead(col, h).over(_W())
    return F.when(F.count(col).over(frame) == period + 1,
                  (F.sum(col).over(frame) - 0.5 * ends) / period)


def decompose(panel: DataFrame, period: int, model: str = "additive", col: str = "y", chunk_rows: int | None = None,
              time_bucket: str = "day") -> DataFrame:
    """classical decomposition → adds ``trend``, ``seasonal``, ``resid``.

    Seasonal = phase mean (phase = position mod m) of the detrended series, re-centred so the m phase means average 0
    (additive) or 1 (multiplicative).  Series with fewer than two full cycles get null components.
    """
    check_panel(panel)
    if model not in ("additive", "multiplicative"):
        raise ValueError("model must be 'additive' or 'multiplicative'")
    m = period
    add = model == "additive"
    if chunk_rows:
        return _decompose_chunked(panel, m, add, col, chunk_rows, time_bucket)
    d = panel.withColumns({"__pos": F.row_number().over(_W()) - 1,
                           "__n": F.count("*").over(Window.partitionBy("unique_id")),
                           "trend": centered_trend(col, m)})
    d = d.withColumn("trend", F.when(F.col("__n") >= 2 * m, F.col("trend")))
    det = (F.col(col) - F.col("trend")) if add else F.try_divide(F.col(col), F.col("trend"))
    d = d.withColumns({"__det": det, "__phase": F.col("__pos") % m})
    # HashPartitioning(unique_id) already satisfies a (unique_id, phase) window: no extra shuffle, one more sort.
    d = d.withColumn("__pm", F.avg("__det").over(Window.partitionBy("unique_id", "__phase")))
    centre = F.avg(F.when(F.col("__pos") < m, F.col("__pm"))).over(Window.partitionBy("unique_id"))
    seasonal = (F.col("__pm") - centre) if add else F.try_divide(F.col("__pm"), centre)
    seasonal = F.when(F.col("__n") >= 2 * m, seasonal)
    d = d.withColumn("seasonal", seasonal)
    resid = (F.col("__det") - F.col("seasonal")) if add else F.try_divide(F.col("__det"), F.col("seasonal"))
    return d.withColumn("resid", resid).drop("__pos", "__n", "__det", "__phase", "__pm")


def _decompose_chunked(panel: DataFrame, m: int, add: bool, col: str, chunk_rows: int, time_bucket: str) -> DataFrame:
    """Skew-safe F14: trend chunk-wise (±m/2 halos); phase means, their centre and the series length are
    aggregates joined back (tables of #series·m rows), so no window spans a whole series."""
    h = m // 2
    d = chunked(panel, lambda x: x.withColumn("trend", centered_trend(col, m)), back=h, fwd=h, chunk_rows=chunk_rows,
                time_bucket=time_bucket, keep_pos=True)
    n = panel.groupBy("unique_id").agg(F.count("*").alias("__n"))
    d = d.join(n, "unique_id").withColumn("trend", F.when(F.col("__n") >= 2 * m, F.col("trend")))
    det = (F.col(col) - F.col("trend")) if add else F.try_divide(F.col(col), F.col("trend"))
    d = d.withColumns({"__det": det, "__phase": F.col("__pos") % m})
    pm = d.groupBy("unique_id", "__phase").agg(F.avg("__det").alias("__pm"))
    centre = pm.groupBy("unique_id").agg(F.avg("__pm").alias("__c"))
    d = d.join(pm, ["unique_id", "__phase"]).join(centre, "unique_id")
    seasonal = (F.col("__pm") - F.col("__c")) if add else F.try_divide(F.col("__pm"), F.col("__c"))
    d = d.withColumn("seasonal", F.when(F.col("__n") >= 2 * m, seasonal))
    resid = (F.col("__det") - F.col("seasonal")) if add else F.try_divide(F.col("__det"), F.col("seasonal"))
    return d.withColumn("resid", resid).drop("__pos", "__n", "__det", "__phase", "__pm", "__c")


# ---------------------------------------------------------------- F16 autocorrelation

def acf(panel: DataFrame, max_lag: int = 100, nlags=None, col: str = "y", chunk_rows: int | None = None,
        time_bucket: str = "day") -> DataFrame:
    """F16: biased autocorrelation ``Σ(y_t−ȳ)(y_{t−k}−ȳ) / Σ(y_t−ȳ)²`` for k = 0…K per series, long ``(unique_id,
    lag, acf)``.  K = ``nlags`` if given, else ``min(n//2, max_lag)`` per series.

    Each row carries its last K+1 centred values (``collect_list`` over a bounded ``rowsBetween(-K, 0)`` frame),
    explodes them into (lag, product) pairs and the products are summed by (series, lag) — an ordinary aggregate,
    partial in every map task, so a long series is summed by many tasks and only (series, lag) partials shuffle.
    ``chunk_rows`` additionally spreads the frame computation of one long series over chunks (K-row halos)."""
    K = int(nlags) if nlags is not None else int(max_lag)

    def frames(x):
        return x.withColumn("__h", F.collect_list("__z").over(_W().rowsBetween(-K, 0)))

    if chunk_rows:
        # skew-safe: series mean by a (partial) aggregate, frames chunk-wise with a K-row halo
        mu = panel.groupBy("unique_id").agg(F.avg(col).alias("__mu"), F.count("*").alias("__n"))
        z = panel.join(mu, "unique_id").select("unique_id", "ds", "__n", (F.col(col) - F.col("__mu")).alias("__z"))
        d = chunked(z, frames, back=K, chunk_rows=chunk_rows, time_bucket=time_bucket)
    else:
        by_s = Window.partitionBy("unique_id")
        d = frames(panel.select("unique_id", "ds", F.count("*").over(by_s).alias("__n"),
                                (F.col(col) - F.avg(col).over(by_s)).alias("__z")))
    e = d.select("unique_id", "__n", "__z", F.posexplode(F.reverse("__h")).alias("lag", "__zl"))
    s = e.groupBy("unique_id", "lag").agg(F.sum(F.col("__z") * F.col("__zl")).alias("__s"), F.max("__n").alias("__n"))
    kmax = F.lit(K) if nlags is not None else F.least(F.floor(F.col("__n") / 2), F.lit(K))
    den = F.sum(F.when(F.col("lag") == 0, F.col("__s"))).over(Window.partitionBy("unique_id"))
    out = s.withColumn("acf", F.when(F.col("lag") == 0, F.lit(1.0)).otherwise(F.try_divide(F.col("__s"), den)))
    return out.filter(F.col("lag") <= kmax).select("unique_id", F.col("lag").cast("int").alias("lag"), "acf")


def acf_peaks(acf_long: DataFrame, height: float = 0.1, top: int | None = 3) -> DataFrame:
    """strict local maxima of the ACF over lags ≥ 1 with value ≥ ``height`` (the first and last lag are never
    peaks), strongest first (ties: larger lag first), ``top`` per series (``None``: all)."""
    w = Window.partitionBy("unique_id").orderBy("lag")
    a = acf_long.filter(F.col("lag") >= 1)
    a = a.withColumns({"__prev": F.lag("acf").over(w), "__next": F.lead("acf").over(w)})
    p = a.filter((F.col("acf") > F.col("__prev")) & (F.col("acf") > F.col("__next")) & (F.col("acf") >= height))
    r = Window.partitionBy("unique_id").orderBy(F.desc("acf"), F.desc("lag"))
    p = p.withColumn("rank", F.row_number().over(r)).select("unique_id", "rank", "lag", "acf")
    return p if top is None else p.filter(F.col("rank") <= top)


# fixed values: named seasonal lags per frequency
SEASONALITIES = {
    "D": [("Daily", 1), ("Weekly", 7), ("Biweekly", 14), ("Monthly", 30), ("Quarterly", 90), ("Yearly", 365)],
    "M": [("Monthly", 1), ("Quarterly", 3), ("Yearly", 12)],
    "Q": [("Quarterly", 1), ("Yearly", 4)],
    "Y": [("Yearly", 1)],
}


def named_seasonalities(acf_long: DataFrame, freq: str, threshold: float = 0.1) -> DataFrame:
    """named seasonal lags of a frequency whose |ACF| exceeds ``threshold`` (lags beyond K are absent)."""
    spark = acf_long.sparkSession
    rows = SEASONALITIES.get(freq, [])
    if not rows:
        return acf_long.limit(0).select("unique_id", F.lit("").alias("name"), "lag", "acf")
    dim = spark.createDataFrame(rows, "name string, lag int")
    j = acf_long.filter(F.col("lag") >= 1).join(F.broadcast(dim), "lag")  # ≤ 6-row literal dimension
    return j.filter(F.abs("acf") > threshold).select("unique_id", "name", "lag", "acf")


# ---------------------------------------------------------------- F20 frequency inference

def infer_frequency(panel: DataFrame) -> DataFrame:
    """F20 per series: constant daily step → D; constant 1/3/12-month step on month ends (or starts) → M/Q/Y; any
    other constant step → Unknown; else the median gap in whole days: 1→D, 28–31→M, 90–92→Q, 365–366→Y."""
    # gaps inside each calendar day by a window over (series, day), gaps between days from per-day first and last
    # stamps: no window holds a whole series of raw rows
    d = panel.select("unique_id", F.to_date("ds").alias("__day"), epoch_seconds("ds").alias("__s"),
                     (F.year("ds") * 12 + F.month("ds")).alias("__m"),
                     (F.to_date("ds") == F.last_day("ds")).cast("int").alias("__me"),
                     ((F.dayofmonth("ds") == 1) & (F.to_date("ds").cast("timestamp_ntz") == F.col("ds"))).cast("int")
                     .alias("__ms"))
    inside = Window.partitionBy("unique_id", "__day").orderBy("__s")
    within = d.select("unique_id", (F.col("__s") - F.lag("__s").over(inside)).alias("__gap"),
                      F.lit(0).alias("__mg"))
    days = d.groupBy("unique_id", "__day").agg(F.min("__s").alias("__a"), F.max("__s").alias("__z"),
                                               F.first("__m").alias("__m"), F.min("__me").alias("__me"),
                                               F.min("__ms").alias("__ms"))
    by_day = Window.partitionBy("unique_id").orderBy("__day")
    between = days.select("unique_id", (F.col("__a") - F.lag("__z").over(by_day)).alias("__gap"),
                          (F.col("__m") - F.lag("__m").over(by_day)).alias("__mg"))
    flags = days.groupBy("unique_id").agg(F.min("__me").alias("me"), F.min("__ms").alias("ms"))
    d = within.unionByName(between).where(F.col("__gap").isNotNull())
    a = flags.join(d.groupBy("unique_id").agg(
        F.min("__gap").alias("g0"), F.max("__gap").alias("g1"), F.min("__mg").alias("m0"), F.max("__mg").alias("m1")),
        "unique_id", "left")
    from panelspark.operators.relational import exact_percentiles

    a = a.join(exact_percentiles(d, ["unique_id"], "__gap", [0.5], ["med"]), "unique_id", "left")
    days = F.floor(F.col("med") / 86400)
    by_median = (F.when(days == 1, "D").when(days.between(28, 31), "M").when(days.between(90, 92), "Q")
                  .when(days.between(365, 366), "Y").otherwise("Unknown"))
    monthly = (F.col("m0") == F.col("m1")) & ((F.col("me") == 1) | (F.col("ms") == 1))
    freq = (F.when(F.col("g0").isNull(), "Unknown")
             .when((F.col("g0") == F.col("g1")) & (F.col("g0") == 86400), "D")
             .when(monthly & (F.col("m0") == 1), "M").when(monthly & (F.col("m0") == 3), "Q")
             .when(monthly & (F.col("m0") == 12), "Y")
             .when(F.col("g0") == F.col("g1"), "Unknown")
             .otherwise(by_median))
    return a.select("unique_id", freq.alias("freq"))


# ---------------------------------------------------------------- F23 trend and Fourier terms

def trend_fourier(history: DataFrame, future: DataFrame, season_length: int, k: int) -> DataFrame:
    """``trend`` = 1…n+h over history ∪ horizon, ``sin{j}_{m}``/``cos{j}_{m}`` = sin/cos(2πj·trend/m), j=1…k."""
    u = history.select("unique_id", "ds", F.lit(False).alias("is_future")) \
               .unionByName(future.select("unique_id", "ds", F.lit(True).alias("is_future")))
    u = u.withColumn("trend", F.row_number().over(_W()))
    cols = {}
    for j in range(1, k + 1):
        ang = 2 * 3.141592653589793 * j * F.col("trend") / season_length
        cols[f"sin{j}_{season_length}"] = F.sin(ang)
        cols[f"cos{j}_{season_length}"] = F.cos(ang)
    return u.withColumns(cols)


# ---------------------------------------------------------------- F17 partial autocorrelation

def _durbin_levinson(pdf):
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("lag")
    r = pdf["acf"].to_numpy(dtype=float)
    K = len(r) - 1
    out = [1.0]
    phi_prev = np.zeros(0)
    for k in range(1, K + 1):
        if k == 1:
            phi_kk = r[1]
            phi = np.array([phi_kk])
        else:
            num = r[k] - np.sum(phi_prev * r[k - 1:0:-1])
            den = 1.0 - np.sum(phi_prev * r[1:k])
            phi_kk = num / den if den != 0 else float("nan")
            phi = np.append(phi_prev - phi_kk * phi_prev[::-1], phi_kk)
        out.append(float(phi_kk))
        phi_prev = phi
    return pd.DataFrame({"unique_id": pdf["unique_id"].iloc[0], "lag": np.arange(K + 1, dtype="int32"), "pacf": out})


def pacf(acf_long: DataFrame) -> DataFrame:
    """Yule–Walker partial autocorrelation by Durbin–Levinson on each series' ACF (≤ K+1 values per group:
    the group size is the lag count, never the series length)."""
    return acf_long.groupBy("unique_id").applyInPandas(_durbin_levinson, "unique_id string, lag int, pacf double")


# ---------------------------------------------------------------- F11 automatic seasonality and differencing

def auto_differences(panel: DataFrame, max_season_length: int = 12, max_diffs: int = 1,
                     strength_threshold: float = 0.64) -> DataFrame:
    """F11 (our definition): season length = lag of the largest ACF local maximum > 0.1 in 2…max; seasonal
    difference iff seasonal strength 1 − var(resid)/var(detrended) > 0.64; then regular differences while the ADF
    p-value ≥ 0.05, at most ``max_diffs``.  One row per series.

    Decomposition needs one period per call: the set of chosen periods is at most ``max_season_length`` values, so
    the work is one keyed pass per distinct period (never per series)."""
    from panelspark.operators.regression import adf
    from panelspark.operators.windows import difference
    from panelspark.session import cut_lineage

    # read by the ACF, by each period's decomposition and by each ADF: the panel is built and written once
    panel = cut_lineage(panel.select("unique_id", "ds", "y"))
    a = acf(panel, nlags=max_season_length + 1)
    pk = acf_peaks(a.filter(F.col("lag") <= max_season_length + 1), 0.1, None).filter(F.col("lag") >= 2)
    period = pk.groupBy("unique_id").agg(F.max_by("lag", F.struct("acf", "lag")).alias("season_length"))
    per = cut_lineage(panel.select("unique_id").distinct().join(period, "unique_id", "left"))  # one row per series
    periods = [r[0] for r in per.select("season_length").dropna().distinct().collect()]  # ≤ max_season_length values
    strengths = []
    for m in periods:
        ids = per.filter(F.col("season_length") == m).select("unique_id")
        d = decompose(panel.join(ids, "unique_id", "left_semi"), m)
        det = F.col("seasonal") + F.col("resid")
        strengths.append(d.groupBy("unique_id").agg(
            (1 - F.try_divide(F.var_pop("resid"), F.var_pop(F.when(F.col("resid").isNotNull(), det)))).alias("strength")))
    st = strengths[0] if strengths else None
    for s in strengths[1:]:
        st = st.unionByName(s)
    if st is None:  # no series has a period
        res = per.withColumn("strength", F.lit(None).cast("double"))
    else:
        res = per.join(st, "unique_id", "left")
    res = cut_lineage(res.withColumn("seasonal_diff", F.coalesce(F.col("strength") > strength_threshold, F.lit(False))))
    # regular differences on the (seasonally differenced) series while non-stationary
    cur = panel.join(res.select("unique_id", "season_length", "seasonal_diff"), "unique_id")
    seasonal_sets = []
    for m in periods:
        sub = cur.filter(F.col("seasonal_diff") & (F.col("season_length") == m)).select("unique_id", "ds", "y")
        seasonal_sets.append(difference(sub, 1, lag=int(m)))
    base = cur.filter(~F.col("seasonal_diff")).select("unique_id", "ds", "y")
    for s in seasonal_sets:
        base = base.unionByName(s)
    ndiff = res.select("unique_id").withColumn("diffs", F.lit(0))
    series = base
    for k in range(1, max_diffs + 1):
        t = adf(series).select("unique_id", (F.col("p_value") >= 0.05).alias(f"__ns{k}"))
        ndiff = ndiff.join(t, "unique_id", "left").withColumn(
            "diffs", F.col("diffs") + F.coalesce(F.col(f"__ns{k}"), F.lit(False)).cast("int")).drop(f"__ns{k}")
        series = difference(series.join(t.filter(f"__ns{k}"), "unique_id", "left_semi"), 1)
    return res.join(ndiff, "unique_id", "left").select("unique_id", "season_length", "strength", "seasonal_diff", "diffs")


# ---------------------------------------------------------------- F22 per-series insight report

DECOMP_PERIOD = {"M": 30, "Q": 90, "Y": 365}  # fixed values: the reference's decomposition period by frequency


def insight_report(panel: DataFrame, freq: str | None = None, max_lag: int = 100) -> DataFrame:
    """one row per series — frequency, ADF, named seasonalities, top-3 ACF peaks, decomposition period."""
    from panelspark.operators.regression import adf
    from panelspark.session import cut_lineage

    panel = cut_lineage(panel.select("unique_id", "ds", "y"))  # read by every part of the report: built once
    fr = infer_frequency(panel) if freq is None else panel.select("unique_id").distinct().withColumn("freq", F.lit(freq))
    fr, a = cut_lineage(fr), cut_lineage(acf(panel, max_lag))  # one row per series; per (series, lag)
    peaks = acf_peaks(a).groupBy("unique_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "lag", "acf"))),
                                 lambda s: F.format_string("lag %d: %.3f", s["lag"], s["acf"])), "; ").alias("top_peaks"))
    named = []
    for f in ("D", "M", "Q", "Y"):
        ids = fr.filter(F.col("freq") == f).select("unique_id")
        named.append(named_seasonalities(a.join(ids, "unique_id", "left_semi"), f))
    ns = named[0]
    for x in named[1:]:
        ns = ns.unionByName(x)
    ns = ns.groupBy("unique_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lag", "name", "acf"))),
                                                              lambda s: F.format_string("%s (lag %d): %.3f", s["name"], s["lag"], s["acf"])),
                                                  "; ").alias("seasonalities"))
    st = adf(panel).select("unique_id", "adf_stat", "p_value", "stationary")
    dp = F.create_map(*[F.lit(x) for kv in DECOMP_PERIOD.items() for x in kv])
    out = fr.join(st, "unique_id", "left").join(ns, "unique_id", "left").join(peaks, "unique_id", "left")
    return out.withColumn("decomposition_period", F.coalesce(dp[F.col("freq")], F.lit(7)))


# ---------------------------------------------------------------- D18 normal Q–Q points

def qq_points(df: DataFrame, col: str, key: str = "unique_id") -> DataFrame:
    """Ordered values with normal quantiles at Filliben positions (ends 1−0.5^(1/n) and 0.5^(1/n), inside
    (i−0.3175)/(n+0.365)) and the least-squares line through them (slope, intercept per key)."""
    from pyspark.sql.functions import pandas_udf

    from panelspark.functions.linalg import norm_ppf

    @pandas_udf("double")
    def ppf(p):
        return __import__("pandas").Series(norm_ppf(p.to_numpy()))

    from panelspark.operators.relational import value_ranks

    d = value_ranks(df.filter(F.col(col).isNotNull()).select(key, F.col(col).alias("sample")), [key], "sample")
    m = (F.when(F.col("i") == 1, 1 - F.pow(F.lit(0.5), 1 / F.col("n")))
          .when(F.col("i") == F.col("n"), F.pow(F.lit(0.5), 1 / F.col("n")))
          .otherwise((F.col("i") - 0.3175) / (F.col("n") + 0.365)))
    d = d.withColumn("theoretical", ppf(m))
    line = d.groupBy(key).agg(F.regr_slope("sample", "theoretical").alias("slope"),
                              F.regr_intercept("sample", "theoretical").alias("intercept"))
    return d.join(line, key).select(key, "i", "theoretical", "sample", "slope", "intercept")


# ---------------------------------------------------------------- F15 multiple seasonal decomposition (re-aim)

def multi_seasonal_decompose(panel: DataFrame, periods=(24, 168), iterations: int = 2, col: str = "y") -> DataFrame:
    """F15 re-aim of MSTL: periods in ascending order; each pass re-estimates ``seasonal_m`` by the classical
    steps on y minus the other seasonal components; after ``iterations`` passes, ``trend`` is the centred moving
    average (largest period) of the deseasonalised series and ``remainder`` = y − trend − Σ seasonal.  Every step is a
    window over the same series partitioning (one shuffle)."""
    periods = sorted(periods)
    names = [f"seasonal{m}" for m in periods]
    d = panel.select("unique_id", "ds", F.col(col).alias("__y0"), *[F.lit(0.0).alias(n) for n in names])
    for _ in range(iterations):
        for m, nm in zip(periods, names):
            others = sum((F.col(o) for o in names if o != nm), F.lit(0.0))
            x = d.withColumn("y", F.col("__y0") - others)
            dec = decompose(x, m)
            d = dec.withColumn(nm, F.col("seasonal")).drop("seasonal", "trend", "resid", "y")
    total = sum((F.col(n) for n in names), F.lit(0.0))
    d = d.withColumn("y", F.col("__y0") - total).withColumn("trend", centered_trend("y", periods[-1]))
    return d.select("unique_id", "ds", F.col("__y0").alias(col), "trend", *names,
                    (F.col("__y0") - F.col("trend") - total).alias("remainder"))
