"""Window and series operators over a long panel.

Every window is ``partitionBy(unique_id)`` ordered by ``ds`` — one hash shuffle on ``unique_id``; windows with the same
spec collapse into one ``WindowExec`` (one sort).  Frames are bounded ``rowsBetween`` frames, so a long series streams
through its task instead of being buffered.  Positional semantics (the reference's) assume a spine-filled panel
(``fill_gaps``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.chunking import chunked, positions, series_keys
from panelspark.sources.panels import check_panel


def series_window(id_col: str | None = None, order_col: str | None = None) -> Window:
    """``partitionBy(unique_id).orderBy(ds)`` — or ``(unique_id, chunk)`` by position inside ``chunking.chunked``."""
    if id_col is not None or order_col is not None:
        return Window.partitionBy(id_col or "unique_id").orderBy(order_col or "ds")
    keys, order = series_keys()
    return Window.partitionBy(*keys).orderBy(order)


def _W() -> Window:
    return series_window()


def __getattr__(name):  # ``from ...windows import W`` without needing a session at import time
    if name == "W":
        return series_window()
    raise AttributeError(name)


# ---------------------------------------------------------------- F1–F3 lag features

def add_lags(df: DataFrame, lags, col: str = "y", prefix: str = "lag", chunk_rows: int | None = None,
             time_bucket: str = "day") -> DataFrame:
    """``lag{k}`` columns (null where the history is too short).  ``chunk_rows``: skew-safe chunked evaluation
    (a long series is spread over many tasks; see ``functions.chunking``)."""
    if chunk_rows:
        return chunked(df, lambda d: add_lags(d, lags, col, prefix), back=max(lags), chunk_rows=chunk_rows,
                       time_bucket=time_bucket)
    return df.withColumns({f"{prefix}{k}": F.lag(col, k).over(_W()) for k in lags})


def expanding_mean(col: str) -> Column:
    """mean of everything up to and including this row (nulls skipped)."""
    return F.avg(col).over(_W().rowsBetween(Window.unboundedPreceding, 0))


def add_expanding_mean(df: DataFrame, col: str, out: str, chunk_rows: int | None = None, time_bucket: str = "day") -> DataFrame:
    """F2 as a column.  ``chunk_rows``: a distributed prefix scan — sums and counts of each chunk of a series, their prefix sums
    over the small table of chunks, and a running sum inside each chunk from there on; no window holds a whole series."""
    if not chunk_rows:
        return df.withColumn(out, expanding_mean(col))
    d = positions(df, time_bucket).withColumn("__chunk", F.floor(F.col("__pos") / chunk_rows).cast("long"))
    earlier = Window.partitionBy("unique_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    parts = d.groupBy("unique_id", "__chunk").agg(F.sum(col).alias("__s"), F.count(col).alias("__c"))
    parts = parts.select("unique_id", "__chunk", F.coalesce(F.sum("__s").over(earlier), F.lit(0.0)).alias("__s"),
                         F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__c"))
    inside = Window.partitionBy("unique_id", "__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("__s") + F.coalesce(F.sum(col).over(inside), F.lit(0.0))
    d = d.join(parts, ["unique_id", "__chunk"]).withColumn(out, F.try_divide(total, F.col("__c") + F.count(col).over(inside)))
    return d.drop("__s", "__c", "__chunk", "__pos")


def rolling_mean(col: str, window: int, min_periods: int | None = None) -> Column:
    """trailing mean of ``window`` rows; null until ``min_periods`` (default: all) non-null values are seen."""
    frame = _W().rowsBetween(-(window - 1), 0)
    need = window if min_periods is None else min_periods
    return F.when(F.count(col).over(frame) >= need, F.avg(col).over(frame))


def rolling_std(col: str, window: int, min_periods: int | None = None) -> Column:
    frame = _W().rowsBetween(-(window - 1), 0)
    need = window if min_periods is None else min_periods
    return F.when(F.count(col).over(frame) >= need, F.stddev_samp(col).over(frame))


def rolling_band(df: DataFrame, window: int = 20, n_sigmas: float = 2.0, col: str = "y", chunk_rows: int | None = None,
                 time_bucket: str = "day") -> DataFrame:
    """trailing mean and sample std (null until the window is full) with a ±kσ band."""
    check_panel(df)
    if chunk_rows:
        return chunked(df, lambda d: rolling_band(d, window, n_sigmas, col), back=window - 1, chunk_rows=chunk_rows,
                       time_bucket=time_bucket)
    return (df.withColumns({"ma": rolling_mean(col, window), "ma_std": rolling_std(col, window)})
              .withColumns({"ma_lower": F.col("ma") - n_sigmas * F.col("ma_std"),
                            "ma_upper": F.col("ma") + n_sigmas * F.col("ma_std")}))


def centered_mean(col: str, window: int) -> Column:
    """centred moving average with partial windows (row i sees i-⌊w/2⌋ … i+⌊(w-1)/2⌋)."""
    return F.avg(col).over(_W().rowsBetween(-(window // 2), (window - 1) // 2))


def moving_average(df: DataFrame, window: int, col: str = "y") -> DataFrame:
    return df.withColumn(f"moving_avg_w{window}", centered_mean(col, window))


# ---------------------------------------------------------------- F6 window sizes from the shortest series

def auto_filter_sizes(panel: DataFrame) -> DataFrame:
    """one row ``(min_length, savgol_window, ma_window)`` computed from the shortest series (two-level agg)."""
    n = panel.groupBy("unique_id").count().agg(F.min("count").alias("min_length"))
    sg = F.greatest(F.lit(3), F.least(F.floor(F.col("min_length") / 10), F.lit(11)))
    sg = F.when(sg % 2 == 0, sg + 1).otherwise(sg)
    ma = F.greatest(F.lit(2), F.least(F.floor(F.col("min_length") / 10), F.lit(14)))
    return n.select(F.col("min_length").cast("bigint").alias("min_length"),
                    sg.cast("int").alias("savgol_window"), ma.cast("int").alias("ma_window"))


# ---------------------------------------------------------------- F8–F10 differencing

def difference(df: DataFrame, order: int = 1, lag: int = 1, col: str = "y", out: str | None = None,
               dropna: bool = True) -> DataFrame:
    """Apply ``y - lag(y, lag)`` ``order`` times (lag=m is seasonal differencing); nulls dropped."""
    out = out or col
    cur = col
    for i in range(order):
        nxt = f"__d{i}"
        df = df.withColumn(nxt, F.col(cur) - F.lag(cur, lag).over(_W()))
        cur = nxt
    df = df.withColumn(out, F.col(cur)).drop(*[f"__d{i}" for i in range(order)])
    return df.filter(F.col(out).isNotNull()) if dropna else df


def undifference(forecast: DataFrame, last_levels: DataFrame, lag: int = 1, col: str = "y",
                 freq: str | None = None) -> DataFrame:
    """turn forecasts of ``y_t - y_{t-lag}`` back into levels.

    ``forecast``: ``(unique_id, ds, col)`` differenced forecasts; ``last_levels``: ``(unique_id, ds, y)`` — the last
    ``lag`` observed levels per series.  Step k adds to the level observed ``lag`` steps before, i.e. a running sum
    within each residue class ``step % lag`` started from the matching last level.
    """
    from panelspark.sources.panels import tail_rows

    wf = series_window()
    f = forecast.withColumn("__step", F.row_number().over(wf) - 1)  # the forecast horizon: h rows per series
    tail = tail_rows(last_levels, lag, freq)  # the last `lag` levels without ordering whole series (given freq)
    lv = (tail.withColumn("__r", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("ds"))))
          .select("unique_id", ((F.lit(lag) - F.col("__r")) % lag).alias("__cls"), F.col("y").alias("__base")))
    f = f.withColumn("__cls", F.col("__step") % lag)
    wc = Window.partitionBy("unique_id", "__cls").orderBy("__step").rowsBetween(Window.unboundedPreceding, 0)
    return (f.join(lv, ["unique_id", "__cls"], "left")
             .withColumn(col, F.col("__base") + F.sum(col).over(wc))
             .drop("__step", "__cls", "__base"))


# ---------------------------------------------------------------- F12–F13 per-entity change summaries

def pct_change(col: str, w: Window | None = None) -> Column:
    """Relative change vs the previous row; zero or null base → null (ANSI-safe ``try_divide``)."""
    prev = F.lag(col, 1).over(w if w is not None else _W())
    return F.try_divide(F.col(col) - prev, F.when(prev != 0, prev))


def mean_pct_change(df: DataFrame, col: str, id_col: str = "unique_id", order_col: str = "ds",
                    guarded: bool = False) -> DataFrame:
    """mean percentage change per entity.  ``guarded``: 0 unless >1 row and the first value > 0."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    d = df.select(id_col, order_col, col, pct_change(col, w).alias("__pc"))
    agg = d.groupBy(id_col).agg(F.avg("__pc").alias("mean_pct_change"), F.count("*").alias("__n"),
                                F.min_by(col, order_col).alias("__first"))
    val = F.col("mean_pct_change")
    if guarded:
        val = F.when((F.col("__n") > 1) & (F.col("__first") > 0), F.coalesce(val, F.lit(0.0))).otherwise(0.0)
    return agg.select(id_col, val.alias("mean_pct_change"))


def mean_diff(df: DataFrame, col: str, id_col: str = "unique_id", order_col: str = "ds") -> DataFrame:
    """mean first difference per entity."""
    w = Window.partitionBy(id_col).orderBy(order_col)
    return (df.select(id_col, (F.col(col) - F.lag(col, 1).over(w)).alias("__d"))
              .groupBy(id_col).agg(F.avg("__d").alias("mean_diff")))


# ---------------------------------------------------------------- B7/B8/E5 positional helpers

def position(df: DataFrame) -> DataFrame:
    return df.withColumn("pos", F.row_number().over(_W()))


def train_test_flag(df: DataFrame, frac: float, time_bucket: str | None = None) -> DataFrame:
    """First ``int(n*frac)`` rows of each series are train (``is_train`` true), the rest test.
    ``time_bucket``: skew-safe positions (bucket prefix counts) and ``n`` by aggregate — no whole-series window."""
    if time_bucket:
        n = df.groupBy("unique_id").agg(F.count("*").alias("__n"))
        d = positions(df, time_bucket).join(n, "unique_id")
        return d.withColumn("is_train", F.col("__pos") + 1 <= F.floor(F.col("__n") * F.lit(frac))).drop("__pos", "__n")
    n = F.count("*").over(Window.partitionBy("unique_id"))
    return df.withColumn("is_train", F.row_number().over(_W()) <= F.floor(n * F.lit(frac)))


def head_tail(df: DataFrame, k: int) -> DataFrame:
    """E5: first and last ``k`` rows of every series, tagged ``part`` = head / tail."""
    wd = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    d = df.withColumns({"__h": F.row_number().over(_W()), "__t": F.row_number().over(wd)})
    head = d.filter(F.col("__h") <= k).withColumn("part", F.lit("head"))
    tail = d.filter(F.col("__t") <= k).withColumn("part", F.lit("tail"))
    return head.unionByName(tail).drop("__h", "__t")


# ---------------------------------------------------------------- F7 Savitzky–Golay

def savgol_weights(window: int, polyorder: int):
    """Rows of the least-squares projection onto polynomials of degree ``polyorder`` over ``window`` points:
    row h (the middle) smooths inner points, rows 0…h−1 and h+1…w−1 evaluate the edge fits."""
    import numpy as np

    if window % 2 == 0 or window <= polyorder:
        raise ValueError("window must be odd and larger than polyorder")
    h = window // 2
    x = np.arange(window, dtype=float) - h
    V = np.vander(x, polyorder + 1, increasing=True)
    return V @ np.linalg.pinv(V)


def _shift(col: str, d: int) -> Column:
    if d == 0:
        return F.col(col)
    return F.lead(col, d).over(_W()) if d > 0 else F.lag(col, -d).over(_W())


def savgol(df: DataFrame, window: int, polyorder: int = 3, col: str = "y", out: str = "savgol") -> DataFrame:
    """Savitzky–Golay smoothing.  Inner rows: fixed weights over lags/leads; the first and last ``window//2`` rows
    take the polynomial fitted to the first/last ``window`` points (edge weight rows).  Series shorter than the
    window get nulls."""
    P = savgol_weights(window, polyorder)
    h = window // 2

    def combo(row, rel):  # Σ_i P[row,i] · y[pos + (i − rel)]
        return sum((float(P[row, i]) * _shift(col, i - rel) for i in range(window)), F.lit(0.0))

    pos = F.row_number().over(_W()) - 1
    n = F.count("*").over(Window.partitionBy("unique_id"))
    d = df.withColumns({"__pos": pos, "__n": n})
    expr = F.when(F.col("__n") < window, F.lit(None).cast("double"))
    for j in range(h):
        expr = expr.when(F.col("__pos") == j, combo(j, j))
    for j in range(h + 1, window):
        expr = expr.when(F.col("__pos") == F.col("__n") - window + j, combo(j, j))
    expr = expr.otherwise(combo(h, h))
    return d.withColumn(out, expr).drop("__pos", "__n")


# ---------------------------------------------------------------- F24 supervised table

def date_features(ts: str = "ds", names=("hour", "dayofweek")) -> dict:
    """Named date-feature callables → columns."""
    fns = {"date": lambda c: F.to_date(c), "hour": F.hour, "minute": F.minute, "dayofweek": F.dayofweek,
           "month": F.month, "year": F.year, "dayofmonth": F.dayofmonth}
    return {n: fns[n](F.col(ts)) for n in names}


def supervised_table(panel: DataFrame, lags=(1, 2, 24), diff_lag: int | None = 1, expanding_lag: int | None = 1,
                     rolling: tuple | None = (1, 24), date_feats=("hour", "dayofweek")) -> DataFrame:
    """transformed target (optional differencing) + lags + lag transforms + date features; rows with any null
    dropped (the reference's ``preprocess``)."""
    d = panel
    if diff_lag:
        d = difference(d, 1, diff_lag, dropna=False)
    d = add_lags(d, lags)
    if expanding_lag:
        d = d.withColumn(f"expanding_mean_lag{expanding_lag}", expanding_mean(f"lag{expanding_lag}"))
    if rolling:
        lag_k, w = rolling
        d = d.withColumn(f"rolling_mean_lag{lag_k}_window_size{w}", rolling_mean(f"lag{lag_k}", w))
    d = d.withColumns(date_features("ds", date_feats))
    return d.dropna()
