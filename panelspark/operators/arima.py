"""Seasonal ARIMA with exogenous columns (H11, H12, H14) on the Gram kernel.

Our definition: the series and its exogenous columns are differenced alike, ``(1−B)^d (1−B^m)^D``; the result is
regressed on its lags 1…p and m, 2m…Pm, on residual lags 1…q and m…Qm (Hannan–Rissanen: the residuals of a long
autoregression) and on the differenced exogenous columns.  Forecasts run the recursion with future residuals 0 and undo
the differencing with the expanded polynomial; bounds are ``ŷ ± z·σ·√Σψ²`` with the ψ-weights of the full model.

Features are windows over panels, fits are per-series Grams (partial/final aggregates); only coefficients and the last
few values of a series reach ``mapInPandas``.  The order search reads every order from one Gram and forecasts all series
in one pass, whatever orders they got.
"""

from __future__ import annotations

import math
from itertools import product
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.linalg import Moments, gaussian_ll, gram, norm_ppf, ols
from panelspark.operators.regression import fit_linear, predict_linear
from panelspark.operators.windows import _W
from panelspark.sources.panels import check_panel, future_frame, tail_rows


class Order(NamedTuple):
    p: int = 0
    d: int = 0
    q: int = 0
    P: int = 0
    D: int = 0
    Q: int = 0
    m: int = 1

    def check(self) -> Order:
        if any(not isinstance(x, int) or x < 0 for x in self):
            raise ValueError(f"orders are whole numbers from 0: {tuple(self)}")
        if (self.P or self.D or self.Q) and self.m < 2:
            raise ValueError("a seasonal order needs a season length m of 2 or more")
        return self

    def lags(self, short: int, seasonal: int) -> list[int]:
        return sorted({*range(1, short + 1), *(self.m * i for i in range(1, seasonal + 1))})

    @property
    def ar(self) -> list[int]:
        return self.lags(self.p, self.P)

    @property
    def ma(self) -> list[int]:
        return self.lags(self.q, self.Q)

    @property
    def steps(self) -> list[int]:
        """The lags of the single differences."""
        return [1] * self.d + [self.m] * self.D

    @property
    def polynomial(self) -> np.ndarray:
        """The coefficients of (1−B)^d (1−B^m)^D, constant first."""
        out = np.ones(1)
        for lag in self.steps:
            out = np.convolve(out, [1.0, *[0.0] * (lag - 1), -1.0])
        return out

    def __str__(self) -> str:
        seasonal = f"({self.P},{self.D},{self.Q})[{self.m}]" if self.m > 1 else ""
        return f"({self.p},{self.d},{self.q}){seasonal}"


def _design(panel: DataFrame, order: Order, long_ar: int, col: str, exog=()) -> tuple[DataFrame, list[str]]:
    """The differenced series ``__w``, its lags, residuals ``__e`` and their lags, differenced exogenous columns; and the
    regressors' names."""
    check_panel(panel)
    w = _W()
    d = panel.withColumns({"__w": F.col(col).cast("double"), **{f"__x_{e}": F.col(e).cast("double") for e in exog}})
    made = ["__w", *[f"__x_{e}" for e in exog]]
    for lag in order.steps:
        d = d.withColumns({c: F.col(c) - F.lag(c, lag).over(w) for c in made})
    d = d.withColumns({"__one": F.lit(1.0), "__e": F.lit(0.0), **{f"__ar{k}": F.lag("__w", k).over(w) for k in order.ar}})
    if order.ma:
        deep = max(long_ar, *order.ma)
        long = ["__one", *[f"__la{k}" for k in range(1, deep + 1)]]
        d = d.withColumns({f"__la{k}": F.lag("__w", k).over(w) for k in range(1, deep + 1)})
        first = fit_linear(d, ["unique_id"], long, "__w")
        d = predict_linear(d, first, ["unique_id"], long, "__fit").withColumn("__e", F.col("__w") - F.col("__fit"))
        d = d.withColumns({f"__ma{k}": F.lag("__e", k).over(w) for k in order.ma})
    return d, ["__one", *[f"__ar{k}" for k in order.ar], *[f"__ma{k}" for k in order.ma], *[f"__x_{e}" for e in exog]]


def hannan_rissanen(panel: DataFrame, order: Order, long_ar: int = 8, col: str = "y", exog=()) -> DataFrame:
    """Coefficients ``[c, φ…, θ…, β…]`` (lags ascending) with ``ssr``, ``n``, ``sigma2`` and the order."""
    d, x = _design(panel, order.check(), long_ar, col, exog)
    return fit_linear(d, ["unique_id"], x, "__w").withColumn("order", F.lit(str(order)))


# ---------------------------------------------------------------- order search

_GRID = ["unique_id", "p", "q", "P", "Q", "order", "loglik", "aic", "bic", "n", "coef", "sigma2"]


def arma_grid_aic(panel: DataFrame, most: Order, long_ar: int = 8, col: str = "y", best: bool = False) -> DataFrame:
    """Every (p, q)(P, Q) up to ``most`` (its d, D and m hold for all) scored by AIC from ONE Gram over all lag
    columns (subsets of a common sample).  ``coef`` has the places of ``most``, zero where an order has no term.
    ``best``: the one with the least AIC per series (ties: the first in (p, q, P, Q))."""
    d, cols = _design(panel, most.check(), long_ar, col)
    g = gram(d, ["unique_id"], cols, "__w")
    ar, ma, size = most.ar, most.ma, len(cols)

    def score(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = Moments.of(r)
                n = m.n
                rows = []
                for p, q, sp, sq in product(*(range(x + 1) for x in (most.p, most.q, most.P, most.Q))):
                    one = Order(p, most.d, q, sp, most.D, sq, most.m)
                    at = [0, *(1 + ar.index(k) for k in one.ar), *(1 + len(ar) + ma.index(k) for k in one.ma)]
                    beta, ssr, sigma2, _ = ols(m.take(at))
                    k, ll = len(at) + 1, gaussian_ll(ssr, n)
                    coef = np.zeros(size)
                    coef[at] = beta
                    rows.append((r.unique_id, p, q, sp, sq, str(one), ll, 2 * k - 2 * ll, k * math.log(max(n, 1)) - 2 * ll,
                                 n, coef.tolist(), sigma2))
                out += [min(rows, key=lambda x: (math.isnan(x[7]), x[7]))] if best else rows
            yield pd.DataFrame(out, columns=_GRID)

    return g.mapInPandas(score, "unique_id string, p int, q int, P int, Q int, order string, loglik double, aic double, "
                                "bic double, n bigint, coef array<double>, sigma2 double")


# ---------------------------------------------------------------- forecasts

def _paths(panel: DataFrame, d: DataFrame, fits: DataFrame, order: Order, h: int, freq: str, levels, col: str, exog,
           future_exog: DataFrame | None) -> DataFrame:
    """Forecasts of all series from their coefficients (the places of ``order``) and their last values."""
    delta = order.polynomial
    keep = max([1, len(delta) - 1, *order.ar, *order.ma])
    fut = future_frame(panel, h, freq)
    raw = [col, *exog]
    tail = tail_rows(d.select("unique_id", "ds", *raw, "__w", "__e"), keep, freq)
    st = tail.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", *raw, "__w", "__e"))).alias("__t"))

    def values(name):
        return lambda s: F.coalesce(s[name].cast("double"), F.lit(0.0))

    st = st.select("unique_id", *[F.transform("__t", values(c)).alias(f"h_{i}") for i, c in enumerate(raw)],
                   F.transform("__t", values("__w")).alias("ws"), F.transform("__t", values("__e")).alias("es"))
    st = st.join(fits.select("unique_id", "coef", "sigma2", "order"), "unique_id")
    if exog:
        keys = ["ds"] + (["unique_id"] if "unique_id" in future_exog.columns else [])
        fx = fut.join(future_exog.select(*keys, *exog), keys, "left")
        fx = fx.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("step", *exog))).alias("__x"))  # h rows
        st = st.join(fx.select("unique_id", *[F.transform("__x", (lambda e: lambda s: s[e].cast("double"))(e)).alias(f"f_{i}")
                                              for i, e in enumerate(exog, 1)]), "unique_id", "left")
    zs = [float(norm_ppf(0.5 + level / 200.0)) for level in levels]
    bounds = [f"{s}_{level}" for level in levels for s in ("lo", "hi")]
    cols = ["unique_id", "step", "yhat", *bounds, "order"]
    schema = ", ".join(["unique_id string", "step int", "yhat double", *[f"{b} double" for b in bounds], "order string"])

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                coef = np.asarray(r.coef, float)
                n_ar, n_ma = len(order.ar), len(order.ma)
                phi, theta, beta = np.split(coef[1:], [n_ar, n_ar + n_ma])
                ys, ws, es = list(map(float, r.h_0)), list(map(float, r.ws)), list(map(float, r.es))
                pull = []  # what the differenced exogenous columns add to each step
                for i, e in enumerate(exog, 1):
                    ahead = getattr(r, f"f_{i}")
                    if ahead is None or len(ahead) < h or any(v is None or math.isnan(v) for v in ahead):
                        raise ValueError(f"series {r.unique_id!r}: exogenous column {e!r} lacks a future value")
                    xs = [*map(float, getattr(r, f"h_{i}")), *map(float, ahead)]
                    pull.append([beta[i - 1] * sum(c * xs[len(xs) - h + t - k] for k, c in enumerate(delta))
                                 for t in range(h)])
                forecast = []
                for t in range(h):
                    w = coef[0] + sum(f * ws[-k] for f, k in zip(phi, order.ar)) \
                        + sum(f * es[-k] for f, k in zip(theta, order.ma)) + sum(x[t] for x in pull)
                    y = w - sum(c * ys[-k] for k, c in enumerate(delta) if k)
                    ws.append(w)
                    es.append(0.0)
                    ys.append(y)
                    forecast.append(y)
                own = np.zeros(max([0, *order.ar]) + 1)
                own[0] = 1.0
                own[order.ar] = -phi
                full = np.convolve(own, delta)
                moved = np.zeros(max([h, *order.ma]) + 1)
                moved[0] = 1.0
                moved[order.ma] = theta
                psi = []
                for j in range(h):
                    psi.append(moved[j] - sum(full[k] * psi[j - k] for k in range(1, min(j, len(full) - 1) + 1)))
                sd = np.sqrt(max(float(r.sigma2), 0.0) * np.cumsum(np.square(psi)))
                for s in range(h):
                    out.append([r.unique_id, s + 1, forecast[s],
                                *(v for z in zs for v in (forecast[s] - z * sd[s], forecast[s] + z * sd[s])), r.order])
            yield pd.DataFrame(out, columns=cols)

    return fut.join(st.mapInPandas(run, schema), ["unique_id", "step"])


def arima_forecast(panel: DataFrame, order: Order, h: int, freq: str, long_ar: int = 8, levels=(95,), col: str = "y",
                   exog=(), future_exog: DataFrame | None = None) -> DataFrame:
    """H-step forecasts with normal bounds, ``unique_id, step, ds, yhat, lo_L, hi_L, order``.

    ``exog`` columns of ``panel`` enter the regression, differenced like the series; ``future_exog`` (``ds``
    [, ``unique_id``] and the same columns) has their future values.  A missing future value is an error."""
    if exog and future_exog is None:
        raise ValueError("exogenous columns need their future values")
    d, x = _design(panel, order.check(), long_ar, col, exog)
    fits = fit_linear(d, ["unique_id"], x, "__w").withColumn("order", F.lit(str(order)))
    return _paths(panel, d, fits, order, h, freq, levels, col, list(exog), future_exog)


def auto_arima_forecast(panel: DataFrame, h: int, freq: str, most: Order, long_ar: int = 8, levels=(95,),
                        col: str = "y") -> DataFrame:
    """H14 + H11: every series gets its AIC-best order up to ``most`` from one Gram, and all are forecast in one pass."""
    d, _ = _design(panel, most.check(), long_ar, col)
    fits = arma_grid_aic(panel, most, long_ar, col, best=True)
    return _paths(panel, d, fits, most, h, freq, levels, col, [], None)


# ---------------------------------------------------------------- choice of the differences

#: KPSS critical value for a level at 5 %, and the seasonal strength from which a series is differenced seasonally (fixed values).
KPSS_LEVEL, STRENGTH = 0.463, 0.64


def kpss(panel: DataFrame, col: str = "y", chunk_rows: int = 100_000, time_bucket: str = "month") -> DataFrame:
    """(unique_id, n, lags, kpss): ``Σ S_t² / (n²·λ²)`` with the partial sums S of y − ȳ and the long-run variance λ² from the
    autocovariances up to lag ⌊4(n/100)^¼⌋ with Bartlett weights; null for a constant series.

    Partial sums are a prefix scan: each chunk of a series gives its sum, Σ s and Σ s² of its own partial sums, and the sums
    before a chunk come from the small table of chunks, ``Σ (o + s)² = m·o² + 2·o·Σ s + Σ s²``."""
    from panelspark.functions.chunking import positions
    from panelspark.operators.explore import acf

    d = panel.select("unique_id", "ds", F.col(col).cast("double").alias("y")).where(F.col("y").isNotNull())
    stats = d.groupBy("unique_id").agg(F.count("*").alias("n"), F.avg("y").alias("__mu"), F.var_pop("y").alias("__var"))
    lags = F.floor(4 * F.pow(F.col("n") / 100.0, 0.25)).cast("int")
    stats = stats.withColumn("lags", F.least(lags, (F.col("n") - 1).cast("int")))
    most = stats.agg(F.max("lags")).first()[0] or 0  # one number sizes the plan
    p = positions(d, time_bucket).join(stats.select("unique_id", "__mu"), "unique_id")
    p = p.select("unique_id", "__pos", F.floor(F.col("__pos") / chunk_rows).alias("__chunk"), (F.col("y") - F.col("__mu")).alias("__e"))
    inside = Window.partitionBy("unique_id", "__chunk").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("__s", F.sum("__e").over(inside))
    chunks = p.groupBy("unique_id", "__chunk").agg(F.count("*").alias("__m"), F.sum("__e").alias("__t"), F.sum("__s").alias("__s1"),
                                                   F.sum(F.col("__s") * F.col("__s")).alias("__s2"))
    earlier = Window.partitionBy("unique_id").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    o = F.coalesce(F.sum("__t").over(earlier), F.lit(0.0))
    chunks = chunks.withColumn("__o", o)
    sums = chunks.groupBy("unique_id").agg(F.sum(
        F.col("__m") * F.col("__o") * F.col("__o") + 2 * F.col("__o") * F.col("__s1") + F.col("__s2")).alias("__sum"))
    r = acf(d, nlags=max(most, 1)).join(stats.select("unique_id", "lags"), "unique_id").where((F.col("lag") >= 1) & (F.col("lag") <= F.col("lags")))
    tail = r.groupBy("unique_id").agg(F.sum((1 - F.col("lag") / (F.col("lags") + 1)) * F.col("acf")).alias("__r"))
    out = stats.join(sums, "unique_id").join(tail, "unique_id", "left")
    spread = F.col("__var") * (1 + 2 * F.coalesce("__r", F.lit(0.0)))
    return out.select("unique_id", "n", "lags", F.try_divide(F.col("__sum") / (F.col("n") * F.col("n")), spread).alias("kpss"))


def choose_differences(panel: DataFrame, m: int = 1, max_d: int = 2, max_D: int = 1, chunk_rows: int = 100_000) -> DataFrame:
    """H14 (d and D per series): D = 1 if the seasonal strength ``1 − var(resid)/var(seasonal + resid)`` of the decomposition with
    period m is over 0.64; then d = the least number of differences (at most ``max_d``) after which KPSS keeps the level
    stationary at 5 %.  A few passes over all series together, none per series: ``(unique_id, d, seasonal_d)``."""
    from panelspark.operators.explore import decompose
    from panelspark.operators.windows import difference
    from panelspark.session import cut_lineage

    base = cut_lineage(panel.select("unique_id", "ds", F.col("y").cast("double").alias("y")))
    ids = base.select("unique_id").distinct()
    if m > 1 and max_D:
        dec = decompose(base, m)
        seasonal = F.when(F.col("resid").isNotNull(), F.col("seasonal") + F.col("resid"))
        strength = 1 - F.try_divide(F.var_pop("resid"), F.var_pop(seasonal))
        chosen = dec.groupBy("unique_id").agg(F.coalesce(strength > STRENGTH, F.lit(False)).cast("int").alias("seasonal_d"))
    else:
        chosen = ids.withColumn("seasonal_d", F.lit(0))
    chosen = cut_lineage(chosen)
    flat = base.join(chosen.where("seasonal_d = 1"), "unique_id", "left_semi")
    series = base.join(chosen.where("seasonal_d = 0"), "unique_id", "left_semi").unionByName(difference(flat, 1, m) if m > 1 else flat)
    chosen = chosen.withColumn("d", F.lit(0))
    for k in range(max_d):
        series = cut_lineage(series)
        moving = cut_lineage(kpss(series, chunk_rows=chunk_rows).where(F.col("kpss") > KPSS_LEVEL).select("unique_id"))
        again = moving.withColumn("__more", F.lit(1))
        chosen = chosen.join(again, "unique_id", "left").withColumn(
            "d", F.col("d") + F.coalesce("__more", F.lit(0))).drop("__more")
        series = difference(series.join(moving, "unique_id", "left_semi"), 1)
    return chosen.select("unique_id", "d", "seasonal_d")


def auto_order_forecast(panel: DataFrame, h: int, freq: str, most: Order, long_ar: int = 8, levels=(95,)) -> DataFrame:
    """H14 + H11 with chosen differences: every series gets its d ≤ ``most.d`` and D ≤ ``most.D`` (``choose_differences``), then its
    AIC-best (p, q)(P, Q), and is forecast.  Series of the same (d, D) share one Gram; there are (d + 1)·(D + 1) such sets."""
    from panelspark.session import cut_lineage

    panel = cut_lineage(panel.select("unique_id", "ds", "y"))
    chosen = cut_lineage(choose_differences(panel, most.m, most.d, most.D))
    out = None
    for d, seasonal in sorted(map(tuple, chosen.select("d", "seasonal_d").distinct().collect())):  # at most (d + 1)·(D + 1) pairs
        some = panel.join(chosen.where((F.col("d") == d) & (F.col("seasonal_d") == seasonal)), "unique_id", "left_semi")
        part = auto_arima_forecast(some, h, freq, most._replace(d=d, D=seasonal), long_ar, levels)
        out = part if out is None else out.unionByName(part)
    return out
