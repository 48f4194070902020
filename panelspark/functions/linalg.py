"""The shared regression kernel: co-moments as Spark aggregates, tiny solves in Arrow batches.

``gram(df, keys, xcols, y)`` gives, per key, the row count, the columns' means and the *centred* products
``Σ w(z_i − z̄_i)(z_j − z̄_j)`` over the columns z = (x…, y).  Co-moments are merged pairwise, so nothing is lost to cancellation
at high levels, and they are partial/final: they scale over many series *and* over one very long series (each task
sums its rows of a key before the shuffle).  Only the small matrix per key reaches Python, as one row of a ``mapInPandas``
batch, where numpy solves it.  Any regression on a *subset* of the columns over the same rows, and on merged segments of rows, is
read off the same moments (nested lag orders, order grids, folds) without another pass.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From so many columns (y among them) on, moments come from Arrow batches: k(k+1)/2 separate ``covar_pop`` expressions would
#: be more than generated code holds.
BATCHES_FROM = 6
#: Keys whose moments a task holds before it sends them on.
HELD_KEYS = 5000


class Moments(NamedTuple):
    """Row count, weight, means and centred products of some columns, the target last; ``extra``: plain sums."""

    n: int
    w: float
    mean: np.ndarray
    c: np.ndarray
    extra: np.ndarray

    @classmethod
    def of(cls, row) -> Moments:
        """From a row of ``gram`` (or a struct of its columns)."""
        get = row.get if isinstance(row, dict) else lambda name: getattr(row, name)
        mean = np.asarray(get("mean"), float)
        c = np.zeros((len(mean), len(mean)))
        upper = np.triu_indices(len(mean))
        c[upper] = np.asarray(get("products"), float)
        c.T[upper] = c[upper]
        extra = get("extra")
        return cls(int(get("n")), float(get("w")), mean, c, np.asarray([] if extra is None else extra, float))

    @classmethod
    def over(cls, z: np.ndarray, w: np.ndarray, extra: np.ndarray) -> Moments:
        total = float(w.sum())
        mean = w @ z / total if total else np.zeros(z.shape[1])
        d = z - mean
        return cls(len(z), total, mean, (d * w[:, None]).T @ d, extra.sum(axis=0))

    def merge(self, other: Moments) -> Moments:
        w = self.w + other.w
        if not self.w or not other.w:
            one = self if self.w else other
            return one._replace(n=self.n + other.n, extra=self.extra + other.extra)
        d = other.mean - self.mean
        return Moments(self.n + other.n, w, self.mean + d * (other.w / w),
                       self.c + other.c + np.outer(d, d) * (self.w * other.w / w), self.extra + other.extra)

    def take(self, xs) -> Moments:
        """The moments of some of the regressors and the target."""
        at = [*xs, len(self.mean) - 1]
        return self._replace(mean=self.mean[at], c=self.c[np.ix_(at, at)])

    @property
    def constant_first(self) -> bool:
        # a weighted mean of ones may be off by its last digits
        return len(self.mean) > 1 and abs(self.mean[0] - 1.0) < 1e-12 and self.c[0, 0] <= 1e-20 * self.w

    def sse(self, beta: np.ndarray) -> float:
        """Σ w(y − xβ)²."""
        v = np.append(-np.asarray(beta, float), 1.0)
        return max(float(v @ self.c @ v), 0.0) + self.w * float(v @ self.mean) ** 2

    def system(self) -> tuple[np.ndarray, np.ndarray]:
        """X'X and X'y of the slopes: centred ones beside a constant first column, plain ones without."""
        if self.constant_first:
            return self.c[1:-1, 1:-1], self.c[1:-1, -1]
        raw = self.c + self.w * np.outer(self.mean, self.mean)
        return raw[:-1, :-1], raw[:-1, -1]

    def whole(self, slopes: np.ndarray) -> np.ndarray:
        """The coefficients from the slopes: the intercept before them, where the first column is constant."""
        if not self.constant_first:
            return slopes
        return np.concatenate([[self.mean[-1] - self.mean[1:-1] @ slopes], slopes])


def gram(df: DataFrame, keys, xcols, y: str, weight: str | None = None, extra=()) -> DataFrame:
    """Per key the ``Moments`` of (x…, y) as columns ``n, w, mean, products, extra`` (``products``: upper triangle, row-major).

    Rows with a null in any used column are skipped (the regression sample is the complete-case rows).  ``extra``: names of columns
    whose plain sums are wanted too."""
    keys, cols = list(keys), [*xcols, y]
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull()
    d = df.filter(ok)
    k = len(cols)
    if k >= BATCHES_FROM or weight or extra:
        w = F.col(weight) if weight else F.lit(1.0)
        z = [*[F.col(c).cast("double").alias(f"__z{i}") for i, c in enumerate(cols)], w.cast("double").alias("__w"),
             *[F.col(c).cast("double").alias(f"__e{i}") for i, c in enumerate(extra)]]
        return _gram_of_batches(d.select(*keys, *z), keys, k, len(extra))
    n = F.count("*")
    z = [F.col(c).cast("double") for c in cols]
    products = [F.covar_pop(z[i], z[j]) * n for i in range(k) for j in range(i, k)]
    return d.groupBy(*keys).agg(n.alias("n"), n.cast("double").alias("w"), F.array(*[F.avg(c) for c in z]).alias("mean"),
                                F.array(*products).alias("products"), F.lit(None).cast("array<double>").alias("extra"))


def _gram_of_batches(d: DataFrame, keys, k: int, n_extra: int) -> DataFrame:
    """Each task merges the moments of its batches by key; the tasks' parts of a key are merged as a sorted stream."""
    kinds = ", ".join(f"`{c}` {t}" for c, t in d.select(*keys).dtypes)
    schema = f"{kinds}, n bigint, w double, mean array<double>, products array<double>, extra array<double>"
    upper = np.triu_indices(k)
    names = [*keys, "n", "w", "mean", "products", "extra"]

    def frame(held: dict) -> pd.DataFrame:
        return pd.DataFrame([(*key, m.n, m.w, m.mean.tolist(), m.c[upper].tolist(), m.extra.tolist())
                             for key, m in held.items()], columns=names)

    def parts(batches):
        held: dict = {}
        for batch in batches:
            for key, g in batch.groupby(keys, dropna=False, sort=False):
                key = tuple(None if pd.isna(x) else x for x in key)
                m = Moments.over(g[[f"__z{i}" for i in range(k)]].to_numpy(), g["__w"].to_numpy(),
                                 g[[f"__e{i}" for i in range(n_extra)]].to_numpy(float))
                held[key] = held[key].merge(m) if key in held else m
            if len(held) > HELD_KEYS:
                yield frame(held)
                held = {}
        if held:
            yield frame(held)

    def merged(batches):
        key, m = None, None
        for batch in batches:
            done: dict = {}
            for r in batch.to_dict("records"):
                mine = tuple(None if not isinstance(r[c], str) and pd.isna(r[c]) else r[c] for c in keys)
                if m is not None and mine == key:
                    m = m.merge(Moments.of(r))
                    continue
                if m is not None:
                    done[key] = m
                key, m = mine, Moments.of(r)
            yield frame(done)
        if m is not None:
            yield frame({key: m})

    sent = d.mapInPandas(parts, schema).repartition(*keys).sortWithinPartitions(*keys)
    return sent.mapInPandas(merged, schema)


def ols(m: Moments, ridge: float = 0.0):
    """β, ssr, σ² = ssr/(n−p), se(β) of the last column on the others.  ``ridge``: α‖β‖² (a constant first column unpenalised)."""
    a, b = m.system()
    p = len(m.mean) - 1
    scale = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
    system = a / np.outer(scale, scale) + np.diag(ridge / scale ** 2)
    try:
        slopes = np.linalg.solve(system, b / scale) / scale
    except np.linalg.LinAlgError:
        slopes = np.linalg.lstsq(system, b / scale, rcond=None)[0] / scale
    beta = m.whole(slopes)
    ssr = m.sse(beta)
    s2 = ssr / (m.n - p) if m.n > p else float("nan")
    try:
        inverse = np.linalg.inv(system) / np.outer(scale, scale)
        var = np.diag(inverse)
        if m.constant_first:
            at = m.mean[1:-1]
            var = np.concatenate([[1.0 / m.w + at @ inverse @ at], var])
        se = np.sqrt(np.clip(var * s2, 0, None))
    except np.linalg.LinAlgError:
        se = np.full(p, np.nan)
    return beta, ssr, s2, se


def elastic_net(m: Moments, alpha: float, l1_ratio: float = 1.0, iters: int = 5000,
                tol: float = 1e-10) -> tuple[np.ndarray, bool]:
    """Coordinate descent on the moments (covariance updates) for ``1/(2n)‖y−Xβ‖² + α(ρ‖β‖₁ + (1−ρ)/2‖β‖²)``.
    A constant first column is an unpenalised intercept.  Returns the coefficients and whether they converged
    (no coefficient moved by ``tol`` relative to the largest) within ``iters`` sweeps."""
    a, b = m.system()
    beta = np.zeros(len(b))
    l1, l2 = alpha * l1_ratio * m.n, alpha * (1 - l1_ratio) * m.n
    for _ in range(iters):
        delta = 0.0
        for j in range(len(b)):
            if a[j, j] == 0:
                continue
            r = b[j] - a[j] @ beta + a[j, j] * beta[j]
            new = np.sign(r) * max(abs(r) - l1, 0.0) / (a[j, j] + l2)
            delta = max(delta, abs(new - beta[j]))
            beta[j] = new
        if delta <= tol * max(1.0, float(np.abs(beta).max(initial=0.0))):
            return m.whole(beta), True
    return m.whole(beta), False


def gaussian_ll(ssr: float, n: int) -> float:
    """Concentrated Gaussian log-likelihood ``−n/2·(ln 2π + ln σ̂² + 1)`` with σ̂² = ssr/n."""
    if n <= 0 or ssr <= 0:
        return float("nan")
    return -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)


def norm_cdf(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def norm_ppf(p):
    """Inverse standard normal CDF (Acklam's rational approximation + one Newton step), vectorised."""
    p = np.asarray(p, dtype=float)
    a = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02,
         -3.066479806614716e+01, 2.506628277459239e+00]
    b = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01,
         -1.328068155288572e+01]
    c = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00,
         4.374664141464968e+00, 2.938163982698783e+00]
    d = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00]
    lo, hi = 0.02425, 1 - 0.02425
    x = np.empty_like(p)
    q = np.sqrt(-2 * np.log(np.where(p < lo, p, 0.5)))
    x = np.where(p < lo, (((((c[0] * q + c[1]) * q + c[2]) * q + c[3]) * q + c[4]) * q + c[5]) /
                 ((((d[0] * q + d[1]) * q + d[2]) * q + d[3]) * q + 1), x)
    qm = p - 0.5
    r = qm * qm
    mid = (((((a[0] * r + a[1]) * r + a[2]) * r + a[3]) * r + a[4]) * r + a[5]) * qm / \
          (((((b[0] * r + b[1]) * r + b[2]) * r + b[3]) * r + b[4]) * r + 1)
    x = np.where((p >= lo) & (p <= hi), mid, x)
    q2 = np.sqrt(-2 * np.log(np.where(p > hi, 1 - p, 0.5)))
    x = np.where(p > hi, -(((((c[0] * q2 + c[1]) * q2 + c[2]) * q2 + c[3]) * q2 + c[4]) * q2 + c[5]) /
                 ((((d[0] * q2 + d[1]) * q2 + d[2]) * q2 + d[3]) * q2 + 1), x)
    # one Newton refinement on erfc
    from math import erfc, exp, pi, sqrt
    e = np.vectorize(lambda v: 0.5 * erfc(-v / sqrt(2)))(x) - p
    u = e * np.sqrt(2 * pi) * np.exp(x * x / 2)
    return x - u / (1 + x * u / 2)
