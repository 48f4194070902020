"""Per-series regression models on the Gram kernel.

Pattern: feature columns by windows → ``gram`` (a Spark aggregate) → per-key solve in ``mapInPandas`` (one small row per
series) → coefficients as a DataFrame → predictions by joining coefficients back to feature rows.  No series is
collected; the row data never leaves the JVM.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.chunking import positions
from panelspark.functions.linalg import Moments, elastic_net, gaussian_ll, gram, norm_cdf, ols
from panelspark.operators.windows import _W
from panelspark.sources.panels import check_panel


# ---------------------------------------------------------------- generic per-key linear fits

def fit_linear(df: DataFrame, keys, xcols, y: str, method: str = "ols", alpha: float = 0.0,
               l1_ratio: float = 0.5) -> DataFrame:
    """H9: per-key linear / ridge / lasso / elastic-net.  Column 0 of ``xcols`` is taken as the (unpenalised)
    intercept column when it is a constant 1.  Returns ``keys…, coef array<double>, n, ssr, sigma2, converged`` (false if
    the coordinate descent ran out of sweeps; closed forms are always converged)."""
    keys = list(keys)
    g = gram(df, keys, xcols, y)
    p = len(xcols)
    schema = ", ".join([f"{k} {t}" for k, t in df.select(*keys).dtypes] +
                       ["coef array<double>", "n bigint", "ssr double", "sigma2 double", "converged boolean"])

    def solve(batches):
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                m = Moments.of(r)
                if method in ("lasso", "elastic"):
                    beta, done = elastic_net(m, alpha, 1.0 if method == "lasso" else l1_ratio)
                    ssr = m.sse(beta)
                    s2 = ssr / max(m.n - p, 1)
                else:
                    beta, ssr, s2, _ = ols(m, ridge=alpha if method == "ridge" else 0.0)
                    done = True
                rows.append([*[getattr(r, k) for k in keys], beta.tolist(), m.n, ssr, s2, done])
            yield pd.DataFrame(rows, columns=[*keys, "coef", "n", "ssr", "sigma2", "converged"])

    return g.mapInPandas(solve, schema)


def predict_linear(features: DataFrame, coefs: DataFrame, keys, xcols, out: str = "yhat") -> DataFrame:
    """``Σ coef[i]·x_i`` after joining the per-key coefficients to the feature rows."""
    j = features.join(coefs.select(*keys, "coef"), list(keys), "left")
    pred = sum((F.col("coef")[i] * F.col(c) for i, c in enumerate(xcols)), F.lit(0.0))
    return j.withColumn(out, pred).drop("coef")


def information_criteria(ssr_col: str = "ssr", n_col: str = "n", k: int = 2):
    """ll = −n/2·(ln 2π + ln σ̂² + 1); AIC = 2k − 2ll; BIC = k ln n − 2ll (k counts σ²) as Columns."""
    n = F.col(n_col).cast("double")
    ll = -n / 2 * (F.log(F.lit(2 * math.pi)) + F.log(F.try_divide(F.col(ssr_col), n)) + 1)
    return ll, 2 * k - 2 * ll, k * F.log(n) - 2 * ll


# ---------------------------------------------------------------- F21 augmented Dickey–Fuller

ADF_SCHEMA = ("unique_id string, adf_stat double, p_value double, used_lag int, nobs int, crit_1 double, "
              "crit_5 double, crit_10 double, stationary boolean")


def _mackinnon_p(t: float) -> float:
    """MacKinnon (1994) approximate p-value, constant only, one variable (fixed coefficients, see SURVEY §7.3)."""
    if t < -18.83:
        return 0.0
    if t > 2.74:
        return 1.0
    if t <= -1.61:
        return norm_cdf(2.1659 + 1.4412 * t + 0.038269 * t * t)
    return norm_cdf(1.7339 + 0.93202 * t - 0.12745 * t * t - 0.010368 * t ** 3)


def _crit(T: int):
    """MacKinnon (2010) critical values, constant only (fixed coefficients)."""
    return (-3.43035 - 6.5393 / T - 16.786 / T ** 2 - 79.433 / T ** 3,
            -2.86154 - 2.8903 / T - 4.234 / T ** 2 - 40.040 / T ** 3,
            -2.56677 - 1.5384 / T - 2.809 / T ** 2)


def _pmax(n):
    return F.least(F.ceil(12 * F.pow(F.col(n) / 100.0, 0.25)), F.floor(F.col(n) / 2) - 2).cast("int")


def adf(panel: DataFrame, maxlag: int | None = None, col: str = "y") -> DataFrame:
    """``Δy_t = c + γ·y_{t−1} + Σ_{i≤p} δ_i·Δy_{t−i}``; p chosen by AIC on the common sample (lags up to
    ``min(⌈12(n/100)^¼⌉, n//2−2)``), refit on all usable rows; statistic γ̂/se(γ̂), MacKinnon p-value and critical values.

    Two aggregate passes; the lag columns of all candidate orders are nested, so the search reads one Gram."""
    check_panel(panel)
    w = _W()
    d = panel.select("unique_id", "ds", F.col(col).alias("yv"))
    d = d.withColumns({"pos": F.row_number().over(w) - 1, "n_s": F.count("*").over(Window.partitionBy("unique_id")),
                       "dy": F.col("yv") - F.lag("yv", 1).over(w), "ylag": F.lag("yv", 1).over(w)})
    d = d.withColumn("pmax", _pmax("n_s"))
    if maxlag is None:
        maxlag = d.agg(F.max("pmax")).first()[0] or 0  # one number sizes the lag columns of the plan
    P = max(int(maxlag), 0)
    d = d.withColumns({"one": F.lit(1.0), **{f"dl{i}": F.lag("dy", i).over(w) for i in range(1, P + 1)}})
    xcols = ["one", "ylag"] + [f"dl{i}" for i in range(1, P + 1)]

    def masked(frame, limit):  # lags beyond the series' own limit are zero columns (unused leading-block tail)
        return frame.withColumns({f"dl{i}": F.when(F.lit(i) <= F.col(limit), F.col(f"dl{i}")).otherwise(0.0)
                                  for i in range(1, P + 1)})

    rows1 = masked(d, "pmax").filter(F.col("pos") >= F.col("pmax") + 1)
    g1 = gram(rows1, ["unique_id", "pmax"], xcols, "dy")

    def choose(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = Moments.of(r)
                best, best_p = None, 0
                for p in range(0, min(int(r.pmax), P) + 1):
                    k = 2 + p
                    _, ssr, _, _ = ols(m.take(range(k)))
                    aic = -2 * gaussian_ll(ssr, m.n) + 2 * k
                    if best is None or aic < best:
                        best, best_p = aic, p
                out.append((r.unique_id, best_p))
            yield pd.DataFrame(out, columns=["unique_id", "lags"])

    chosen = g1.mapInPandas(choose, "unique_id string, lags int")
    rows2 = masked(d.join(chosen, "unique_id"), "lags").filter(F.col("pos") >= F.col("lags") + 1)
    g2 = gram(rows2, ["unique_id", "lags"], xcols, "dy")

    def final(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                k = 2 + int(r.lags)
                m = Moments.of(r)
                n = m.n
                beta, _, _, se = ols(m.take(range(k)))
                stat = float(beta[1] / se[1]) if se[1] > 0 else float("nan")
                pv = _mackinnon_p(stat) if stat == stat else float("nan")
                c1, c5, c10 = _crit(n)
                out.append((r.unique_id, stat, pv, int(r.lags), n, c1, c5, c10, bool(pv < 0.05)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in ADF_SCHEMA.split(", ")])

    return g2.mapInPandas(final, ADF_SCHEMA)


# ---------------------------------------------------------------- AR / ARMA by Hannan–Rissanen

def ar_design(panel: DataFrame, p: int, col: str = "y", prefix: str = "ar") -> DataFrame:
    w = _W()
    return panel.withColumns({"__one": F.lit(1.0), **{f"{prefix}{i}": F.lag(col, i).over(w) for i in range(1, p + 1)}})


def fit_ar(panel: DataFrame, p: int = 1, col: str = "y") -> DataFrame:
    """AR(p) with constant by least squares per series: ``coef`` = [c, φ1…φp], ``ssr``, ``n``."""
    d = ar_design(panel, p, col)
    return fit_linear(d, ["unique_id"], ["__one", *[f"ar{i}" for i in range(1, p + 1)]], col)


def model_comparison(panel: DataFrame) -> DataFrame:
    """Log-likelihood, AIC and BIC of AR(1) and a linear trend per series (k = 3 with σ²)."""
    ar = fit_ar(panel, 1).select("unique_id", F.lit("AR(1)").alias("model"), "ssr", "n")
    t = panel.withColumns({"__one": F.lit(1.0), "__t": F.row_number().over(_W()).cast("double")})
    lin = fit_linear(t, ["unique_id"], ["__one", "__t"], "y").select("unique_id", F.lit("linear trend").alias("model"),
                                                                      "ssr", "n")
    u = ar.unionByName(lin)
    ll, aic, bic = information_criteria("ssr", "n", 3)
    return u.select("unique_id", "model", ll.alias("loglik"), aic.alias("aic"), bic.alias("bic"), "n")


# ---------------------------------------------------------------- H13 forecasting from given coefficients

def ar_forecast(panel: DataFrame, coefs: DataFrame, h: int, p: int, col: str = "y", freq: str | None = None) -> DataFrame:
    """H13 (and H11 forecasts): recursion ``ŷ = c + Σ φ_i·ŷ_{t−i}`` for h steps from given coefficients
    ``coefs(unique_id, coef=[c, φ1…φp])`` — no optimisation.  The state is the last p values per series; the
    recursion is one SQL ``aggregate`` over ``sequence(1, h)`` (JVM-side), returned as ``(unique_id, step, yhat)``."""
    from panelspark.sources.panels import tail_rows

    last = tail_rows(panel, p, freq)  # ≤ p rows per series
    st = last.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct(F.col("ds"), F.col(col)))).alias("__l"))
    st = st.select("unique_id", F.transform("__l", lambda s: s[col]).alias("hist"))
    j = st.join(coefs.select("unique_id", "coef"), "unique_id")

    def step(acc, _k):
        nxt = F.col("coef")[0]
        for i in range(1, p + 1):
            nxt = nxt + F.col("coef")[i] * F.element_at(acc, -i)
        return F.concat(acc, F.array(nxt))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(h)), F.col("hist"), step)
    return j.select("unique_id", F.posexplode(F.slice(path, p + 1, h)).alias("__i", "yhat")) \
            .select("unique_id", (F.col("__i") + 1).alias("step"), "yhat")


# ---------------------------------------------------------------- H5 pooled split-conformal interval

def split_conformal(df: DataFrame, keys, xcols, y: str, alpha: float = 0.1, n_splits: int = 5, seed: int = 42,
                    id_col: str = "ds") -> DataFrame:
    """H5: ``n_splits`` seeded random 80/20 splits (hash of key, row id and split); per (key, split) a least-squares fit
    on the 80 %; the absolute test errors of all splits pooled; ``q`` = their exact (1−α) quantile per key.  Returns
    ``keys…, q`` and the full-data coefficients (for ŷ ± q)."""
    keys = list(keys)
    splits = F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("split")
    d = df.select("*", splits)
    u = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.col(id_col), F.col("split"), F.lit(seed)), F.lit(10007)) / 10007.0
    d = d.withColumn("__train", u < 0.8)
    coefs = fit_linear(d.filter("__train"), [*keys, "split"], xcols, y)
    test = predict_linear(d.filter(~F.col("__train")), coefs, [*keys, "split"], xcols, "__p")
    q = test.groupBy(*keys).agg(F.percentile(F.abs(F.col(y) - F.col("__p")), F.lit(1 - alpha)).alias("q"))
    full = fit_linear(df, keys, xcols, y)
    return full.join(q, keys)


# ---------------------------------------------------------------- H19 per-series regularisation search

def ridge_alpha_search(df: DataFrame, xcols, y: str, h: int, n_windows: int, alphas=(0.0, 0.1, 1.0, 10.0, 100.0)):
    """Every series gets its own ridge α by rolling-origin error, in ONE aggregate pass.

    Rows are tagged with their segment between consecutive origins; fold i trains on segments ≤ i and tests on
    segment i+1, so the moments of a fold are those of its *segments merged* and the test SSE of any β is read off the test
    segment's moments — no row is replicated per fold or per α."""
    per = _segment_moments(df, xcols, y, h, n_windows)
    p = len(xcols)

    def search(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                errs = {a: [] for a in alphas}
                for train, test in _folds(r.segs, n_windows):
                    if test is None or train is None or train.n <= p:
                        continue
                    for a in alphas:
                        errs[a].append(test.sse(ols(train, ridge=a)[0]) / test.n)
                scored = [(float(np.mean(v)), a) for a, v in errs.items() if v]
                if scored:
                    mse, best = min(scored)
                    out.append((r.unique_id, float(best), float(np.sqrt(mse))))
            yield pd.DataFrame(out, columns=["unique_id", "alpha", "cv_rmse"])

    return per.mapInPandas(search, "unique_id string, alpha double, cv_rmse double")


#: Families and settings of the search per series: (family, α, share of the absolute penalty).
FAMILIES = (("linear", 0.0, 0.0), *(("ridge", a, 0.0) for a in (0.1, 1.0, 10.0, 100.0)),
            *(("lasso", a, 1.0) for a in (0.01, 0.1, 1.0)), *(("elastic", a, 0.5) for a in (0.01, 0.1, 1.0)))


def family_search(df: DataFrame, xcols, y: str, h: int, n_windows: int, grid=FAMILIES) -> DataFrame:
    """H19 over families: every series gets the family and setting with the least rolling-origin error (ties: the first of
    ``grid``), all read off the segment moments of ONE aggregate pass — no loop over ids, no refit over rows.  Families are those
    that the moments determine: linear, ridge, lasso, elastic net.  Returns ``unique_id, family, alpha, l1_ratio, cv_rmse, coef``
    (the chosen setting's coefficients on all rows)."""
    per = _segment_moments(df, xcols, y, h, n_windows)
    p = len(xcols)

    def solve(m, family, alpha, share):
        return elastic_net(m, alpha, share)[0] if family in ("lasso", "elastic") else ols(m, ridge=alpha)[0]

    def search(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                folds = [(train, test) for train, test in _folds(r.segs, n_windows)]
                fair = [(train, test) for train, test in folds if train is not None and test is not None and train.n > p]
                if not fair:
                    continue
                scored = [(float(np.mean([test.sse(solve(train, *one)) / test.n for train, test in fair])), i)
                          for i, one in enumerate(grid)]
                mse, best = min(scored)
                whole, rest = folds[-1]
                whole = whole if rest is None else whole.merge(rest)
                out.append((r.unique_id, *grid[best], math.sqrt(mse), solve(whole, *grid[best]).tolist()))
            yield pd.DataFrame(out, columns=["unique_id", "family", "alpha", "l1_ratio", "cv_rmse", "coef"])

    return per.mapInPandas(search, "unique_id string, family string, alpha double, l1_ratio double, cv_rmse double, "
                                   "coef array<double>")


def segments(df: DataFrame, h: int, n_windows: int) -> DataFrame:
    """Adds ``seg``: 0 before the first of ``n_windows`` origins h rows apart, i for the h rows after the i-th; and ``step``, the
    row's place in them from 1."""
    w = _W()
    d = df.withColumns({"__pos": F.row_number().over(w) - 1, "__n": F.count("*").over(Window.partitionBy("unique_id"))})
    after = F.col("__pos") - (F.col("__n") - n_windows * h)
    seg = F.when(after < 0, 0).otherwise(F.floor(after / h) + 1).cast("int")
    return d.withColumns({"seg": seg, "step": (F.pmod(after, F.lit(h)) + 1).cast("int")}).drop("__pos", "__n")


def _segment_moments(df: DataFrame, xcols, y: str, h: int, n_windows: int) -> DataFrame:
    """One row per series with the moments of its segments (``n_windows`` + 1 of them)."""
    g = gram(segments(df, h, n_windows), ["unique_id", "seg"], xcols, y)
    return g.groupBy("unique_id").agg(
        F.sort_array(F.collect_list(F.struct("seg", "n", "w", "mean", "products", "extra"))).alias("segs"))


def _folds(segs, n_windows: int):
    """(moments before an origin, moments of the rows after it) for each origin; None where there are no rows."""
    by = {int(s["seg"]): Moments.of(s if isinstance(s, dict) else s.asDict()) for s in segs}
    train = None
    for i in range(n_windows):
        if i in by:
            train = by[i] if train is None else train.merge(by[i])
        yield train, by.get(i + 1)


def linear_intervals(history: DataFrame, future: DataFrame, xcols, y: str, h: int, n_windows: int = 4, levels=(80, 95),
                     method: str = "ols", alpha: float = 0.0, l1_ratio: float = 0.5, name: str = "yhat") -> DataFrame:
    """H9 with intervals: per-series linear forecasts of ``future`` (``unique_id, ds, step`` and the regressors) with conformal
    bounds.  The coefficients at each of ``n_windows`` origins h rows apart come from merged segment moments of one pass (no
    refits over rows); the absolute errors of the h rows after each origin are pooled by step, and the interval at level L is
    ŷ + the (100∓L)/2 percentiles of the pooled {±s} (``n_windows`` × 2 values a pool)."""
    per = _segment_moments(history, xcols, y, h, n_windows)
    p = len(xcols)

    def solve(m):
        if method in ("lasso", "elastic"):
            return elastic_net(m, alpha, 1.0 if method == "lasso" else l1_ratio)[0]
        return ols(m, ridge=alpha if method == "ridge" else 0.0)[0]

    def coefs(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                whole = None
                for i, (train, test) in enumerate(_folds(r.segs, n_windows)):
                    if train is not None and test is not None and train.n > p:
                        out.append((r.unique_id, i + 1, solve(train).tolist()))
                    whole = train if test is None else test if train is None else train.merge(test)
                out.append((r.unique_id, 0, solve(whole).tolist()))
            yield pd.DataFrame(out, columns=["unique_id", "seg", "coef"])

    fits = per.mapInPandas(coefs, "unique_id string, seg int, coef array<double>")
    tests = segments(history, h, n_windows).where("seg > 0")
    scored = predict_linear(tests.join(fits, ["unique_id", "seg"]).drop("coef"), fits, ["unique_id", "seg"], xcols, "__p")
    error = F.abs(F.col(y) - F.col("__p"))
    probs = [q for level in levels for q in ((100 - level) / 200, (100 + level) / 200)]
    pools = (scored.select("unique_id", "step", F.explode(F.array(error, -error)).alias("__s"))
             .groupBy("unique_id", "step").agg(F.percentile("__s", probs).alias("__q")))
    ahead = predict_linear(future, fits.where("seg = 0").drop("seg"), ["unique_id"], xcols, name)
    ahead = ahead.join(pools, ["unique_id", "step"], "left")
    bounds = {f"{name}_{side}_{level}": F.col(name) + F.col("__q")[2 * i + j]
              for i, level in enumerate(levels) for j, side in enumerate(("lo", "hi"))}
    return ahead.withColumns(bounds).select("unique_id", "ds", "step", name, *bounds)


# ---------------------------------------------------------------- H10 Huber regression per series

#: Keys of at most so many rows are solved in one task each, all rounds in one pass; longer ones take a job a round.
HUBER_ROWS = 20_000


def fit_huber(df: DataFrame, keys, xcols, y: str, epsilon: float = 1.35, alpha: float = 1e-4, max_iter: int = 100,
              tol: float = 1e-5) -> DataFrame:
    """H10 per key: robust regression with its scale, ``min Σ(σ + H(r/σ)·σ) + α‖β‖²`` (H quadratic up to ``epsilon``, linear
    beyond; a constant first column unpenalised).

    Iteratively reweighted moments: rows beyond ε·σ weigh ε·σ/|r|, the slopes solve the weighted system with ridge α·σ, and
    σ² = Σ r² of the rows inside / (n − ε²·rows beyond).  A key is done when coefficients and scale move by less than ``tol``.  The
    rounds of a key of at most ``HUBER_ROWS`` rows run in one task, all such keys in one pass; for longer keys a round is one
    aggregate pass over those that still move.  The rows are written once.  Returns ``keys…, coef, scale, n, n_outliers, rounds,
    converged``."""
    from panelspark.session import cut_lineage

    keys = list(keys)
    ok = F.col(y).isNotNull()
    for c in xcols:
        ok = ok & F.col(c).isNotNull()
    rows = cut_lineage(df.where(ok).select(*keys, *xcols, y))
    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.select(*keys).dtypes)
    schema = f"{kinds}, coef array<double>, scale double, n bigint, n_outliers bigint, rounds int, converged boolean"
    names = [*keys, "coef", "scale", "n", "n_outliers", "rounds", "converged"]

    def begin(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = Moments.of(r)
                beta, ssr, _, _ = ols(m)
                scale = math.sqrt(ssr / m.n)
                exact = scale <= 1e-12 * (abs(m.mean[-1]) + math.sqrt(m.c[-1, -1] / m.n))  # nothing left but rounding
                out.append((*[getattr(r, k) for k in keys], beta.tolist(), scale, m.n, 0, 0, exact))
            yield pd.DataFrame(out, columns=names)

    def better(m, coef, scale):
        """Coefficients, scale, rows beyond and whether the key is done, from the moments that the round before weighted."""
        inside, beyond = float(m.extra[0]), int(m.extra[1])
        beta = ols(m, ridge=alpha * scale)[0]
        room = m.n - epsilon ** 2 * beyond
        new = math.sqrt(inside / room) if room > 0 and inside > 0 else float(scale)
        moved = np.abs(beta - np.asarray(coef, float)).max() / max(1.0, np.abs(beta).max())
        return beta, new, beyond, bool(moved <= tol and abs(new - scale) <= tol * new)

    def advance(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                m = Moments.of(r)
                beta, scale, beyond, done = better(m, r.coef, r.scale)
                out.append((*[getattr(r, k) for k in keys], beta.tolist(), scale, m.n, beyond, int(r.rounds) + 1, done))
            yield pd.DataFrame(out, columns=names)

    def finish(key, pdf):
        z = pdf[[*xcols, y]].to_numpy(float)
        beta, scale, beyond, done, rounds = np.asarray(pdf["coef"].iloc[0], float), float(pdf["scale"].iloc[0]), 0, False, 0
        while rounds < max_iter and not done:
            p = np.zeros(len(z))
            for i in range(len(xcols)):
                p = p + beta[i] * z[:, i]
            r = np.abs(z[:, -1] - p)
            out = (r > epsilon * scale) | (np.isnan(r) & (scale == scale))  # as Spark, where NaN is above all numbers
            with np.errstate(divide="ignore", invalid="ignore"):
                w = np.where(out, epsilon * scale / r, 1.0)
            m = Moments.over(z, w, np.column_stack([np.where(out, 0.0, r * r), out.astype(float)]))
            beta, scale, beyond, done = better(m, beta, scale)
            rounds += 1
        return pd.DataFrame([(*key, beta.tolist(), scale, len(z), beyond, rounds, done)], columns=names)

    state = cut_lineage(gram(rows, keys, xcols, y).mapInPandas(begin, schema))
    short, long = F.col("n") <= HUBER_ROWS, F.col("n") > HUBER_ROWS
    start = state.where(short & ~F.col("converged")).select(*keys, "coef", "scale")
    solved = rows.join(start, keys).groupBy(*keys).applyInPandas(finish, schema)
    state = cut_lineage(state.where(long | F.col("converged")).unionByName(solved))
    for _ in range(max_iter):
        moving = state.where(long & ~F.col("converged"))
        if not moving.limit(1).count():
            break
        now = moving.select(*keys, "coef", "scale", "rounds")
        d = predict_linear(rows.join(now.select(*keys, "scale"), keys), now, keys, xcols, "__p")
        r = F.abs(F.col(y) - F.col("__p"))
        beyond = r > epsilon * F.col("scale")
        d = d.withColumns({"__w8": F.when(beyond, epsilon * F.col("scale") / r).otherwise(1.0),
                           "__in": F.when(beyond, 0.0).otherwise(r * r), "__out": beyond.cast("double")})
        g = gram(d, keys, xcols, y, "__w8", ["__in", "__out"])
        state = cut_lineage(state.where(short | F.col("converged")).unionByName(g.join(now, keys).mapInPandas(advance, schema)))
    return state


# ---------------------------------------------------------------- H16 Theta

ALPHAS = tuple(round(0.05 * k, 2) for k in range(1, 21))


def _smooth_chunks(base: DataFrame, alphas, chunk_rows: int, time_bucket: str) -> DataFrame:
    """(unique_id, sse, alpha, level) of the best α by a distributed prefix scan.

    Over a chunk of rows the level is an affine map of the level before it, ``l ↦ a·l + b``, and the sum of squared one-step
    errors a quadratic of it, ``s0 − 2·s1·l + s2·l²``; both are folded from the chunk's rows alone, relative to its first value.
    A series then is the composition of its chunks' maps in order (one small struct for each chunk and α)."""
    d = positions(base.where(F.col("y").isNotNull()), time_bucket)
    d = d.withColumn("__chunk", F.floor(F.col("__pos") / chunk_rows).cast("long"))
    rows = d.groupBy("unique_id", "__chunk").agg(F.sort_array(F.collect_list(F.struct("__pos", "y"))).alias("__s"))  # chunk_rows
    rows = rows.select("unique_id", "__chunk", F.col("__s")[0]["y"].alias("__o"), F.transform("__s", lambda s: s["y"]).alias("__y"))

    def fold(alpha):
        zero = F.struct(F.lit(1.0).alias("a"), *[F.lit(0.0).alias(c) for c in ("b", "s0", "s1", "s2")])

        def step(acc, y):
            v, miss = y - F.col("__o"), y - F.col("__o") - acc["b"]
            return F.struct(((1 - alpha) * acc["a"]).alias("a"), (alpha * v + (1 - alpha) * acc["b"]).alias("b"),
                            (acc["s0"] + miss * miss).alias("s0"), (acc["s1"] + acc["a"] * miss).alias("s1"),
                            (acc["s2"] + acc["a"] * acc["a"]).alias("s2"))

        return F.aggregate("__y", zero, step)

    maps = rows.select("unique_id", "__chunk", "__o", F.transform(F.array(*map(F.lit, alphas)), fold).alias("__m"))
    per = maps.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("__chunk", "__o", "__m"))).alias("__c"))

    def whole(alpha, i):
        begin = F.struct(F.col("__c")[0]["__o"].alias("level"), F.lit(0.0).alias("sse"))  # the first row's own error is 0

        def step(acc, chunk):
            m, at = chunk["__m"][i], acc["level"] - chunk["__o"]
            return F.struct((m["a"] * at + m["b"] + chunk["__o"]).alias("level"),
                            (acc["sse"] + m["s0"] - 2 * at * m["s1"] + at * at * m["s2"]).alias("sse"))

        end = F.aggregate("__c", begin, step)
        return F.struct(end["sse"].alias("sse"), alpha.alias("alpha"), end["level"].alias("level"))

    grid = F.array(*map(F.lit, alphas))
    return per.select("unique_id", F.array_min(F.transform(grid, whole)).alias("__b"))


def theta_forecast(panel: DataFrame, h: int, freq: str, season_length: int | None = None, alphas=ALPHAS,
                   chunk_rows: int | None = None, time_bucket: str = "month") -> DataFrame:
    """Theta as simple exponential smoothing with drift = half the linear-trend slope; the smoothing α is the one of
    ``alphas`` with the least sum of squared one-step errors (ties: the smallest), the forecast ``l_n + b/2·k``.  With
    ``season_length`` the series is additively deseasonalised first (F14) and the phase's component added back.

    The recursion is an SQL ``aggregate`` over the series' values in order, for all α of the grid at once: one row per
    series, whose array is bounded by the panel's frequency and time span.  ``chunk_rows``: long series are cut into chunks whose
    maps are composed (``_smooth_chunks``), and positions come from counts by ``time_bucket``; no group holds a series."""
    from panelspark.operators.explore import decompose
    from panelspark.sources.panels import future_frame

    base = panel
    if season_length:
        dec = decompose(panel, season_length, chunk_rows=chunk_rows)
        dec = positions(dec, time_bucket) if chunk_rows else dec.withColumn("__pos", F.row_number().over(_W()) - 1)
        seas = dec.select("unique_id", (F.col("__pos") % season_length).alias("__ph"), "seasonal").dropDuplicates(["unique_id", "__ph"])
        base = dec.select("unique_id", "ds", (F.col("y") - F.coalesce(F.col("seasonal"), F.lit(0.0))).alias("y"))
    values = base.groupBy("unique_id").agg(F.sort_array(F.collect_list(F.struct("ds", "y"))).alias("__s"))
    values = values.select("unique_id", F.transform("__s", lambda s: s["y"]).alias("__y"))

    def smooth(alpha):
        start = F.struct(F.element_at("__y", 1).alias("level"), F.lit(0.0).alias("sse"))
        end = F.aggregate(F.slice("__y", 2, F.greatest(F.size("__y") - 1, F.lit(0))), start, lambda acc, y: F.struct(
            (alpha * y + (1 - alpha) * acc["level"]).alias("level"),
            (acc["sse"] + (y - acc["level"]) * (y - acc["level"])).alias("sse")))
        return F.struct(end["sse"].alias("sse"), alpha.alias("alpha"), end["level"].alias("level"))

    if chunk_rows:
        best = _smooth_chunks(base, alphas, chunk_rows, time_bucket)
        trend = positions(base, time_bucket).withColumns({"__one": F.lit(1.0), "__t": (F.col("__pos") + 1).cast("double")})
    else:
        best = values.select("unique_id", F.array_min(F.transform(F.array(*map(F.lit, alphas)), smooth)).alias("__b"))
        trend = base.withColumns({"__one": F.lit(1.0), "__t": F.row_number().over(_W()).cast("double")})
    b = fit_linear(trend, ["unique_id"], ["__one", "__t"], "y")
    st = best.select("unique_id", "__b.alpha", "__b.level").join(
        b.select("unique_id", F.col("coef")[1].alias("slope")), "unique_id")
    fut = future_frame(panel, h, freq).join(st, "unique_id")
    f = fut.withColumn("Theta", F.col("level") + F.col("slope") / 2 * F.col("step"))
    if season_length:
        n = panel.groupBy("unique_id").agg(F.count("*").alias("__n"))
        f = f.join(n, "unique_id").withColumn("__ph", (F.col("__n") + F.col("step") - 1) % season_length) \
             .join(seas, ["unique_id", "__ph"], "left").withColumn("Theta", F.col("Theta") + F.coalesce("seasonal", F.lit(0.0)))
    return f.select("unique_id", "ds", "step", "Theta", "alpha")
