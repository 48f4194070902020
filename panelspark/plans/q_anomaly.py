"""Flagship and anomaly queries (M0: F4, F14, G1, G2, G5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.functions.util import rnd
from panelspark.operators import anomaly, explore, windows
from panelspark.plans.registry import register
from panelspark.plans.sqlkit import W, decompose_ctes, with_ctes
from panelspark.sources import panels


def _r(c, n=4):
    return rnd(c, n).alias(c)


# ---------------------------------------------------------------- flagship: daily event panel → three detectors

def flagship(spark, sf_dir):
    d = anomaly.detect_anomalies(panels.events_daily(spark, sf_dir))
    return d.select("unique_id", "ds", _r("y"), "ma_anomaly", "decomp_anomaly", "zscore_anomaly",
                    F.col("anomaly_count").cast("bigint").alias("anomaly_count"))


_FRAME20 = W("ROWS BETWEEN 19 PRECEDING AND CURRENT ROW")
FLAGSHIP_SQL = with_ctes(
    "events_daily",
    f"band AS (SELECT *, CASE WHEN count(y) OVER {_FRAME20} = 20 THEN avg(y) OVER {_FRAME20} END AS ma, "
    f"CASE WHEN count(y) OVER {_FRAME20} = 20 THEN stddev_samp(y) OVER {_FRAME20} END AS ma_std FROM events_daily)",
    *decompose_ctes("band", 7),
    "st AS (SELECT *, avg(resid) OVER (PARTITION BY unique_id) AS rmu, stddev_pop(resid) OVER (PARTITION BY unique_id) AS rsd, "
    "avg(y) OVER (PARTITION BY unique_id) AS ymu, stddev_pop(y) OVER (PARTITION BY unique_id) AS ysd FROM dec)",
    "fl AS (SELECT unique_id, ds, y, "
    "COALESCE(y < ma - 2 * ma_std OR y > ma + 2 * ma_std, false) AS ma_anomaly, "
    "COALESCE(resid < rmu - 2 * rsd OR resid > rmu + 2 * rsd, false) AS decomp_anomaly, "
    "COALESCE(abs((y - ymu) / NULLIF(ysd, 0)) > 3, false) AS zscore_anomaly FROM st)",
    "SELECT unique_id, ds, round(y, 4) AS y, ma_anomaly, decomp_anomaly, zscore_anomaly, "
    "CAST(CAST(ma_anomaly AS INT) + CAST(decomp_anomaly AS INT) + CAST(zscore_anomaly AS INT) AS BIGINT) AS anomaly_count "
    "FROM fl")

register("flagship_anomalies", FLAGSHIP_SQL)(flagship)


@register("flagship_anomalies_chunked", FLAGSHIP_SQL)
def flagship_chunked(spark, sf_dir):
    """The flagship in skew-safe mode (every series cut into 20-row chunks with halos, statistics by aggregates)."""
    d = anomaly.detect_anomalies(panels.events_daily(spark, sf_dir), chunk_rows=20)
    return d.select("unique_id", "ds", _r("y"), "ma_anomaly", "decomp_anomaly", "zscore_anomaly",
                    F.col("anomaly_count").cast("bigint").alias("anomaly_count"))





# ---------------------------------------------------------------- F4 / G1 band

@register("f4_rolling_band", with_ctes(
    "events_hourly",
    f"b AS (SELECT *, CASE WHEN count(y) OVER {_FRAME20} = 20 THEN avg(y) OVER {_FRAME20} END AS ma, "
    f"CASE WHEN count(y) OVER {_FRAME20} = 20 THEN stddev_samp(y) OVER {_FRAME20} END AS ma_std FROM events_hourly)",
    "SELECT unique_id, ds, round(ma, 4) AS ma, round(ma_std, 4) AS ma_std, round(ma - 2 * ma_std, 4) AS ma_lower, "
    "round(ma + 2 * ma_std, 4) AS ma_upper FROM b"))
def f4_rolling_band(spark, sf_dir):
    d = windows.rolling_band(panels.events_hourly(spark, sf_dir), 20, 2.0)
    return d.select("unique_id", "ds", _r("ma"), _r("ma_std"), _r("ma_lower"), _r("ma_upper"))


@register("g1_band_flag", with_ctes(
    "events_daily",
    f"b AS (SELECT *, CASE WHEN count(y) OVER {_FRAME20} = 20 THEN avg(y) OVER {_FRAME20} END AS ma, "
    f"CASE WHEN count(y) OVER {_FRAME20} = 20 THEN stddev_samp(y) OVER {_FRAME20} END AS ma_std FROM events_daily)",
    "SELECT unique_id, ds, COALESCE(y < ma - 2 * ma_std OR y > ma + 2 * ma_std, false) AS ma_anomaly FROM b"))
def g1_band_flag(spark, sf_dir):
    return anomaly.band_flag(panels.events_daily(spark, sf_dir)).select("unique_id", "ds", "ma_anomaly")


# ---------------------------------------------------------------- F14 decomposition

def _dec_query(panel_fn, period, model):
    def q(spark, sf_dir):
        d = explore.decompose(panel_fn(spark, sf_dir), period, model)
        n = 4 if model == "additive" else 6
        return d.select("unique_id", "ds", _r("trend", n if model == "additive" else 2),
                        _r("seasonal", n), _r("resid", n))
    return q


def _dec_sql(panel, period, model):
    n = 4 if model == "additive" else 6
    tn = n if model == "additive" else 2
    return with_ctes(panel, *decompose_ctes(panel, period, model),
                     f"SELECT unique_id, ds, round(trend, {tn}) AS trend, round(seasonal, {n}) AS seasonal, "
                     f"round(resid, {n}) AS resid FROM dec")


for _name, _pf, _pname, _m, _model in [
    ("f14_decompose_additive", panels.events_daily, "events_daily", 7, "additive"),
    ("f14_decompose_multiplicative", panels.events_daily, "events_daily", 7, "multiplicative"),
    ("f14_decompose_monthly_additive", panels.orders_monthly, "orders_monthly", 12, "additive"),
    ("f14_decompose_monthly_multiplicative", panels.orders_monthly, "orders_monthly", 12, "multiplicative"),
]:
    register(_name, _dec_sql(_pname, _m, _model))(_dec_query(_pf, _m, _model))


@register("g2_residual_flag", with_ctes(
    "events_daily", *decompose_ctes("events_daily", 7),
    "st AS (SELECT *, avg(resid) OVER (PARTITION BY unique_id) AS mu, stddev_pop(resid) OVER (PARTITION BY unique_id) AS sd FROM dec)",
    "SELECT unique_id, ds, COALESCE(resid < mu - 2 * sd OR resid > mu + 2 * sd, false) AS decomp_anomaly FROM st"))
def g2_residual_flag(spark, sf_dir):
    return anomaly.residual_flag(panels.events_daily(spark, sf_dir), 7).select("unique_id", "ds", "decomp_anomaly")


@register("g5_zscore_flag", with_ctes(
    "events_hourly",
    "st AS (SELECT *, (y - avg(y) OVER (PARTITION BY unique_id)) / NULLIF(stddev_pop(y) OVER (PARTITION BY unique_id), 0) AS z FROM events_hourly)",
    "SELECT unique_id, ds, round(z, 4) AS z_score, COALESCE(abs(z) > 3, false) AS zscore_anomaly FROM st"))
def g5_zscore_flag(spark, sf_dir):
    d = anomaly.zscore_flag(panels.events_hourly(spark, sf_dir))
    return d.select("unique_id", "ds", _r("z_score"), "zscore_anomaly")


# ---------------------------------------------------------------- G3 / G4 / G6 (rows-only; pinned by pytest)

@register("g3_isolation_forest")
def g3_isolation_forest(spark, sf_dir):
    d = anomaly.isolation_forest(panels.events_hourly(spark, sf_dir))
    return d.select("unique_id", "ds", _r("iso_score", 6), "iso_forest_anomaly")


def _novelty_sql() -> str:
    w, b = anomaly.fourier_features()
    phi = [f"sqrt(2.0 / {len(w)}) * cos({float(x)!r} * z + {float(y)!r})" for x, y in zip(w, b)]
    return with_ctes(
        "events_hourly", "z0 AS (SELECT unique_id, ds, COALESCE((y - avg(y) OVER (PARTITION BY unique_id)) / "
        "NULLIF(stddev_pop(y) OVER (PARTITION BY unique_id), 0), 0.0) AS z FROM events_hourly)",
        "p0 AS (SELECT unique_id, ds, " + ", ".join(f"{x} AS f{i}" for i, x in enumerate(phi)) + " FROM z0)",
        "m0 AS (SELECT unique_id, " + ", ".join(f"avg(f{i}) AS m{i}" for i in range(len(phi))) + " FROM p0 GROUP BY 1)",
        "s0 AS (SELECT p0.unique_id, ds, " + " + ".join(f"f{i} * m{i}" for i in range(len(phi)))
        + " AS s FROM p0 JOIN m0 ON p0.unique_id = m0.unique_id)",
        "c0 AS (SELECT unique_id, quantile_cont(s, 0.1) AS cut FROM s0 GROUP BY 1)",
        "SELECT s0.unique_id, ds, round(s, 6) AS svm_score, s < cut AS svm_anomaly FROM s0 JOIN c0 ON s0.unique_id = c0.unique_id")


@register("g4_kernel_novelty", _novelty_sql())
def g4_kernel_novelty(spark, sf_dir):
    d = anomaly.kernel_novelty(panels.events_hourly(spark, sf_dir))
    return d.select("unique_id", "ds", _r("svm_score", 6), "svm_anomaly")


@register("g6_anomaly_vote")
def g6_anomaly_vote(spark, sf_dir):
    return anomaly.detect_anomalies_all(panels.events_daily(spark, sf_dir), keep_only=False) \
                  .withColumn("anomaly_count", F.col("anomaly_count").cast("bigint"))


@register("f4_rolling_band_chunked", with_ctes(
    "events_hourly",
    f"b AS (SELECT *, CASE WHEN count(y) OVER {_FRAME20} = 20 THEN avg(y) OVER {_FRAME20} END AS ma, "
    f"CASE WHEN count(y) OVER {_FRAME20} = 20 THEN stddev_samp(y) OVER {_FRAME20} END AS ma_std FROM events_hourly)",
    "SELECT unique_id, ds, round(ma, 4) AS ma, round(ma_std, 4) AS ma_std, round(ma - 2 * ma_std, 4) AS ma_lower, "
    "round(ma + 2 * ma_std, 4) AS ma_upper FROM b"))
def f4_rolling_band_chunked(spark, sf_dir):
    d = windows.rolling_band(panels.events_hourly(spark, sf_dir), 20, 2.0, chunk_rows=64)
    return d.select("unique_id", "ds", _r("ma"), _r("ma_std"), _r("ma_lower"), _r("ma_upper"))


# ---------------------------------------------------------------- F15 multi-season decomposition

def _mstl_sql(panel="events_hourly", periods=(24, 168), iterations=2):
    names = [f"seasonal{m}" for m in periods]
    ctes = [f"m0 AS (SELECT unique_id, ds, y AS y0, {', '.join('0.0 AS ' + n for n in names)} FROM {panel})"]
    prev, k = "m0", 0
    for _ in range(iterations):
        for m, nm in zip(periods, names):
            k += 1
            others = " + ".join([o for o in names if o != nm]) or "0.0"
            ctes.append(f"x{k} AS (SELECT unique_id, ds, y0, {', '.join(names)}, y0 - ({others}) AS y FROM {prev})")
            ctes += decompose_ctes(f"x{k}", m, out=f"d{k}")
            keep = ", ".join(("seasonal AS " + n) if n == nm else n for n in names)
            ctes.append(f"m{k} AS (SELECT unique_id, ds, y0, {keep} FROM d{k})")
            prev = f"m{k}"
    total = " + ".join(names)
    big, h = periods[-1], periods[-1] // 2
    fr = W(f"ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING")
    trend = (f"CASE WHEN count(y) OVER {fr} = {big + 1} THEN (sum(y) OVER {fr} - 0.5 * (lag(y, {h}) OVER {W()} + lead(y, {h}) OVER {W()})) / {big} END"
             if big % 2 == 0 else f"CASE WHEN count(y) OVER {fr} = {big} THEN avg(y) OVER {fr} END")
    ctes.append(f"fin AS (SELECT *, {trend} AS trend FROM (SELECT *, y0 - ({total}) AS y FROM {prev}))")
    body = ("SELECT unique_id, ds, round(trend, 4) AS trend, " + ", ".join(f"round({n}, 4) AS {n}" for n in names)
            + f", round(y0 - trend - ({total}), 4) AS remainder FROM fin")
    return with_ctes(panel, *ctes, body)


@register("f15_multi_seasonal_decompose", _mstl_sql())
def f15_multi_seasonal_decompose(spark, sf_dir):
    d = explore.multi_seasonal_decompose(panels.events_hourly(spark, sf_dir), (24, 168), 2)
    return d.select("unique_id", "ds", _r("trend"), _r("seasonal24"), _r("seasonal168"), _r("remainder"))


@register("f14_decompose_monthly_chunked", _dec_sql("orders_monthly", 12, "additive"))
def f14_decompose_monthly_chunked(spark, sf_dir):
    d = explore.decompose(panels.orders_monthly(spark, sf_dir), 12, "additive", chunk_rows=16, time_bucket="year")
    return d.select("unique_id", "ds", _r("trend", 4), _r("seasonal", 4), _r("resid", 4))
