"""K1–K3 as queries: the stored events as files that arrive in the order of time, streamed over several triggers into a Parquet sink
in the shared folder, read back.  The DuckDB twins are the batch answers over the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.util import round_doubles
from panelspark.operators.relational import exact_percentiles
from panelspark.plans.registry import register
from panelspark.session import stream_checkpoint
from panelspark.sources.tables import read_table
from panelspark.streaming import online

#: The hour of events without a time, which come before all others.
_NO_HOUR = "0001-01-01 00:00:00"
_OVER = "(PARTITION BY event_type ORDER BY ts, value)"
_PREV = (f"d AS (SELECT event_type AS unique_id, ts AS ds, value AS y, lag(value) OVER {_OVER} AS prev, "
         f"row_number() OVER {_OVER} AS rn FROM events)")


def _replayed(spark, sf_dir, build, name):
    return online.replay(read_table(spark, sf_dir, "events"), build, name)


def _stored(df, name):
    """Written once to the shared folder and read from there; a join with it goes by its measured size."""
    folder = stream_checkpoint(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _pairs(spark, sf_dir):
    """Batch side: each event with the value before it in its series (ordered per series; used for the static tables).  Windows order
    the events of an hour; its first event takes the last value of the hour before that has any."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    hours = ev.withColumn("h", F.coalesce(F.date_trunc("HOUR", F.col("ts")), F.lit(_NO_HOUR).cast("timestamp_ntz")))
    w = Window.partitionBy("event_type", "h").orderBy("ts", "value")
    rows = _stored(hours.select(F.col("event_type").alias("unique_id"), "h", F.col("value").alias("y"),
                                F.lag("value").over(w).alias("prev"), (F.row_number().over(w) == 1).alias("first"),
                                F.lead(F.lit(True)).over(w).isNull().alias("last")), "pairs")
    ends = rows.where("first OR last").groupBy("unique_id", "h").agg(
        F.max(F.when(F.col("first"), F.col("y"))).alias("y"), F.max(F.when(F.col("last"), F.col("y"))).alias("end"))
    heads = _stored(ends.select("unique_id", "y", F.lag("end").over(Window.partitionBy("unique_id").orderBy("h")).alias("prev")), "heads")
    return rows.where("NOT first").select("unique_id", "y", "prev").unionByName(heads)


@register("k1_online_lag_features",
          "SELECT event_type AS unique_id, ts AS ds, round(value, 4) AS y, round(lag(value) OVER " + _OVER + ", 4) AS level_prev, "
          + ", ".join(f"round(lag(value, {k}) OVER {_OVER} - lag(value, {k + 1}) OVER {_OVER}, 4) AS lag{k}" for k in (1, 2, 3))
          + " FROM events")
def k1_online_lag_features(spark, sf_dir):
    out = _replayed(spark, sf_dir, lambda stream, delay: online.online_lag_features(stream, (1, 2, 3), delay), "k1")
    return round_doubles(out, 4)


@register("k2_online_band_alerts", f"WITH {_PREV}, h AS (SELECT unique_id, quantile_cont(abs(y - prev), 0.9) AS q FROM d GROUP BY 1) "
          "SELECT d.unique_id, ds, round(y, 4) AS y, round(prev, 4) AS yhat, round(prev - q, 4) AS lower, round(prev + q, 4) AS upper "
          "FROM d JOIN h ON d.unique_id = h.unique_id WHERE y < prev - q OR y > prev + q")
def k2_online_band_alerts(spark, sf_dir):
    """Naive one-step forecasts on the stream, alerts beyond the 0.9 quantile of past one-step errors per series."""
    pairs = _pairs(spark, sf_dir).select("unique_id", F.abs(F.col("y") - F.col("prev")).alias("e"))
    half = _stored(exact_percentiles(pairs, ["unique_id"], "e", [0.9], ["q"]), "half")  # a row a series; each trigger joins it

    def alerts(stream, delay):
        naive = online.online_lag_features(stream, (1,), delay).withColumn("yhat", F.col("level_prev"))
        return online.band_alerts(naive, half)

    out = _replayed(spark, sf_dir, alerts, "k2")
    return round_doubles(out.select("unique_id", "ds", "y", "yhat", "lower", "upper"), 4)


def _k3_sql():
    buy = "(s.signal = 'BUY' AND {c} > s.y AND s.y > 0 AND isfinite({c} / s.y))"
    sell = "(s.signal = 'SELL' AND {k} > 0 AND isfinite({c} + s.y * {k}))"

    def step(c, k):
        b, x = buy.format(c=c), sell.format(c=c, k=k)
        return (f"CASE WHEN {b} THEN {c} - floor({c} / s.y) * s.y WHEN {x} THEN {c} + s.y * {k} ELSE {c} END, "
                f"CASE WHEN {b} THEN {k} + floor({c} / s.y) WHEN {x} THEN 0.0 ELSE {k} END")
    return (f"WITH RECURSIVE {_PREV}, f AS (SELECT unique_id, regr_slope(y, prev) AS phi, regr_intercept(y, prev) AS c FROM d GROUP BY 1), "
            "e AS (SELECT d.unique_id, quantile_cont(abs(y - (c + phi * prev)), 0.6) AS q FROM d JOIN f ON d.unique_id = f.unique_id GROUP BY 1), "
            "p AS (SELECT d.unique_id, ds, y, rn, c + phi * y AS nxt, q FROM d JOIN f ON d.unique_id = f.unique_id JOIN e ON d.unique_id = e.unique_id), "
            "s0 AS (SELECT *, CASE WHEN rn > 11 AND y < nxt - q AND nxt > y THEN 'BUY' WHEN rn > 11 AND y > nxt + q AND nxt < y THEN 'SELL' "
            "ELSE 'HOLD' END AS signal FROM p), "
            f"fold(unique_id, rn, ds, y, signal, cash, shares) AS (SELECT s.unique_id, s.rn, s.ds, s.y, s.signal, {step('10000.0', '0.0')} "
            f"FROM s0 s WHERE s.rn = 1 UNION ALL SELECT s.unique_id, s.rn, s.ds, s.y, s.signal, {step('r.cash', 'r.shares')} "
            "FROM fold r JOIN s0 s ON s.unique_id = r.unique_id AND s.rn = r.rn + 1) "
            "SELECT unique_id, ds, round(y, 4) AS y, signal, round(cash, 2) AS cash, round(shares, 2) AS shares, "
            "round(cash + shares * y, 2) AS value FROM fold")


@register("k3_online_portfolio", _k3_sql())
def k3_online_portfolio(spark, sf_dir):
    """The cash/shares fold on the stream; AR(1) coefficients and band per series are fitted in batch and joined."""
    pairs = _pairs(spark, sf_dir)
    fit = _stored(pairs.groupBy("unique_id").agg(F.regr_slope("y", "prev").alias("phi"), F.regr_intercept("y", "prev").alias("c")), "fit")
    errors = pairs.join(fit, "unique_id").select("unique_id", F.abs(
        F.col("y") - (F.col("c") + F.col("phi") * F.col("prev"))).alias("e"))
    coefs = _stored(fit.join(exact_percentiles(errors, ["unique_id"], "e", [0.6], ["q"]), "unique_id", "left"), "coefs")
    out = _replayed(spark, sf_dir, lambda stream, delay: online.online_portfolio(stream, coefs, delay=delay), "k3")
    return round_doubles(out.select("unique_id", "ds", "y", "signal", "cash", "shares", "value"), 2, {"y": 4})
