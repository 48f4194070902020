"""Panel building, scalar and series queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.util import rnd, round_doubles
from panelspark.operators import explore
from panelspark.operators import relational as rel
from panelspark.operators import windows as wn
from panelspark.plans.registry import register
from panelspark.plans.sqlkit import W, with_ctes
from panelspark.sources import panels
from panelspark.sources.tables import read_table

UW = "(PARTITION BY unique_id)"


# ---------------------------------------------------------------- A: sources and panel building

@register("a2_load_bars", "SELECT event_type AS unique_id, ts AS ds, value AS y FROM events WHERE ts >= TIMESTAMP '2024-01-10' "
          "AND ts < TIMESTAMP '2024-01-20' AND event_type IN ('click', 'view')")
def a2_load_bars(spark, sf_dir):
    return panels.load_bars(spark, sf_dir, ["click", "view"], "2024-01-10", "2024-01-20")


@register("a3_build_panel_15min", "SELECT event_type AS unique_id, time_bucket(INTERVAL 15 MINUTE, ts) AS ds, round(sum(value), 4) AS y "
          "FROM events GROUP BY 1, 2")
def a3_build_panel_15min(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return round_doubles(panels.build_panel(ev, "event_type", "ts", "value", "15min"), 4)


@register("a3_build_panel_composite_id", "SELECT concat_ws('|', event_type, CAST(user_id AS VARCHAR)) AS unique_id, "
          "CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ds, CAST(count(value) AS DOUBLE) AS y FROM events GROUP BY 1, 2")
def a3_build_panel_composite_id(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_type", "user_id", "ts", "value"])
    return panels.build_panel(ev, ["event_type", "user_id"], "ts", "value", "D", agg="count")


@register("a5_calendar_spine", "SELECT CAST(last_day(m) AS TIMESTAMP) AS ds FROM (SELECT UNNEST(generate_series("
          "date_trunc('month', min(o_orderdate)), date_trunc('month', max(o_orderdate)) + INTERVAL 24 MONTH, INTERVAL 1 MONTH)) AS m "
          "FROM orders)")
def a5_calendar_spine(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders", ["o_orderdate"])
    return panels.calendar_spine(o, "o_orderdate", 24)


@register("a6_future_frame", with_ctes("orders_monthly",
          "SELECT unique_id, CAST(last_day(date_trunc('month', mx) + to_months(k)) AS TIMESTAMP) AS ds, CAST(k AS INTEGER) AS step "
          "FROM (SELECT unique_id, max(ds) AS mx FROM orders_monthly GROUP BY 1), range(1, 13) t(k)"))
def a6_future_frame(spark, sf_dir):
    return panels.future_frame(panels.orders_monthly(spark, sf_dir), 12, "ME")


# ---------------------------------------------------------------- B: scalar / projection

@register("b1_epoch_roundtrip", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS epoch_s, "
          "make_timestamp(CAST(floor(epoch(ts)) AS BIGINT) * 1000000) AS ds FROM events")
def b1_epoch_roundtrip(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    e = panels.epoch_seconds("ts")
    return ev.select("event_id", e.alias("epoch_s"), panels.from_epoch_seconds(e).alias("ds"))


@register("b2_local_midnight", "SELECT event_id, date_trunc('day', timezone('America/New_York', timezone('UTC', ts))) AS local_midnight, "
          "date_trunc('day', timezone('America/New_York', timezone('UTC', ts))) - INTERVAL 3 DAY AS lookback_start FROM events")
def b2_local_midnight(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts"])
    local = F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))  # wall clock → wall clock
    mid = F.to_date(local).cast("timestamp_ntz")
    return ev.select("event_id", mid.alias("local_midnight"), (mid - F.expr("INTERVAL 3 DAYS")).alias("lookback_start"))


@register("b3_date_features", with_ctes("events_hourly", "SELECT unique_id, ds, strftime(ds, '%Y-%m-%d') AS date, CAST(hour(ds) AS INTEGER) AS hour, "
                                        "CAST(minute(ds) AS INTEGER) AS minute, CAST(dayofweek(ds) + 1 AS INTEGER) AS dayofweek FROM events_hourly"))
def b3_date_features(spark, sf_dir):
    p = panels.events_hourly(spark, sf_dir)
    f = wn.date_features("ds", ("date", "hour", "minute", "dayofweek"))
    f["date"] = F.date_format(f["date"], "yyyy-MM-dd")  # dates as ISO text: identical across engines and clients
    return p.select("unique_id", "ds", *[v.alias(k) for k, v in f.items()])


@register("b6_time_split_counts", with_ctes("events_hourly", "SELECT unique_id, CASE WHEN ds < (SELECT date_trunc('day', max(ds)) - INTERVAL 5 DAY "
                                            "FROM events_hourly) THEN 'train' ELSE 'test' END AS split, count(*) AS n "
                                            "FROM events_hourly GROUP BY 1, 2"))
def b6_time_split_counts(spark, sf_dir, test_days: int = 6):
    """Time split at the start of the last ``test_days`` calendar days of the data."""
    p = panels.events_hourly(spark, sf_dir)
    cut = p.agg(F.date_sub(F.to_date(F.max("ds")), test_days - 1).cast("timestamp_ntz")).scalar()
    s = F.when(F.col("ds") < cut, "train").otherwise("test")
    return p.groupBy("unique_id", s.alias("split")).agg(F.count("*").alias("n"))


@register("b7_last_two_days", "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2), "
          "r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS day_rank FROM d) "
          "SELECT e.event_id, e.event_type AS unique_id, strftime(r.day, '%Y-%m-%d') AS day, CAST(r.day_rank AS INTEGER) AS day_rank FROM events e "
          "JOIN r ON e.event_type = r.event_type AND CAST(e.ts AS DATE) = r.day WHERE r.day_rank <= 2")
def b7_last_two_days(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events", ["event_id", "event_type", "ts"]).withColumn("day", F.to_date("ts"))
    # rank the (small) set of distinct days per series, not the raw rows
    days = ev.select("event_type", "day").distinct()
    days = days.withColumn("day_rank", F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("day")))) \
               .filter(F.col("day_rank") <= 2)
    return ev.join(days, ["event_type", "day"]).select("event_id", F.col("event_type").alias("unique_id"),
                                                       F.date_format("day", "yyyy-MM-dd").alias("day"), "day_rank")


@register("b8_positional_split", with_ctes("orders_monthly", f"SELECT unique_id, ds, row_number() OVER {W()} <= floor(count(*) OVER {UW} * 0.9) AS is_train FROM orders_monthly"))
def b8_positional_split(spark, sf_dir):
    return wn.train_test_flag(panels.orders_monthly(spark, sf_dir), 0.9).select("unique_id", "ds", "is_train")


@register("b10_label_code_map", with_ctes("events_daily", f"c AS (SELECT unique_id, ds, CASE WHEN y >= avg(y) OVER {UW} THEN 1 ELSE -1 END AS code FROM events_daily)",
                                          "SELECT unique_id, ds, code, code = -1 AS flagged FROM c"))
def b10_label_code_map(spark, sf_dir):
    p = panels.events_daily(spark, sf_dir)
    code = F.when(F.col("y") >= F.avg("y").over(Window.partitionBy("unique_id")), 1).otherwise(-1)
    m = F.create_map(F.lit(1), F.lit(False), F.lit(-1), F.lit(True))
    return p.select("unique_id", "ds", code.alias("code")).withColumn("flagged", m[F.col("code")])


@register("b5_composed_predicates", "SELECT l_returnflag, CAST(sum(CAST((l_discount > 0.05 OR l_tax < 0.02) AND abs(l_quantity - 25) < 10 AS INTEGER)) AS BIGINT) AS hits, "
          "count(*) AS n FROM lineitem GROUP BY 1")
def b5_composed_predicates(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_discount", "l_tax", "l_quantity"])
    cond = ((F.col("l_discount") > 0.05) | (F.col("l_tax") < 0.02)) & (F.abs(F.col("l_quantity") - 25) < 10)
    return li.groupBy("l_returnflag").agg(F.sum(cond.cast("int")).cast("bigint").alias("hits"), F.count("*").alias("n"))


# ---------------------------------------------------------------- D / E on panels

@register("d1_group_sizes", with_ctes("events_hourly", "s AS (SELECT unique_id, count(*) AS n FROM events_hourly GROUP BY 1)",
                                      "SELECT unique_id, n, (SELECT min(n) FROM s) AS min_n FROM s"))
def d1_group_sizes(spark, sf_dir):
    return rel.group_sizes(panels.events_hourly(spark, sf_dir))


@register("d14_exact_quantile", with_ctes("events_hourly", f"e AS (SELECT unique_id, abs(y - lag(y, 24) OVER {W()}) AS err FROM events_hourly)",
                                          "SELECT unique_id, round(quantile_cont(err, 0.9), 4) AS q90 FROM e GROUP BY 1"))
def d14_exact_quantile(spark, sf_dir):
    p = panels.events_hourly(spark, sf_dir)
    e = p.select("unique_id", F.abs(F.col("y") - F.lag("y", 24).over(wn.series_window())).alias("err"))
    q = rel.exact_percentiles(e, ["unique_id"], "err", [0.9], ["q90"])
    return q.select("unique_id", rnd("q90", 4).alias("q90"))


@register("d16_histogram", with_ctes(
    "events_hourly", "st AS (SELECT unique_id, min(y) AS lo, max(y) AS hi, count(y) AS n FROM events_hourly GROUP BY 1)",
    "b AS (SELECT p.unique_id, lo, hi, n, CAST(COALESCE(least(floor((y - lo) / NULLIF((hi - lo) / 10, 0)), 9), 0) AS INTEGER) AS bin "
    "FROM events_hourly p JOIN st ON p.unique_id = st.unique_id)",
    "SELECT unique_id, bin, round(lo + bin * ((hi - lo) / 10), 4) AS \"left\", round(lo + (bin + 1) * ((hi - lo) / 10), 4) AS \"right\", "
    "count(*) AS count, round(count(*) / (n * ((hi - lo) / 10)), 8) AS density FROM b GROUP BY unique_id, bin, lo, hi, n"))
def d16_histogram(spark, sf_dir):
    h = rel.histogram(panels.events_hourly(spark, sf_dir), "y", 10, "unique_id")
    return round_doubles(h, 4, {"density": 8})


@register("e5_head_tail", with_ctes("events_hourly", f"r AS (SELECT *, row_number() OVER {W()} AS h, row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) AS t FROM events_hourly)",
                                    "SELECT unique_id, ds, round(y, 4) AS y, 'head' AS part FROM r WHERE h <= 5 UNION ALL "
                                    "SELECT unique_id, ds, round(y, 4) AS y, 'tail' AS part FROM r WHERE t <= 5"))
def e5_head_tail(spark, sf_dir):
    return round_doubles(wn.head_tail(panels.events_hourly(spark, sf_dir), 5), 4)


@register("e7_distinct_keys", "SELECT DISTINCT event_type, user_id FROM events")
def e7_distinct_keys(spark, sf_dir):
    return read_table(spark, sf_dir, "events", ["event_type", "user_id"]).distinct()


@register("e8_rows_per_series", with_ctes("events_daily", "events_hourly", "SELECT 'daily' AS panel, unique_id, count(*) AS n FROM events_daily GROUP BY 2 "
                                          "UNION ALL SELECT 'hourly', unique_id, count(*) FROM events_hourly GROUP BY 2"))
def e8_rows_per_series(spark, sf_dir):
    a = panels.events_daily(spark, sf_dir).groupBy("unique_id").agg(F.count("*").alias("n")).select(F.lit("daily").alias("panel"), "unique_id", "n")
    b = panels.events_hourly(spark, sf_dir).groupBy("unique_id").agg(F.count("*").alias("n")).select(F.lit("hourly").alias("panel"), "unique_id", "n")
    return a.unionByName(b)


# ---------------------------------------------------------------- F: window operators

_LAGS = (1, 2, 3, 24)


@register("f1_lags", with_ctes("events_hourly", "SELECT unique_id, ds, " + ", ".join(f"round(lag(y, {k}) OVER {W()}, 4) AS lag{k}" for k in _LAGS) + " FROM events_hourly"))
def f1_lags(spark, sf_dir):
    d = wn.add_lags(panels.events_hourly(spark, sf_dir), _LAGS)
    return round_doubles(d.select("unique_id", "ds", *[f"lag{k}" for k in _LAGS]), 4)


_F2_SQL = with_ctes("events_hourly", f"l AS (SELECT unique_id, ds, lag(y, 1) OVER {W()} AS lag1 FROM events_hourly)",
                    f"SELECT unique_id, ds, round(avg(lag1) OVER {W('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')}, 4) "
                    "AS expanding_mean_lag1 FROM l")


@register("f2_expanding_mean", _F2_SQL)
def f2_expanding_mean(spark, sf_dir):
    d = wn.add_lags(panels.events_hourly(spark, sf_dir), [1])
    return d.select("unique_id", "ds", rnd(wn.expanding_mean("lag1"), 4).alias("expanding_mean_lag1"))


@register("f2_expanding_mean_chunked", _F2_SQL)
def f2_expanding_mean_chunked(spark, sf_dir):
    """The same by prefix sums over chunks of 200 rows."""
    d = wn.add_lags(panels.events_hourly(spark, sf_dir), [1], chunk_rows=200)
    d = wn.add_expanding_mean(d, "lag1", "m", chunk_rows=200)
    return d.select("unique_id", "ds", rnd("m", 4).alias("expanding_mean_lag1"))


_F24 = W("ROWS BETWEEN 47 PRECEDING AND CURRENT ROW")


@register("f3_rolling_mean_of_lag", with_ctes("events_hourly", f"l AS (SELECT unique_id, ds, lag(y, 24) OVER {W()} AS lag24 FROM events_hourly)",
                                              f"SELECT unique_id, ds, round(CASE WHEN count(lag24) OVER {_F24} >= 48 THEN avg(lag24) OVER {_F24} END, 4) AS rolling_mean_lag24_window_size48 FROM l"))
def f3_rolling_mean_of_lag(spark, sf_dir):
    d = wn.add_lags(panels.events_hourly(spark, sf_dir), [24])
    return d.select("unique_id", "ds", rnd(wn.rolling_mean("lag24", 48), 4).alias("rolling_mean_lag24_window_size48"))


@register("f5_centered_moving_average", with_ctes("events_daily", "SELECT unique_id, ds, "
                                                  f"round(avg(y) OVER {W('ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING')}, 4) AS moving_avg_w7, "
                                                  f"round(avg(y) OVER {W('ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING')}, 4) AS moving_avg_w4 FROM events_daily"))
def f5_centered_moving_average(spark, sf_dir):
    d = wn.moving_average(wn.moving_average(panels.events_daily(spark, sf_dir), 7), 4)
    return round_doubles(d.select("unique_id", "ds", "moving_avg_w7", "moving_avg_w4"), 4)


@register("f6_auto_filter_sizes", with_ctes("events_hourly", "m AS (SELECT min(n) AS min_length FROM (SELECT count(*) AS n FROM events_hourly GROUP BY unique_id))",
                                            "s AS (SELECT min_length, greatest(3, least(min_length // 10, 11)) AS sg, greatest(2, least(min_length // 10, 14)) AS ma FROM m)",
                                            "SELECT CAST(min_length AS BIGINT) AS min_length, CAST(CASE WHEN sg % 2 = 0 THEN sg + 1 ELSE sg END AS INTEGER) AS savgol_window, "
                                            "CAST(ma AS INTEGER) AS ma_window FROM s"))
def f6_auto_filter_sizes(spark, sf_dir):
    return wn.auto_filter_sizes(panels.events_hourly(spark, sf_dir))


def _savgol_sql(window=11, poly=3):
    P = wn.savgol_weights(window, poly)
    h = window // 2

    def sh(d):
        return "y" if d == 0 else (f"lead(y, {d}) OVER {W()}" if d > 0 else f"lag(y, {-d}) OVER {W()}")

    def combo(row):
        return " + ".join(f"CAST({float(P[row, i])!r} AS DOUBLE) * {sh(i - row)}" for i in range(window))

    cases = [f"WHEN pos = {j} THEN {combo(j)}" for j in range(h)]
    cases += [f"WHEN pos = n - {window} + {j} THEN {combo(j)}" for j in range(h + 1, window)]
    return with_ctes("events_hourly", f"p AS (SELECT *, row_number() OVER {W()} - 1 AS pos, count(*) OVER {UW} AS n FROM events_hourly)",
                     f"SELECT unique_id, ds, round(CASE WHEN n < {window} THEN NULL {' '.join(cases)} ELSE {combo(h)} END, 4) AS savgol FROM p")


@register("f7_savgol", _savgol_sql(11, 3))
def f7_savgol(spark, sf_dir):
    d = wn.savgol(panels.events_hourly(spark, sf_dir), 11, 3)
    return d.select("unique_id", "ds", rnd("savgol", 4).alias("savgol"))


@register("f8_difference", with_ctes("events_daily", f"d1 AS (SELECT unique_id, ds, y - lag(y) OVER {W()} AS y FROM events_daily)",
                                     "SELECT unique_id, ds, round(y, 4) AS y FROM d1 WHERE y IS NOT NULL"))
def f8_difference(spark, sf_dir):
    return round_doubles(wn.difference(panels.events_daily(spark, sf_dir), 1).select("unique_id", "ds", "y"), 4)


@register("f8_difference_order2", with_ctes("events_daily", f"d1 AS (SELECT unique_id, ds, y - lag(y) OVER {W()} AS y FROM events_daily)",
                                            f"d2 AS (SELECT unique_id, ds, y - lag(y) OVER {W()} AS y FROM d1)",
                                            "SELECT unique_id, ds, round(y, 4) AS y FROM d2 WHERE y IS NOT NULL"))
def f8_difference_order2(spark, sf_dir):
    return round_doubles(wn.difference(panels.events_daily(spark, sf_dir), 2).select("unique_id", "ds", "y"), 4)


@register("f9_seasonal_difference", with_ctes("events_hourly", f"d AS (SELECT unique_id, ds, y - lag(y, 24) OVER {W()} AS y FROM events_hourly)",
                                              "SELECT unique_id, ds, round(y, 4) AS y FROM d WHERE y IS NOT NULL"))
def f9_seasonal_difference(spark, sf_dir):
    return round_doubles(wn.difference(panels.events_hourly(spark, sf_dir), 1, lag=24).select("unique_id", "ds", "y"), 4)


@register("f12_mean_pct_change", with_ctes("events_daily", f"c AS (SELECT unique_id, ds, y, (y - lag(y) OVER {W()}) / NULLIF(lag(y) OVER {W()}, 0) AS pc, "
                                           f"first_value(y) OVER {W()} AS first_y, count(*) OVER {UW} AS n FROM events_daily)",
                                           "SELECT unique_id, round(avg(pc), 6) AS mean_pct_change, round(CASE WHEN max(n) > 1 AND max(first_y) > 0 THEN COALESCE(avg(pc), 0) ELSE 0 END, 6) AS guarded "
                                           "FROM c GROUP BY 1"))
def f12_mean_pct_change(spark, sf_dir):
    p = panels.events_daily(spark, sf_dir)
    a = wn.mean_pct_change(p, "y")
    g = wn.mean_pct_change(p, "y", guarded=True).withColumnRenamed("mean_pct_change", "guarded")
    return round_doubles(a.join(g, "unique_id"))


@register("f13_mean_diff", with_ctes("events_daily", f"SELECT unique_id, round(avg(d), 6) AS mean_diff FROM (SELECT unique_id, y - lag(y) OVER {W()} AS d FROM events_daily) GROUP BY 1"))
def f13_mean_diff(spark, sf_dir):
    return round_doubles(wn.mean_diff(panels.events_daily(spark, sf_dir), "y"))


def _acf_sql(panel: str, K: int | None = None, max_lag: int = 100, out: str = "acf_l") -> list[str]:
    kmax = f"{K}" if K is not None else f"least(n // 2, {max_lag})"
    return [f"{out}__z AS (SELECT unique_id, row_number() OVER {W()} AS pos, y - avg(y) OVER {UW} AS z, count(*) OVER {UW} AS n FROM {panel})",
            f"{out}__d AS (SELECT unique_id, sum(z * z) AS den FROM {out}__z GROUP BY 1)",
            f"{out} AS (SELECT a.unique_id, CAST(a.pos - b.pos AS INTEGER) AS lag, sum(a.z * b.z) / d.den AS acf FROM {out}__z a "
            f"JOIN {out}__z b ON a.unique_id = b.unique_id AND b.pos <= a.pos AND a.pos - b.pos <= {kmax.replace('n', 'a.n')} "
            f"JOIN {out}__d d ON d.unique_id = a.unique_id GROUP BY a.unique_id, a.pos - b.pos, d.den)"]


@register("f16_acf_hourly", with_ctes("events_hourly", *_acf_sql("events_hourly"), "SELECT unique_id, lag, round(acf, 4) AS acf FROM acf_l"))
def f16_acf_hourly(spark, sf_dir):
    return round_doubles(explore.acf(panels.events_hourly(spark, sf_dir)), 4)


@register("f16_acf_daily", with_ctes("events_daily", *_acf_sql("events_daily"), "SELECT unique_id, lag, round(acf, 4) AS acf FROM acf_l"))
def f16_acf_daily(spark, sf_dir):
    return round_doubles(explore.acf(panels.events_daily(spark, sf_dir)), 4)


_PEAKS = ("pk AS (SELECT *, lag(acf) OVER (PARTITION BY unique_id ORDER BY lag) AS pv, lead(acf) OVER (PARTITION BY unique_id ORDER BY lag) AS nx FROM acf_l WHERE lag >= 1)",
          "pr AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY acf DESC, lag DESC) AS rank FROM pk WHERE acf > pv AND acf > nx AND acf >= 0.1)",
          "SELECT unique_id, CAST(rank AS INTEGER) AS rank, lag, round(acf, 4) AS acf FROM pr WHERE rank <= 3")


@register("f18_acf_peaks", with_ctes("events_hourly", *_acf_sql("events_hourly"), *_PEAKS))
def f18_acf_peaks(spark, sf_dir):
    return round_doubles(explore.acf_peaks(explore.acf(panels.events_hourly(spark, sf_dir))), 4).withColumn("rank", F.col("rank").cast("int"))


def _named_sql(panel, freq):
    vals = ", ".join(f"('{n}', {lag})" for n, lag in explore.SEASONALITIES[freq])
    return with_ctes(panel, *_acf_sql(panel), f"dim AS (SELECT * FROM (VALUES {vals}) v(name, lag))",
                     "SELECT a.unique_id, dim.name, a.lag, round(a.acf, 4) AS acf FROM acf_l a JOIN dim ON a.lag = dim.lag WHERE abs(a.acf) > 0.1")


@register("f19_named_seasonality_daily", _named_sql("events_daily", "D"))
def f19_named_seasonality_daily(spark, sf_dir):
    return round_doubles(explore.named_seasonalities(explore.acf(panels.events_daily(spark, sf_dir)), "D"), 4)


@register("f19_named_seasonality_monthly", _named_sql("orders_monthly", "M"))
def f19_named_seasonality_monthly(spark, sf_dir):
    return round_doubles(explore.named_seasonalities(explore.acf(panels.orders_monthly(spark, sf_dir)), "M"), 4)


_IRREG = "irregular AS (SELECT 'raw:' || event_type AS unique_id, ts AS ds, value AS y FROM events)"


@register("f20_infer_frequency", with_ctes(
    "events_daily", "events_hourly", "orders_monthly", _IRREG,
    "u AS (SELECT 'daily:' || unique_id AS unique_id, ds FROM events_daily UNION ALL SELECT 'hourly:' || unique_id, ds FROM events_hourly "
    "UNION ALL SELECT 'monthly:' || unique_id, ds FROM orders_monthly UNION ALL SELECT unique_id, ds FROM irregular)",
    f"g AS (SELECT unique_id, epoch(ds) - epoch(lag(ds) OVER {W()}) AS gap, (year(ds) * 12 + month(ds)) - lag(year(ds) * 12 + month(ds)) OVER {W()} AS mg, "
    "CAST(CAST(ds AS DATE) = last_day(ds) AS INTEGER) AS me, CAST(day(ds) = 1 AND CAST(CAST(ds AS DATE) AS TIMESTAMP) = ds AS INTEGER) AS ms FROM u)",
    "a AS (SELECT unique_id, min(gap) AS g0, max(gap) AS g1, min(mg) AS m0, max(mg) AS m1, min(me) AS me, min(ms) AS ms, "
    "floor(quantile_cont(gap, 0.5) / 86400) AS days FROM g GROUP BY 1)",
    "SELECT unique_id, CASE WHEN g0 IS NULL THEN 'Unknown' WHEN g0 = g1 AND g0 = 86400 THEN 'D' "
    "WHEN m0 = m1 AND (me = 1 OR ms = 1) AND m0 = 1 THEN 'M' WHEN m0 = m1 AND (me = 1 OR ms = 1) AND m0 = 3 THEN 'Q' "
    "WHEN m0 = m1 AND (me = 1 OR ms = 1) AND m0 = 12 THEN 'Y' WHEN g0 = g1 THEN 'Unknown' "
    "WHEN days = 1 THEN 'D' WHEN days BETWEEN 28 AND 31 THEN 'M' WHEN days BETWEEN 90 AND 92 THEN 'Q' WHEN days BETWEEN 365 AND 366 THEN 'Y' "
    "ELSE 'Unknown' END AS freq FROM a"))
def f20_infer_frequency(spark, sf_dir):
    def tag(df, t):
        return df.select(F.concat(F.lit(t + ":"), "unique_id").alias("unique_id"), "ds", "y")
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    irr = ev.select(F.concat(F.lit("raw:"), "event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    u = tag(panels.events_daily(spark, sf_dir), "daily").unionByName(tag(panels.events_hourly(spark, sf_dir), "hourly")) \
        .unionByName(tag(panels.orders_monthly(spark, sf_dir), "monthly")).unionByName(irr)
    return explore.infer_frequency(u)


_K = 12


@register("f23_trend_fourier", with_ctes(
    "orders_monthly",
    "fut AS (SELECT unique_id, CAST(last_day(date_trunc('month', mx) + to_months(k)) AS TIMESTAMP) AS ds FROM "
    "(SELECT unique_id, max(ds) AS mx FROM orders_monthly GROUP BY 1), range(1, 13) t(k))",
    "u AS (SELECT unique_id, ds, false AS is_future FROM orders_monthly UNION ALL SELECT unique_id, ds, true FROM fut)",
    f"t AS (SELECT *, row_number() OVER {W()} AS trend FROM u)",
    "SELECT unique_id, ds, is_future, trend, " + ", ".join(
        f"round(sin(2 * pi() * {j} * trend / 12), 6) AS sin{j}_12, round(cos(2 * pi() * {j} * trend / 12), 6) AS cos{j}_12" for j in range(1, _K + 1))
    + " FROM t"))
def f23_trend_fourier(spark, sf_dir):
    p = panels.orders_monthly(spark, sf_dir)
    d = explore.trend_fourier(p, panels.future_frame(p, 12, "ME"), 12, _K)
    return round_doubles(d.withColumn("trend", F.col("trend").cast("bigint")))


@register("f24_supervised_table", with_ctes(
    "events_hourly", f"d AS (SELECT unique_id, ds, y - lag(y) OVER {W()} AS y FROM events_hourly)",
    f"l AS (SELECT *, lag(y, 1) OVER {W()} AS lag1, lag(y, 2) OVER {W()} AS lag2, lag(y, 24) OVER {W()} AS lag24 FROM d)",
    f"t AS (SELECT *, avg(lag1) OVER {W('ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS expanding_mean_lag1, "
    f"CASE WHEN count(lag1) OVER {W('ROWS BETWEEN 23 PRECEDING AND CURRENT ROW')} >= 24 THEN avg(lag1) OVER {W('ROWS BETWEEN 23 PRECEDING AND CURRENT ROW')} END "
    "AS rolling_mean_lag1_window_size24, CAST(hour(ds) AS INTEGER) AS hour, CAST(dayofweek(ds) + 1 AS INTEGER) AS dayofweek FROM l)",
    "SELECT unique_id, ds, round(y, 4) AS y, round(lag1, 4) AS lag1, round(lag2, 4) AS lag2, round(lag24, 4) AS lag24, "
    "round(expanding_mean_lag1, 4) AS expanding_mean_lag1, round(rolling_mean_lag1_window_size24, 4) AS rolling_mean_lag1_window_size24, hour, dayofweek "
    "FROM t WHERE y IS NOT NULL AND lag1 IS NOT NULL AND lag2 IS NOT NULL AND lag24 IS NOT NULL AND expanding_mean_lag1 IS NOT NULL "
    "AND rolling_mean_lag1_window_size24 IS NOT NULL"))
def f24_supervised_table(spark, sf_dir):
    return round_doubles(wn.supervised_table(panels.events_hourly(spark, sf_dir)), 4)


# ---------------------------------------------------------------- skew-safe (chunked) twins: same SQL, same answers

@register("f1_lags_chunked", with_ctes("events_hourly", "SELECT unique_id, ds, " + ", ".join(f"round(lag(y, {k}) OVER {W()}, 4) AS lag{k}" for k in _LAGS) + " FROM events_hourly"))
def f1_lags_chunked(spark, sf_dir):
    """F1 with every series cut into 100-row chunks (+24-row halos): a hot series spreads over many tasks."""
    d = wn.add_lags(panels.events_hourly(spark, sf_dir), _LAGS, chunk_rows=100)
    return round_doubles(d.select("unique_id", "ds", *[f"lag{k}" for k in _LAGS]), 4)


@register("f16_acf_hourly_chunked", with_ctes("events_hourly", *_acf_sql("events_hourly"), "SELECT unique_id, lag, round(acf, 4) AS acf FROM acf_l"))
def f16_acf_hourly_chunked(spark, sf_dir):
    return round_doubles(explore.acf(panels.events_hourly(spark, sf_dir), chunk_rows=150), 4)


# ---------------------------------------------------------------- F10 inverse differencing, E3 sort, E4 bottom-n

@register("f10_undifference_forecast", with_ctes(
    "events_hourly", f"d AS (SELECT unique_id, ds, y, y - lag(y) OVER {W()} AS dy, row_number() OVER {W()} AS r, count(*) OVER {UW} AS n FROM events_hourly)",
    "last AS (SELECT unique_id, max_by(y, r) AS lvl, max(ds) AS mx FROM d GROUP BY 1)",
    "sn AS (SELECT unique_id, r - (n - 24) AS step, dy FROM d WHERE r > n - 24)",
    f"SELECT sn.unique_id, mx + to_hours(CAST(step AS BIGINT)) AS ds, round(lvl + sum(dy) OVER (PARTITION BY sn.unique_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS y "
    "FROM sn JOIN last ON sn.unique_id = last.unique_id"))
def f10_undifference_forecast(spark, sf_dir):
    """Seasonal-naive forecast (m = 24) of the differenced series, integrated back to levels from the last level."""
    from panelspark.operators import forecast as fc

    p = panels.events_hourly(spark, sf_dir)
    dif = wn.difference(p, 1)
    f = fc.forecast_baselines(dif, 24, "h", 24, ["SeasonalNaive"]).withColumnRenamed("SeasonalNaive", "y")
    return round_doubles(wn.undifference(f, p, 1, freq="h").select("unique_id", "ds", "y"), 4)


@register("e3_multi_key_sort", "SELECT c_mktsegment, c_custkey, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def e3_multi_key_sort(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", ["c_mktsegment", "c_custkey", "c_acctbal"])
    return c.orderBy("c_mktsegment", F.desc("c_acctbal"), "c_custkey").select("c_mktsegment", "c_custkey", rnd("c_acctbal", 2).alias("c_acctbal"))


@register("e4_bottom_n_customers", "SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer ORDER BY c_acctbal ASC, c_custkey ASC LIMIT 10")
def e4_bottom_n_customers(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal"])
    return c.orderBy(F.asc("c_acctbal"), F.asc("c_custkey")).limit(10).select("c_custkey", "c_name", rnd("c_acctbal", 2).alias("c_acctbal"))


# ---------------------------------------------------------------- the long daily series (ship_daily): F16, F18, F21, H15

@register("f16_acf_ship_daily", with_ctes("ship_daily", *_acf_sql("ship_daily"), "SELECT unique_id, lag, round(acf, 4) AS acf FROM acf_l"))
def f16_acf_ship_daily(spark, sf_dir):
    return round_doubles(explore.acf(panels.ship_daily(spark, sf_dir)), 4)


@register("f16_acf_ship_daily_chunked", with_ctes("ship_daily", *_acf_sql("ship_daily"), "SELECT unique_id, lag, round(acf, 4) AS acf FROM acf_l"))
def f16_acf_ship_daily_chunked(spark, sf_dir):
    """The long series cut into 400-row chunks with 100-row halos (bucketed positions by month)."""
    return round_doubles(explore.acf(panels.ship_daily(spark, sf_dir), chunk_rows=400, time_bucket="month"), 4)


@register("f18_acf_peaks_ship_daily", with_ctes("ship_daily", *_acf_sql("ship_daily"), *_PEAKS))
def f18_acf_peaks_ship_daily(spark, sf_dir):
    return round_doubles(explore.acf_peaks(explore.acf(panels.ship_daily(spark, sf_dir))), 4).withColumn("rank", F.col("rank").cast("int"))


@register("f21_adf_ship_daily")
def f21_adf_ship_daily(spark, sf_dir):
    from panelspark.operators import regression as rg

    return rg.adf(panels.ship_daily(spark, sf_dir))


# ---------------------------------------------------------------- the hourly panel itself, plain and skew-safe

_HOURLY_SQL = with_ctes("events_hourly", "SELECT unique_id, ds, round(y, 4) AS y FROM events_hourly")


@register("a3_events_hourly_panel", _HOURLY_SQL)
def a3_events_hourly_panel(spark, sf_dir):
    return round_doubles(panels.events_hourly(spark, sf_dir), 4)


@register("a3_events_hourly_panel_chunked", _HOURLY_SQL)
def a3_events_hourly_panel_chunked(spark, sf_dir):
    """Gap filling with 50-row chunks and a one-row forward halo (positions by day buckets)."""
    return round_doubles(panels.events_panel(spark, sf_dir, "h", chunk_rows=50), 4)
