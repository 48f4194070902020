"""Batch == stream: the online operators give the batch answers on the same rows (K1–K3)."""

import os
import tempfile

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import SF001
from panelspark.operators import ml
from panelspark.streaming import online

LAGS = (1, 2, 3)


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """A state store for each partition and trigger: two are enough here."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def _closed(spark, src, build, files=1):
    """A replay of files to its end."""
    d = tempfile.mkdtemp(prefix="ck-")
    stream = online.event_stream(spark, src, files, f"{d}/beats")
    return online.run_available(build(stream), "test", f"{d}/run", f"{d}/beats", close=True)


def _chunked_events(n_files=3):
    t = pq.read_table(f"{SF001}/events.parquet").sort_by("ts")
    d = tempfile.mkdtemp(prefix="ev-stream-")
    edges = np.linspace(0, t.num_rows, n_files + 1).astype(int)
    for i in range(n_files):
        p = os.path.join(d, f"part-{i}.parquet")
        pq.write_table(t.slice(edges[i], edges[i + 1] - edges[i]), p)
        os.utime(p, (1_700_000_000 + i * 10, 1_700_000_000 + i * 10))  # strictly increasing mtimes: read in order
    return d


def _batch_panel(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    return ev.select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))


def test_online_lag_features_equal_batch(spark):
    src = _chunked_events()
    got = _closed(spark, src, lambda stream: online.online_lag_features(stream, LAGS))
    want = ml.lag_features(_batch_panel(spark), LAGS, date_feats=())
    cols = ["unique_id", "ds", "y", "level_prev", *[f"lag{k}" for k in LAGS]]
    g = got.select(*cols).orderBy("unique_id", "ds").toPandas()
    w = want.select(*cols).orderBy("unique_id", "ds").toPandas()
    assert len(g) == len(w) > 0
    assert g.equals(w) or np.allclose(g[cols[2:]].fillna(-1e9).to_numpy(float), w[cols[2:]].fillna(-1e9).to_numpy(float))


def test_online_forecast_equals_batch_replay_and_alerts(spark):
    src = _chunked_events()
    feats = ml.lag_features(_batch_panel(spark), LAGS)
    names = ml.feature_names(LAGS)
    model = ml.fit_global(feats, names, "gbt", maxIter=10, maxDepth=3)
    batch = ml.one_step_replay(model, feats, F.lit(True)).dropna(subset=["yhat"])
    got = _closed(spark, src, lambda stream: online.online_forecast(stream, model, LAGS)).dropna(subset=["yhat"])
    a = got.select("unique_id", "ds", "yhat").orderBy("unique_id", "ds").toPandas()
    b = batch.select("unique_id", "ds", "yhat").orderBy("unique_id", "ds").toPandas()
    assert len(a) == len(b) > 0 and np.allclose(a["yhat"], b["yhat"])
    # K2: alerts on the stream = batch rows outside yhat ± q
    q = spark.createDataFrame([(u, 5.0) for u in ("click", "view", "purchase", "signup", "error")], "unique_id string, q double")
    alerts = _closed(spark, src, lambda stream: online.band_alerts(online.online_forecast(stream, model, LAGS), q))
    want = batch.filter(F.abs(F.col("y") - F.col("yhat")) > 5.0).count()
    assert alerts.count() == want


def test_online_portfolio_equals_sequential_loop(spark):
    src = _chunked_events()
    coefs = spark.createDataFrame([(u, 1.0, 0.9, 2.0) for u in ("click", "view", "purchase", "signup", "error")],
                                  "unique_id string, c double, phi double, q double")
    got = _closed(spark, src, lambda stream: online.online_portfolio(stream, coefs, 1000.0)).orderBy(
        "unique_id", "ds").toPandas()
    pdf = _batch_panel(spark).orderBy("unique_id", "ds").toPandas()
    for uid, g in pdf.groupby("unique_id"):
        cash, shares, vals = 1000.0, 0.0, []
        for n, price in enumerate(g["y"], start=1):
            nxt = 1.0 + 0.9 * price
            sig = "HOLD"
            if n > 11 and price < nxt - 2.0 and nxt > price:
                sig = "BUY"
            elif n > 11 and price > nxt + 2.0 and nxt < price:
                sig = "SELL"
            if sig == "BUY" and cash > price > 0:
                k = np.floor(cash / price)
                cash -= k * price
                shares += k
            elif sig == "SELL" and shares > 0:
                cash += price * shares
                shares = 0.0
            vals.append(cash + shares * price)
        assert np.allclose(got[got.unique_id == uid]["value"].to_numpy(), vals)


def test_rows_with_equal_timestamps_are_kept(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{s:02d}", 1, "a", float(v), "") for i, (s, v) in
            enumerate([(0, 3), (0, 1), (1, 5), (1, 4), (1, 5), (2, 9)])]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp_ntz("ts")).repartition(3).write.parquet(str(tmp_path / "events"))
    src = str(tmp_path / "events")
    got = _closed(spark, src, lambda stream: online.online_lag_features(stream, (1,)), 9).orderBy("ds", "y").collect()
    assert [r.y for r in got] == [1.0, 3.0, 4.0, 5.0, 5.0, 9.0]
    assert [r.level_prev for r in got] == [None, 1.0, 3.0, 4.0, 5.0, 5.0]
    # a series without coefficients is kept and holds
    none = spark.createDataFrame([("b", 1.0, 0.9, 0.1)], "unique_id string, c double, phi double, q double")
    held = _closed(spark, src, lambda stream: online.online_portfolio(stream, none, 100.0, warmup=0), 9).collect()
    assert len(held) == 6 and {r.signal for r in held} == {"HOLD"} and {r.value for r in held} == {100.0}


def _event_files(spark, folder, pieces):
    """One file for each piece, in this order of arrival; rows: (second, value)."""
    for i, rows in enumerate(pieces):
        made = [(j, f"2024-01-01 {s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}", 1, "a", float(v), "") for j, (s, v) in enumerate(rows)]
        df = spark.createDataFrame(made, "event_id long, ts string, user_id long, event_type string, value double, props string")
        df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.parquet(f"{folder}/{i:03d}")
    return f"{folder}/*"


def test_many_triggers_order_late_rows(spark, tmp_path):
    """Twenty triggers whose rows overlap by less than the delay equal the batch; a row that is later than that is dropped."""
    rng = np.random.default_rng(5)
    stamps = np.arange(0, 4000, 10)
    arrival = np.argsort(stamps + rng.uniform(0, 250, len(stamps)))
    pieces = [[(int(stamps[i]), float(i)) for i in part] for part in np.array_split(arrival, 20)]
    pieces[-1].append((5, -1.0))  # an hour late
    src = _event_files(spark, str(tmp_path), pieces)
    got = _closed(spark, src, lambda stream: online.online_lag_features(stream, (1, 2), "300 seconds")).orderBy("ds").collect()
    assert [r.y for r in got] == [float(i) for i in range(len(stamps))]
    assert [r.level_prev for r in got] == [None, *[float(i) for i in range(len(stamps) - 1)]]
    assert [r.lag2 for r in got[3:]] == [1.0] * (len(stamps) - 3)


def test_staged_events_replay_in_order(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    got = online.replay(ev, lambda stream, delay: online.online_lag_features(stream, LAGS, delay), "staged", 3).toPandas()
    want = ml.lag_features(_batch_panel(spark), LAGS, date_feats=()).toPandas()
    cols = ["unique_id", "ds", "y", "level_prev", *[f"lag{k}" for k in LAGS]]
    got, want = (x[cols].sort_values(["unique_id", "ds", "y"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and np.allclose(got[cols[2:]].fillna(-1e9).to_numpy(float), want[cols[2:]].fillna(-1e9).to_numpy(float))


def test_portfolio_that_compounds_without_end_holds(spark, tmp_path):
    """Each round multiplies the cash by 10,000, until a trade's proceeds would be no finite number."""
    prices = [1.0, 10_000.0] * 120
    src = _event_files(spark, str(tmp_path), [[(i, p) for i, p in enumerate(prices)]])
    coefs = spark.createDataFrame([("a", 5000.0, 0.0, 1.0)], "unique_id string, c double, phi double, q double")
    got = _closed(spark, src, lambda stream: online.online_portfolio(stream, coefs, 100.0, 0)).orderBy("ds").collect()
    assert len(got) == 240 and all(np.isfinite(r.cash) for r in got)
    assert got[-1].action == "HOLD" and got[0].action == "BUY" and max(r.cash for r in got) > 1e300


def test_rows_reach_the_state_in_blocks(spark, monkeypatch):
    """A row of the state function's input for many rows of a series; beats and series without a name stay apart."""
    rows = [(f"s{i % 3}" if i % 4 else None, 1_000_000 * i, None if i % 7 == 0 else float(i), 0.5, False) for i in range(900)]
    df = spark.createDataFrame([*rows, (None, 5, None, None, True)], "unique_id string, us long, y double, c double, beat boolean")
    got = online._packed(df.coalesce(1), ("y", "c")).collect()
    assert len(got) == 5 and sum(r.beat for r in got) == 1
    found = []
    for r in got:
        if not r.beat:
            us, y, c = online._opened(bytes(r.us), [bytes(r.y), bytes(r.c)])
            assert r.last == us.max() and len(r.c) == 8 and (c == 0.5).all()
            found += [(r.unique_id, int(a), None if np.isnan(b) else float(b)) for a, b in zip(us, y)]
    assert sorted(found, key=repr) == sorted([r[:3] for r in rows], key=repr)


def test_many_events_are_staged_in_more_pieces(spark, tmp_path, monkeypatch):
    """A piece has so many rows on average, so a trigger's rows don't grow with the events; the replay is the same."""
    monkeypatch.setattr(online, "PIECE_ROWS", 100)
    monkeypatch.setattr(online, "BLOCK_ROWS", 7)
    monkeypatch.setattr(online, "OUT_ROWS", 11)
    ev = spark.read.parquet(f"{SF001}/events.parquet").limit(950)
    pattern, _, _, partitions = online.stage(ev, str(tmp_path / "staged"), 2)
    assert len(os.listdir(pattern[:-2])) == 10 and partitions <= 2
    held = spark.read.parquet(pattern)
    assert held.count() == 950
    panel = ev.select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    got = online.replay(ev, lambda stream, delay: online.online_lag_features(stream, LAGS, delay), "staged", 2).toPandas()
    want = ml.lag_features(panel, LAGS, date_feats=()).toPandas()
    cols = ["unique_id", "ds", "y", "level_prev", *[f"lag{k}" for k in LAGS]]
    got, want = (x[cols].sort_values(["unique_id", "ds", "y"]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and np.allclose(got[cols[2:]].fillna(-1e9).to_numpy(float), want[cols[2:]].fillna(-1e9).to_numpy(float))


def test_few_series_are_dealt_to_states_evenly(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    series = spark.createDataFrame([(u,) for u in ("click", "view", "purchase", "signup", "error")], "event_type string")
    n = online._state_partitions(series)
    at = [r[0] for r in series.select(F.pmod(F.hash("event_type"), F.lit(n))).collect()]
    assert n <= 20 and len(set(at)) == 5
    assert online._state_partitions(series.limit(0)) == 200


def test_portfolio_step_equals_a_loop():
    pick, n = np.random.default_rng(4), 4000
    price = pick.choice([0.0, -3.0, np.nan, 1e-300, 1e300, *np.round(pick.exponential(50, 40), 2)], n)
    c, phi, q = np.full(n, 50.0), pick.choice([0.01, np.nan], n, p=[0.95, 0.05]), np.full(n, 20.0)
    portfolio = online._Portfolio(10000.0, 11)
    cash, shares, want = 10000.0, 0.0, []
    for i in range(n):
        p, nxt, signal, action = float(price[i]), float(c[i] + phi[i] * price[i]), "HOLD", "HOLD"
        if i + 1 > 11:
            signal = "BUY" if p < nxt - 20.0 and nxt > p else "SELL" if p > nxt + 20.0 and nxt < p else "HOLD"
        if signal == "BUY" and cash > p > 0 and np.isfinite(cash / p):
            k = int(np.floor(cash / p))
            cash, shares, action = cash - k * p, shares + k, "BUY"
        elif signal == "SELL" and shares > 0 and np.isfinite(cash + p * shares):
            cash, shares, action = cash + p * shares, 0.0, "SELL"
        want.append((i, p, nxt, signal, action, cash, shares, cash + shares * p))
    model, got = None, []
    for i in range(0, n, 700):
        model, out = portfolio.step(model, np.arange(i, min(i + 700, n)), [x[i:i + 700] for x in (price, c, phi, q)])
        got += zip(*(list(x) for x in out))
    assert model == (cash, shares, n) and {w[4] for w in want} == {"BUY", "SELL", "HOLD"}
    assert [tuple(map(str, map(lambda x: x.item() if hasattr(x, "item") else x, g))) for g in got] == [tuple(map(str, w)) for w in want]


def test_pairs_take_the_value_before_the_hour(spark, tmp_path):
    """The fits' pairs are written once, ordered in windows of an hour; ties, gaps, nulls and series without a name included."""
    from pyspark.sql import Window

    from panelspark.plans import q_stream

    pick = np.random.default_rng(6)
    rows = [(i, f"2024-01-0{1 + int(d)} {int(h):02d}:{int(m):02d}:00", 1, [None, "a", "b"][int(k)], None if i % 11 == 0 else float(i % 17), "")
            for i, (d, h, m, k) in enumerate(zip(*(pick.integers(0, x, 600) for x in (3, 5, 3, 3))))]
    rows += [(900 + i, None, 1, "a", float(i), "") for i in range(3)]
    ev = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    ev = ev.withColumn("ts", F.to_timestamp_ntz("ts"))
    ev.repartition(4).write.parquet(str(tmp_path / "events.parquet"))
    got = q_stream._pairs(spark, str(tmp_path))
    w = Window.partitionBy("event_type").orderBy("ts", "value")
    want = ev.select(F.col("event_type").alias("unique_id"), F.col("value").alias("y"), F.lag("value").over(w).alias("prev"))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert "Window" not in got._jdf.queryExecution().toString()
