"""Structured Streaming operators (K1–K3): the predict → observe → update loop as keyed state.

``transformWithStateInPandas`` in event time.  Arriving rows of a series wait in a map state (on the executor's disk) until the
watermark has passed them; an event-time timer then takes the passed rows in the order of (ds, y), runs them through the model's
state and emits them.  So a row that is late by less than the watermark's delay takes its place in the order; a row that comes when
its series has let out rows up to its time is dropped.  The state of a series is the last ``max_lag + 1`` levels (K1/K2) or cash,
shares and a counter (K3), and the rows newer than the watermark: the delay and the files of a trigger bound it, never the history.

Rows come to the state as blocks, the columns' bytes of some rows of a series (``_packed``): Spark hands a state function its rows
one at a time, as Python tuples.

A finite replay ends with a beat: one row of no series that moves the watermark past all others (``run_available(close=True)``).
Models are applied downstream on the stream (``model.transform``), because Spark ML models cannot run inside a state function.
"""

from __future__ import annotations

import contextlib
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from panelspark.session import cut_lineage
from panelspark.sources.tables import SCHEMAS

_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_STORE = "spark.sql.streaming.stateStore"
#: RocksDB, whose stores of one executor share their memory.
_ROCKSDB = {f"{_STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
            f"{_STORE}.rocksdb.boundedMemoryUsage": "true", f"{_STORE}.rocksdb.maxMemoryUsageMB": "256"}
#: The closing beat's time, in microseconds: the year 2261, near the last that pandas holds.
_LAST = 9_183_110_400_000_000
#: Waiting rows in a block of the state, rows of all series that wait in a task for their blocks to fill, and rows put
#: through the model and sent on at a time.
BLOCK_ROWS, PACK_ROWS, OUT_ROWS = 20_000, 200_000, 100_000
#: Rows of a staged piece, and series up to which the state's partitions are chosen by their names.
PIECE_ROWS, FEW_SERIES = 3_000_000, 256


def event_stream(spark, path: str, max_files_per_trigger: int | None = None, beats: str | None = None) -> DataFrame:
    """Stored events as a stream with the fixed schema, as a panel ``(unique_id=event_type, ds=ts, y=value)``.  ``beats``: a folder
    of beats (see ``beat``), read beside the events."""
    r = spark.readStream.schema(SCHEMAS["events"])
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    ev = r.parquet(path)
    ev = ev.select(F.col("event_type").alias("unique_id"), F.col("ts").alias("ds"), F.col("value").alias("y"))
    if beats is None:
        return ev
    make_folder(spark, beats)
    b = spark.readStream.schema("us long").parquet(beats)
    b = b.select(F.lit(None).cast("string").alias("unique_id"), _stamp("us").alias("ds"), F.lit(None).cast("double").alias("y"),
                 F.lit(True).alias("beat"))
    return ev.withColumn("beat", F.lit(False)).unionByName(b)


def make_folder(spark, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(place)


def beat(spark, beats: str, us: int = _LAST) -> None:
    """Let the streams that read ``beats`` know that time has come to ``us``."""
    spark.createDataFrame([(us,)], "us long").coalesce(1).write.mode("append").parquet(beats)


def stage(events: DataFrame, folder: str, pieces: int) -> tuple[str, int, str, int]:
    """Write stored events as files that arrive in the order of time, equal spans of time one after another: ``pieces`` of them, or
    as many as have ``PIECE_ROWS`` rows on average.  The events are read once for the spans and once to part them.  Returns the
    files' pattern, the files of a piece at most, the delay that a watermark needs (a piece's span), and the partitions of a state
    by series."""
    spark = events.sparkSession
    rows = events.select("event_type", "ts", "value").withColumn("us", F.expr(_micros("ts"))).where("us IS NOT NULL")
    series = cut_lineage(rows.groupBy("event_type").agg(F.min("us").alias("lo"), F.max("us").alias("hi"), F.count("*").alias("n")))
    lo, hi, n = series.agg(F.min("lo"), F.max("hi"), F.sum("n")).first()
    lo, hi, pieces = lo or 0, hi or 0, max(pieces, -(-(n or 0) // PIECE_ROWS))
    span = (hi - lo) // pieces + 1
    parted = rows.withColumn("piece", F.expr(f"CAST((us - {lo}L) DIV {span}L AS INT)")).drop("us")
    parted.hint("rebalance", "piece").write.partitionBy("piece").parquet(f"{folder}/parted")
    stored = spark.read.schema(parted.schema).parquet(f"{folder}/parted")
    most = 1
    for i in range(pieces):
        place = f"{folder}/in/{i:05d}"
        stored.where(F.col("piece") == i).drop("piece").write.parquet(place)
        most = max(most, len(spark.read.schema(events.schema).parquet(place).inputFiles()))
    return f"{folder}/in/*", most, f"{span // 1_000_000 + 1} seconds", _state_partitions(series)


def _state_partitions(series: DataFrame) -> int:
    """Partitions of a state by the ``event_type`` of ``series`` (a row each): those of the session, but for few series no more than
    four each, of which the number that deals them out most evenly (each partition costs a store in every trigger)."""
    most = int(series.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [r[0] for r in series.select(F.hash("event_type")).limit(FEW_SERIES + 1).collect()]
    if not names or len(names) > FEW_SERIES:
        return most
    return min(range(min(len(names), most), min(4 * len(names), most) + 1),
               key=lambda k: max(np.bincount([h % k for h in names])))


def _micros(c: str) -> str:
    """Wall-clock microseconds, whatever the session's time zone."""
    return f"timestampdiff(MICROSECOND, {_EPOCH}, {c})"


def _stamp(c: str):
    return F.expr(f"timestampadd(MICROSECOND, {c}, {_EPOCH})")


# --- state

def _bytes(column: np.ndarray) -> bytes:
    """The column's bytes, 8 a value; a column of one value (by its bytes) as that value."""
    bits = column.view("int64")
    return column[:1].tobytes() if (bits == bits[:1]).all() else column.tobytes()


def _opened(us: bytes, values) -> list[np.ndarray]:
    """us and the columns of a block."""
    us = np.frombuffer(us, "int64")
    return [us, *(x if len(x) == len(us) else np.repeat(x, len(us)) for x in (np.frombuffer(v, float) for v in values))]


def _blocks(us, columns) -> Iterator[tuple[bytes, ...]]:
    for i in range(0, len(us), BLOCK_ROWS):
        yield us[i:i + BLOCK_ROWS].tobytes(), *(_bytes(c[i:i + BLOCK_ROWS]) for c in columns)


def _packed(rows: DataFrame, values: tuple[str, ...]) -> DataFrame:
    """Rows ``(unique_id, us, *values, beat)`` as blocks of a series' rows, with the time of the last; a beat is a row of its own."""

    def batch_of(name, last, beat, blobs):
        columns = [pa.array([name], pa.string()), pa.array([last], pa.int64()), pa.array([beat], pa.bool_()),
                   *(pa.array([b], pa.binary()) for b in blobs)]
        return pa.RecordBatch.from_arrays(columns, ["unique_id", "last", "beat", "us", *values])

    def sent(name, parts):
        us, columns = _joined(parts)
        for i, blobs in enumerate(_blocks(us, columns)):
            yield batch_of(name, int(us[i * BLOCK_ROWS:(i + 1) * BLOCK_ROWS].max()), False, blobs)

    def pack(batches):
        held, count, total = {}, {}, 0
        for batch in batches:
            beat = batch.column("beat").to_numpy(zero_copy_only=False).astype(bool)
            for us in batch.column("us").filter(pa.array(beat)).to_pylist():
                yield batch_of(None, us, True, [b""] * (1 + len(values)))
            batch = batch.filter(pa.array(~beat))
            if not batch.num_rows:
                continue
            us = batch.column("us").fill_null(np.iinfo(np.int64).min).to_numpy()
            columns = [batch.column(v).cast(pa.float64()).to_numpy(zero_copy_only=False) for v in values]
            series = batch.column("unique_id").dictionary_encode()
            names, place = series.dictionary.to_pylist(), series.indices.fill_null(-1).to_numpy()
            order = np.argsort(place, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(place[order])) + 1):
                name = names[place[at[0]]] if place[at[0]] >= 0 else None
                held.setdefault(name, []).append([us[at], *(c[at] for c in columns)])
                count[name] = count.get(name, 0) + len(at)
                if count[name] >= BLOCK_ROWS:
                    total -= count.pop(name) - len(at)
                    yield from sent(name, held.pop(name))
                else:
                    total += len(at)
            if total >= PACK_ROWS:
                for name, parts in held.items():
                    yield from sent(name, parts)
                held, count, total = {}, {}, 0
        for name, parts in held.items():
            yield from sent(name, parts)

    return rows.mapInArrow(pack, "unique_id string, last bigint, beat boolean, us binary, "
                           + ", ".join(f"{v} binary" for v in values))


class _InOrder(StatefulProcessor):
    """Rows ``(us, *values)`` of a series in order, once the watermark has passed them.  They wait in blocks, each an element of the
    map state by its number and its first time, so a block that the watermark has not come to stays as it is.  (A list state reads
    the whole list for each element that is added.)  Subclasses keep a model state and answer ``step(model, us, columns)`` (arrays
    of rows in order, at most ``OUT_ROWS`` a call) with the new state and the output's columns."""

    values: tuple[str, ...] = ("y",)
    model = "levels array<double>"

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "number bigint, first bigint",
                                          "us binary, " + ", ".join(f"{c} binary" for c in self.values))
        self.state = handle.getValueState("model", self.model)
        self.mark = handle.getValueState("mark", "passed bigint, blocks bigint")

    def marked(self) -> tuple[int, int]:
        """The time up to which the series' rows went out, and the number of its next block."""
        return tuple(self.mark.get()) if self.mark.exists() else (0, 0)

    def hold(self, number: int, us, columns) -> int:
        """Let rows wait; the number of the next block."""
        for i, block in enumerate(_blocks(us, columns)):
            first = int(us[i * BLOCK_ROWS:(i + 1) * BLOCK_ROWS].min())
            self.waiting.updateValue((number, first), block)
            number += 1
        return number

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0
        done, number = self.marked()
        for pdf in rows:
            pdf = pdf[~pdf["beat"].astype(bool)]
            for blobs in zip(*(pdf[c] for c in ("us", *self.values))):
                us, *columns = _opened(blobs[0], blobs[1:])
                if (us <= done).any():
                    us, columns = us[us > done], [c[us > done] for c in columns]
                if not len(us):
                    continue
                first = int(us.min()) if first is None else min(first, int(us.min()))
                held.append([us, *columns])
                n += len(us)
                if n >= BLOCK_ROWS:
                    number = self.hold(number, *_joined(held))
                    held, n = [], 0
        if held:
            number = self.hold(number, *_joined(held))
        if first is not None:
            self.mark.update((done, number))
            self.handle.registerTimer(-(-first // 1000))
        yield self.frame(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        done, number = self.marked()
        if done < passed:  # else another timer of this trigger has let them out
            ready, first = [], None
            for place in list(self.waiting.keys()):
                start = place[1]
                if start <= passed:
                    block = self.waiting.getValue(place)
                    self.waiting.removeKey(place)
                    us, *columns = _opened(block[0], block[1:])
                    late = us > passed
                    start = None
                    if late.any():
                        number, start = self.hold(number, us[late], [c[late] for c in columns]), int(us[late].min())
                        us, columns = us[~late], [c[~late] for c in columns]
                    ready.append([us, *columns])
                if start is not None:
                    first = start if first is None else min(first, start)
            if first is not None:
                self.handle.registerTimer(-(-first // 1000))
            self.mark.update((passed, number))
            if ready:
                us, columns = _joined(ready)
                del ready
                order = np.lexsort([*columns[::-1], us])
                model = self.state.get() if self.state.exists() else None
                for i in range(0, len(us), OUT_ROWS):
                    at = order[i:i + OUT_ROWS]
                    model, out = self.step(model, us[at], [c[at] for c in columns])
                    yield self.frame(key, out)
                self.state.update(model)
        yield self.frame(key, [])

    def frame(self, key, columns: list) -> pd.DataFrame:
        """The output's columns after the series' name; strings as objects."""
        n = len(columns[0]) if columns else 0
        names = [c.split()[0] for c in self.out.split(", ")]
        kinds = {"string": object, "double": float, "bigint": "int64"}
        made = [[key[0]] * n, *columns] if columns else [[]] * len(names)
        return pd.DataFrame({name: pd.Series(c, dtype=kinds[k.split()[1]])
                             for name, k, c in zip(names, self.out.split(", "), made)})

    def close(self) -> None:
        pass


def _joined(blocks):
    """(us, columns) of blocks of rows."""
    us, *columns = (np.concatenate(c) for c in zip(*blocks))
    return us, columns


class _Lags(_InOrder):
    def __init__(self, lags):
        self.lags = tuple(lags)
        self.out = "unique_id string, us bigint, y double, level_prev double, " + ", ".join(
            f"lag{k} double" for k in self.lags)

    def step(self, model, us, columns):
        held = np.array(model[0] if model else [], float)
        levels = np.concatenate([held, columns[0]])
        place = np.arange(len(held), len(levels))

        def back(k):
            return np.where(place >= k, levels[np.maximum(place - k, 0)], np.nan)

        out = [us, levels[place], back(1), *(back(k) - back(k + 1) for k in self.lags)]
        return ([float(x) for x in levels[-(max(self.lags) + 1):]],), out


class _Portfolio(_InOrder):
    values = ("y", "c", "phi", "q")
    model = "cash double, shares double, n bigint"
    out = ("unique_id string, us bigint, y double, next_pred double, signal string, action string, cash double, shares double, "
           "value double")

    def __init__(self, initial_cash: float, warmup: int):
        self.initial, self.warmup = (float(initial_cash), 0.0, 0), warmup

    def step(self, model, us, columns):
        price, c, phi, q = columns
        cash, shares, n = model or self.initial
        with np.errstate(all="ignore"):
            nxt = c + phi * price  # NaN without coefficients: no signal
            warm = np.arange(n + 1, n + 1 + len(price)) > self.warmup
            buy = warm & (price < nxt - q) & (nxt > price)
            sell = warm & (price > nxt + q) & (nxt < price) & ~buy
        # only trades change cash and shares, and only rows with a signal trade
        trades, held = [], [(cash, shares)]
        at = np.flatnonzero(buy | sell)
        for i, p, buys in zip(at.tolist(), price[at].tolist(), buy[at].tolist()):
            if buys:
                if cash > p > 0 and math.isfinite(cash / p):
                    k = math.floor(cash / p)
                    cash -= k * p
                    shares += k
                    trades.append(i)
                    held.append((cash, shares))
            elif shares > 0 and math.isfinite(cash + p * shares):
                cash += p * shares
                shares = 0.0
                trades.append(i)
                held.append((cash, shares))
        traded = np.zeros(len(price), np.int64)
        traded[trades] = 1
        cash_at, shares_at = np.array(held, float)[np.cumsum(traded)].T
        words = np.array(["HOLD", "BUY", "SELL"], object)
        signal = buy + 2 * sell
        with np.errstate(all="ignore"):
            value = cash_at + shares_at * price
        return (float(cash), float(shares), int(n + len(price))), [us, price, nxt, words[signal], words[signal * traded], cash_at,
                                                                   shares_at, value]


def _run(stream: DataFrame, processor: _InOrder, delay: str) -> DataFrame:
    beats = F.col("beat") if "beat" in stream.columns else F.lit(False)
    rows = stream.select("unique_id", F.expr(_micros("ds")).alias("us"), *processor.values, beats.alias("beat"))
    blocks = _packed(rows, processor.values).withColumn("at", F.timestamp_micros("last")).drop("last").withWatermark("at", delay)
    out = blocks.groupBy("unique_id").transformWithStateInPandas(
        processor, outputStructType=processor.out, outputMode="append", timeMode="EventTime")
    return out.withColumn("ds", _stamp("us")).select(*[F.col("ds") if c == "us" else F.col(c) for c in out.columns])


def online_lag_features(stream: DataFrame, lags=(1, 2, 3), delay: str = "0 seconds") -> DataFrame:
    """K1: per arriving row, the Δ-lag features of its series' past (then the row joins the state).  ``delay``: how late a row may
    come and still be put in order."""
    return _run(stream, _Lags(lags), delay)


def online_forecast(stream: DataFrame, model, lags=(1, 2, 3), date_feats=("hour",), delay: str = "0 seconds") -> DataFrame:
    """K1 + model: one-step forecasts on the stream (``yhat`` = previous level + predicted Δ)."""
    from panelspark.operators.windows import date_features

    f = online_lag_features(stream, lags, delay).withColumns(date_features("ds", date_feats))
    return model.transform(f).withColumn("yhat", F.col("level_prev") + F.col("prediction")).drop("features", "prediction")


def band_alerts(forecasts: DataFrame, halfwidths: DataFrame) -> DataFrame:  # halfwidths: ml.conformal_halfwidths
    """K2: stream ⋈ static per-series half-width (conformal quantile) → rows whose actual breaches ŷ ± q."""
    j = forecasts.join(halfwidths, "unique_id")  # one row per series: the join strategy follows its measured size
    return j.withColumns({"lower": F.col("yhat") - F.col("q"), "upper": F.col("yhat") + F.col("q")}) \
            .filter((F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper")))


def online_portfolio(stream: DataFrame, coefs: DataFrame, initial_cash: float = 10000.0, warmup: int = 11,
                     delay: str = "0 seconds") -> DataFrame:
    """K3: signals (I1 rules, AR(1) one-step forecast ``c + φ·y`` with band ±q) and the cash/shares fold (I2) in one
    state function.  ``coefs``: ``(unique_id, c, phi, q)``, fitted in batch and joined to the stream; a series without
    coefficients is kept and always holds.  A trade whose shares or proceeds are no finite number is not made (HOLD)."""
    given = coefs.select("unique_id", *[F.col(c).cast("double").alias(c) for c in ("c", "phi", "q")])
    return _run(stream.join(given, "unique_id", "left"), _Portfolio(initial_cash, warmup), delay)


@contextlib.contextmanager
def _settings(spark, settings: dict[str, str]):
    """The session's own settings come back afterwards."""
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(df: DataFrame, name: str, folder: str | None = None, beats: str | None = None, close: bool = False) -> DataFrame:
    """Process everything available into a Parquet sink and read it back.  Sink and checkpoint are a new sub-folder of
    ``<spark.checkpoint.dir>/streams`` (shared, survives executor loss), or ``folder``; a second call with the same folder goes on
    where the first ended.  ``close``: a last beat in ``beats`` lets all rows that still wait out."""
    from panelspark.session import stream_checkpoint

    spark = df.sparkSession
    folder = folder or stream_checkpoint(spark, f"{name}-{uuid.uuid4().hex}")
    with _settings(spark, _ROCKSDB):  # map states and timers need the RocksDB state store
        for last in (False, True) if close else (False,):
            if last:
                beat(spark, beats)
            q = (df.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
                   .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start())
            q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{folder}/rows")


def replay(events: DataFrame, build, name: str, pieces: int = 4) -> DataFrame:
    """Stored events as a stream of ``pieces`` triggers (more where they are many, see ``stage``), through ``build(stream, delay)``,
    to its end."""
    from panelspark.session import stream_checkpoint

    spark = events.sparkSession
    folder = stream_checkpoint(spark, f"{name}-{uuid.uuid4().hex}")
    path, files, delay, partitions = stage(events, f"{folder}/staged", pieces)
    stream = event_stream(spark, path, files, f"{folder}/beats")
    with _settings(spark, {"spark.sql.shuffle.partitions": str(partitions)}):
        return run_available(build(stream, delay), name, folder, f"{folder}/beats", close=True)
