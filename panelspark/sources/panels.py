"""Long panels ``(unique_id string, ds timestamp_ntz, y double)`` built from stored tables.

A panel is the currency of every series operator.  Building one is a scan with pushed-down filters, a bucketing
expression and one partial/final aggregate; gap filling expands each observed row up to the next one (a generator, never a cross or
calendar join), so lags downstream are positional *and* calendar-true.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.sources.tables import read_table

PANEL_COLS = ("unique_id", "ds", "y")


def check_panel(df: DataFrame, extra_ok: bool = True) -> DataFrame:
    """Contract check at operator entry: the three panel columns exist with the right types."""
    types = dict(df.dtypes)
    for c in PANEL_COLS:
        if c not in types:
            raise ValueError(f"panel is missing column {c!r}; has {list(types)}")
    if types["ds"] not in ("timestamp_ntz", "timestamp", "date"):
        raise TypeError(f"panel column ds must be a timestamp, got {types['ds']}")
    if types["y"] not in ("double", "float", "int", "bigint", "decimal"):
        if not types["y"].startswith("decimal"):
            raise TypeError(f"panel column y must be numeric, got {types['y']}")
    return df


_NMIN = re.compile(r"^(\d*)min$")


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_seconds(ts: Column | str) -> Column:
    """Whole seconds since 1970-01-01 of a wall-clock ``timestamp_ntz`` — independent of the session time zone
    (``unix_timestamp`` would read the wall clock in the session zone)."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts)).cast("bigint")


def from_epoch_seconds(secs: Column) -> Column:
    """Inverse of ``epoch_seconds`` (a ``timestamp_ntz``), also zone independent."""
    return F.lit(EPOCH_NTZ).cast("timestamp_ntz") + F.make_dt_interval(secs=secs.cast("decimal(18,6)"))


def bucket(ts: Column | str, freq: str) -> Column:
    """Map a wall-clock timestamp to the stamp of its interval (``timestamp_ntz``), whatever the session time zone.

    freq: ``'Nmin'`` (N minutes, default 1), ``'h'``, ``'D'``, ``'ME'`` (month end), ``'MS'`` (month start).
    """
    ts = F.col(ts) if isinstance(ts, str) else ts
    m = _NMIN.match(freq)
    if m:
        n = int(m.group(1) or 1)
        return from_epoch_seconds(F.floor(epoch_seconds(ts) / (60 * n)) * (60 * n))
    if freq == "h":
        return from_epoch_seconds(F.floor(epoch_seconds(ts) / 3600) * 3600)
    if freq == "D":
        return F.to_date(ts).cast("timestamp_ntz")
    if freq == "ME":
        return F.last_day(ts).cast("timestamp_ntz")
    if freq == "MS":
        return F.trunc(ts, "month").cast("timestamp_ntz")
    raise ValueError(f"unsupported freq {freq!r}")


def step_interval(freq: str) -> Column:
    m = _NMIN.match(freq)
    if m:
        return F.expr(f"INTERVAL {int(m.group(1) or 1)} MINUTES")
    return {"h": F.expr("INTERVAL 1 HOUR"), "D": F.expr("INTERVAL 1 DAY")}[freq]


def stamp_sequence(lo: Column, hi: Column, freq: str) -> Column:
    """Array of every stamp from ``lo`` to ``hi`` (inclusive) at ``freq``."""
    if freq in ("ME", "MS"):
        months = F.sequence(F.trunc(lo, "month"), F.trunc(hi, "month"), F.expr("INTERVAL 1 MONTH"))
        if freq == "ME":
            return F.transform(months, lambda d: F.last_day(d).cast("timestamp_ntz"))
        return F.transform(months, lambda d: d.cast("timestamp_ntz"))
    return F.sequence(lo, hi, step_interval(freq))


def build_panel(df: DataFrame, id_col, ts_col: str, value_col: str, freq: str, agg: str = "sum") -> DataFrame:
    """A3: bucket raw rows to ``freq`` and aggregate to ``(unique_id, ds, y)``.

    ``id_col`` is a column name, a list of names (joined with ``'|'``) or a literal ``Column``.
    """
    if isinstance(id_col, Column):
        uid = id_col
    elif isinstance(id_col, (list, tuple)):
        uid = F.concat_ws("|", *[F.col(c).cast("string") for c in id_col])
    else:
        uid = F.col(id_col).cast("string")
    fn = {"sum": F.sum, "mean": F.avg, "last": F.last, "first": F.first, "max": F.max, "min": F.min,
          "count": F.count}[agg]
    extra = []
    if agg in ("last", "first"):
        # last/first by time, deterministic
        pick = F.max_by if agg == "last" else F.min_by
        yexpr = pick(F.col(value_col), F.col("__ts"))
        extra = [F.col(ts_col).alias("__ts")]
    else:
        yexpr = fn(F.col(value_col))
    return (df.select(uid.alias("unique_id"), bucket(ts_col, freq).alias("ds"), F.col(value_col), *extra)
              .groupBy("unique_id", "ds").agg(yexpr.cast("double").alias("y")))


def _before(ts: Column, freq: str) -> Column:
    """The stamp one step before ``ts``."""
    if freq in ("ME", "MS"):
        prev = F.add_months(F.trunc(ts, "month"), -1)
        return (F.last_day(prev) if freq == "ME" else prev).cast("timestamp_ntz")
    return ts - step_interval(freq)


def fill_gaps(panel: DataFrame, freq: str, fill=0.0, chunk_rows: int | None = None,
              time_bucket: str = "month") -> DataFrame:
    """Spine-fill each series between its own first and last stamp; missing ``y`` become ``fill``.

    ``fill="ffill"`` carries the last observed value forward (prices / bars).
    Each observed row expands into itself plus the missing stamps up to the next observed one
    (``lead(ds)`` + ``posexplode``): one window pass on the series partitioning, no calendar join and no second scan
    of the source.  Extra columns are carried on the observed rows and null on the filled ones.
    ``chunk_rows``: skew-safe — the next stamp comes from chunk-wise windows with a one-row forward halo.
    """
    nxt = F.col("__next")
    seq = F.when(nxt.isNull(), F.array(F.col("ds"))).otherwise(stamp_sequence(F.col("ds"), _before(nxt, freq), freq))
    extra = [c for c in panel.columns if c not in PANEL_COLS]
    if chunk_rows:  # skew-safe: the next stamp from chunk-wise windows with a one-row forward halo
        from panelspark.functions.chunking import chunked, series_keys

        def with_next(x):
            keys, order = series_keys()
            return x.withColumn("__next", F.lead("ds").over(Window.partitionBy(*keys).orderBy(order)))

        d = chunked(panel, with_next, fwd=1, chunk_rows=chunk_rows, time_bucket=time_bucket)
    else:
        d = panel.withColumn("__next", F.lead("ds").over(Window.partitionBy("unique_id").orderBy("ds")))
    d = d.select("*", F.posexplode(seq).alias("__k", "__ds"))
    filled = F.col("y") if fill == "ffill" else F.lit(fill)  # ffill: a price carries over the missing stamps
    out = d.select("unique_id", F.col("__ds").alias("ds"),
                   F.when(F.col("__k") == 0, F.col("y")).otherwise(filled).cast("double").alias("y"),
                   *[F.when(F.col("__k") == 0, F.col(c)).alias(c) for c in extra])
    return out


# ---------------------------------------------------------------------------------------------------------------
# Panels derived from the stored tables (FIXTURES.md §3)
# ---------------------------------------------------------------------------------------------------------------

def events_panel(spark: SparkSession, sf_dir: str, freq: str = "D", chunk_rows: int | None = None) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return fill_gaps(build_panel(ev, "event_type", "ts", "value", freq), freq, chunk_rows=chunk_rows, time_bucket="day")


def events_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(spark, sf_dir, "D")


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_panel(spark, sf_dir, "h")


def orders_monthly(spark: SparkSession, sf_dir: str, end: str | None = None) -> DataFrame:
    """Monthly (month-end) order value per market segment, over all orders; ``end``: an optional half-open bound.

    Orders are summed per (customer, month) *before* the customer join: the partial aggregate folds even a customer
    holding a third of all orders into ≤ one row per month per map task, so the join never sees a hot key's raw rows."""
    orders = read_table(spark, sf_dir, "orders", ["o_custkey", "o_totalprice", "o_orderdate"])
    if end is not None:
        orders = orders.filter(F.col("o_orderdate") < F.lit(end).cast("timestamp_ntz"))
    per_cust = orders.groupBy("o_custkey", bucket("o_orderdate", "ME").alias("ds")) \
                     .agg(F.sum("o_totalprice").alias("__v"))
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"])
    joined = per_cust.join(cust, per_cust.o_custkey == cust.c_custkey)
    return fill_gaps(build_panel(joined, "c_mktsegment", "ds", "__v", "ME"), "ME")


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem", ["l_returnflag", "l_shipdate", "l_quantity"])
    return fill_gaps(build_panel(li, "l_returnflag", "l_shipdate", "l_quantity", "D"), "D")


def load_bars(spark: SparkSession, sf_dir: str, ids: list[str] | None, start: str, end: str,
              table: str = "events", id_col: str = "event_type", ts_col: str = "ts",
              price_col: str = "value") -> DataFrame:
    """A2: half-open ``[start, end)`` history scan of stored bars, one price column kept, as a panel.

    The filters reach the Parquet scan (``PushedFilters``) and only three columns are read.
    """
    df = read_table(spark, sf_dir, table, [id_col, ts_col, price_col])
    cond = (F.col(ts_col) >= F.lit(start).cast("timestamp_ntz")) & (F.col(ts_col) < F.lit(end).cast("timestamp_ntz"))
    if ids:
        cond = cond & F.col(id_col).isin(list(ids))
    return df.filter(cond).select(F.col(id_col).cast("string").alias("unique_id"),
                                  F.col(ts_col).alias("ds"), F.col(price_col).cast("double").alias("y"))


def step_add(ts: Column, k: Column, freq: str) -> Column:
    """``ts`` moved ``k`` steps of ``freq`` forward (month ends stay month ends)."""
    m = _NMIN.match(freq)
    if freq == "ME":
        return F.last_day(F.add_months(F.trunc(ts, "month"), k)).cast("timestamp_ntz")
    if freq == "MS":
        return F.add_months(F.trunc(ts, "month"), k).cast("timestamp_ntz")
    if freq == "D":
        return ts + F.make_dt_interval(days=k)
    if freq == "h":
        return ts + F.make_dt_interval(hours=k)
    if m:
        return ts + F.make_dt_interval(mins=k * int(m.group(1) or 1))
    if freq == "W":
        return ts + F.make_dt_interval(days=k * 7)
    raise ValueError(freq)


def future_frame(panel: DataFrame, h: int, freq: str) -> DataFrame:
    """The next ``h`` stamps of every series ``(unique_id, ds, step)``; one aggregate + a generator."""
    last = panel.groupBy("unique_id").agg(F.max("ds").alias("__last"))
    f = last.select("unique_id", "__last", F.explode(F.sequence(F.lit(1), F.lit(h))).alias("step"))
    return f.select("unique_id", step_add(F.col("__last"), F.col("step"), freq).alias("ds"), "step")


def calendar_spine(df: DataFrame, ts_col: str, months_ahead: int = 0) -> DataFrame:
    """A5: month-end dates from the first month of ``ts_col`` to ``months_ahead`` months past its last month."""
    b = df.agg(F.min(ts_col).alias("lo"), F.max(ts_col).alias("hi"))
    seq = F.sequence(F.trunc("lo", "month"), F.add_months(F.trunc("hi", "month"), months_ahead), F.expr("INTERVAL 1 MONTH"))
    return b.select(F.explode(seq).alias("m")).select(F.last_day("m").cast("timestamp_ntz").alias("ds"))


def tail_rows(panel: DataFrame, k: int, freq: str | None = None) -> DataFrame:
    """The last ``k`` rows of every series.  With ``freq`` (a regular, spine-filled panel) the tail is found from the
    per-series last stamp (a partial/final aggregate) and stamp arithmetic — no window orders a whole series.
    Without ``freq``, a descending ``row_number`` is used (bounded by the series length)."""
    if freq is None:
        w = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
        return panel.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k).drop("__r")
    last = panel.groupBy("unique_id").agg(F.max("ds").alias("__last"))
    lo = step_add(F.col("__last"), F.lit(-(k - 1)), freq)
    return panel.join(last, "unique_id").filter(F.col("ds") >= lo).drop("__last")


def minute_bars(spark: SparkSession, sf_dir: str, freq: str = "1min") -> DataFrame:
    """Price bars from the stored events: last ``value`` per (event_type, minute), forward-filled."""
    ev = read_table(spark, sf_dir, "events", ["event_type", "ts", "value"])
    return fill_gaps(build_panel(ev, "event_type", "ts", "value", freq, agg="last"), freq, fill="ffill")


def last_two_days(panel: DataFrame) -> DataFrame:
    """B7 on a panel: ``day_rank`` 1 (last calendar day present) and 2 (the one before) per series; ranks the small
    set of distinct days, not the rows."""
    days = panel.select("unique_id", F.to_date("ds").alias("__day")).distinct()
    days = days.withColumn("day_rank", F.row_number().over(Window.partitionBy("unique_id").orderBy(F.desc("__day")))) \
               .filter(F.col("day_rank") <= 2)
    return panel.withColumn("__day", F.to_date("ds")).join(days, ["unique_id", "__day"]).drop("__day")
