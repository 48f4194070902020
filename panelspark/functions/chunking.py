"""Skew-safe series windows: split one long series over many tasks.

A window ``partitionBy(unique_id)`` puts a whole series in one task; if one series holds a third of the data that task
is the job.  Local window operators (lags, leads, bounded rolling frames, differences) only look ``back`` rows behind
and ``fwd`` rows ahead, so a series can be cut into chunks of ``chunk_rows`` consecutive rows if every chunk also
receives the ``back`` rows before it and the ``fwd`` rows after it (a *halo*):

1. positions: counts per (series, time bucket) → prefix offsets over that small table → ``row_number`` inside each
   (series, bucket).  No whole-series window anywhere;
2. chunk = pos // chunk_rows; each row is emitted once for its chunk plus, when it lies within ``back`` rows of the
   chunk's end (``fwd`` of its start), once more as a halo row of the next (previous) chunk — one ``explode`` pass;
3. the operator runs with ``Window.partitionBy(unique_id, chunk).orderBy(pos)`` (``series_keys`` context) and the halo
   rows are dropped afterwards.

Whole-series statistics (means, σ, counts) are not local: compute them with ``groupBy`` (partial aggregation) and join.
"""

from __future__ import annotations

import contextlib
import contextvars

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KEYS = contextvars.ContextVar("series_keys", default=(("unique_id",), "ds"))


def series_keys():
    """(partition columns, order column) of the current series window (see ``chunked``)."""
    return _KEYS.get()


@contextlib.contextmanager
def chunked_windows():
    token = _KEYS.set((("unique_id", "__chunk"), "__pos"))
    try:
        yield
    finally:
        _KEYS.reset(token)


def positions(panel: DataFrame, time_bucket: str = "month", key: str = "unique_id", order: str = "ds") -> DataFrame:
    """0-based position of every row inside its series (``__pos``) without a whole-series window."""
    b = F.date_trunc(time_bucket, F.col(order))
    d = panel.withColumn("__b", b)
    counts = d.groupBy(key, "__b").agg(F.count("*").alias("__cnt"))
    w = Window.partitionBy(key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(w), F.lit(0))).drop("__cnt")  # #series×#buckets rows
    d = d.join(offs, [key, "__b"])
    pos = F.col("__off") + F.row_number().over(Window.partitionBy(key, "__b").orderBy(order)) - 1
    return d.withColumn("__pos", pos).drop("__off", "__b")


def with_halo(d: DataFrame, back: int, fwd: int, chunk_rows: int) -> DataFrame:
    """Rows tagged with ``__chunk`` plus halo copies (``__halo`` true) for the neighbouring chunks."""
    if back > chunk_rows or fwd > chunk_rows:
        raise ValueError("chunk_rows must be at least the window reach")
    c = F.floor(F.col("__pos") / chunk_rows).cast("long")
    off = F.col("__pos") % chunk_rows
    tags = F.array(F.struct(c.alias("chunk"), F.lit(False).alias("halo")),
                   F.when(F.lit(back) > 0, F.when(off >= chunk_rows - back, F.struct((c + 1).alias("chunk"), F.lit(True).alias("halo")))),
                   F.when(F.lit(fwd) > 0, F.when(off < fwd, F.struct((c - 1).alias("chunk"), F.lit(True).alias("halo")))))
    e = d.select("*", F.explode(F.filter(tags, lambda t: t.isNotNull())).alias("__t"))
    return e.select(*d.columns, F.col("__t.chunk").alias("__chunk"), F.col("__t.halo").alias("__halo"))


def chunked(panel: DataFrame, fn, back: int = 0, fwd: int = 0, chunk_rows: int = 100_000,
            time_bucket: str = "month", keep_pos: bool = False) -> DataFrame:
    """Apply a local window operator ``fn(DataFrame) -> DataFrame`` chunk-wise (see module doc).  The result equals
    ``fn(panel)`` for every row whose windows reach at most ``back`` rows behind and ``fwd`` rows ahead.
    ``keep_pos`` keeps the 0-based series position ``__pos``."""
    d = with_halo(positions(panel, time_bucket), back, fwd, chunk_rows)
    with chunked_windows():
        out = fn(d)
    out = out.filter(~F.col("__halo")).drop("__chunk", "__halo")
    return out if keep_pos else out.drop("__pos")
