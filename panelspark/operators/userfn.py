"""User-function surface (L1–L3): per-group frames, same-length group transforms, pluggable feature functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def apply_per_group(df: DataFrame, keys, fn: Callable, schema: str) -> DataFrame:
    """L1: ``fn(pandas frame) -> pandas frame`` per group (``applyInPandas``).  A group is materialised in one Python
    worker, so key by something bounded (e.g. series × day), not by a whole unbounded series."""
    return df.groupBy(*keys).applyInPandas(fn, schema)


def group_transform(df: DataFrame, key: str, exprs: dict[str, Callable[[Window], Column]]) -> DataFrame:
    """L2: same-length per-group transforms as named Column expressions over ``Window.partitionBy(key)``
    (``{"y_demeaned": lambda w: F.col("y") - F.avg("y").over(w)}``): JVM-side, one shuffle for all of them."""
    w = Window.partitionBy(key)
    return df.withColumns({name: f(w) for name, f in exprs.items()})


FEATURES: dict[str, Callable[[DataFrame], Column]] = {
    "hour_index": lambda df: F.hour("ds"),
    "minute": lambda df: F.minute("ds"),
    "dayofweek": lambda df: F.dayofweek("ds"),
    "month": lambda df: F.month("ds"),
    "date": lambda df: F.to_date("ds"),
}


def register_feature(name: str, fn: Callable[[DataFrame], Column]) -> None:
    """L3: plug a feature function ``f(DataFrame) -> Column`` in by name (partials welcome)."""
    FEATURES[name] = fn


def add_features(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: FEATURES[n](df) for n in names})
