"""Readers for the stored tables.

Explicit schemas (no inference) so a scan never samples files, and so Catalyst can prune columns and push filters
into the Parquet reader.  ``read_table(..., columns=[...])`` selects right away; pruning would happen anyway, but the
narrow projection documents the contract.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

L, I, D, S, TS = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.TimestampNTZType()


def _schema(*fields):
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


SCHEMAS = {
    "region": _schema(("r_regionkey", I), ("r_name", S)),
    "nation": _schema(("n_nationkey", I), ("n_name", S), ("n_regionkey", I)),
    "customer": _schema(("c_custkey", L), ("c_name", S), ("c_nationkey", I), ("c_acctbal", D),
                        ("c_mktsegment", S)),
    "supplier": _schema(("s_suppkey", L), ("s_name", S), ("s_nationkey", I), ("s_acctbal", D)),
    "part": _schema(("p_partkey", L), ("p_name", S), ("p_brand", S), ("p_type", S), ("p_size", I),
                    ("p_retailprice", D)),
    "orders": _schema(("o_orderkey", L), ("o_custkey", L), ("o_orderstatus", S), ("o_totalprice", D),
                      ("o_orderdate", TS), ("o_orderpriority", S)),
    "lineitem": _schema(("l_orderkey", L), ("l_partkey", L), ("l_suppkey", L), ("l_linenumber", I),
                        ("l_quantity", D), ("l_extendedprice", D), ("l_discount", D), ("l_tax", D),
                        ("l_returnflag", S), ("l_linestatus", S), ("l_shipdate", TS)),
    "events": _schema(("event_id", L), ("ts", TS), ("user_id", L), ("event_type", S), ("value", D),
                      ("props", S)),
}


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    reader = spark.read
    if name in SCHEMAS:
        reader = reader.schema(SCHEMAS[name])
    df = reader.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def read_series_csv(spark: SparkSession, path: str, ds_format: str | None = None) -> DataFrame:
    """A1: a user CSV with the columns ``ds``, ``y`` and optionally ``unique_id``, found by their names in the header
    (any order, further columns are not read); without ``unique_id`` the series is called ``series``."""
    from pyspark.sql import functions as F

    raw = spark.read.option("header", True).csv(path)  # names from the header; all values are strings, nothing is inferred
    lacking = {"ds", "y"} - set(raw.columns)
    if lacking:
        raise ValueError(f"{path} has no column {', '.join(sorted(lacking))}; it has {raw.columns}")
    ts = F.to_timestamp_ntz(F.col("ds"), F.lit(ds_format)) if ds_format else F.col("ds").cast("timestamp_ntz")
    uid = F.col("unique_id") if "unique_id" in raw.columns else F.lit("series")
    return raw.select(uid.alias("unique_id"), ts.alias("ds"), F.col("y").cast("double").alias("y"))
