"""Every registered query equals its DuckDB twin at sf0.001 (the driver repeats this at sf0.01)."""

import math

import pandas as pd
import pytest

from conftest import SF001

import __spark_entry__ as E

SQL = E.oracle_sql()


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "∅"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, pd.Timestamp):
        return str(v.to_pydatetime())
    return str(v)


def _canon(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(_norm(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_duckdb(spark, duck, name):
    got = _canon(E.queries()[name](spark, SF001).toPandas())
    want = _canon(duck.execute(SQL[name]).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["unique_id", "ds", "y", "ma_anomaly", "decomp_anomaly", "zscore_anomaly", "anomaly_count"]
