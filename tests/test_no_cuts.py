"""Extra years, products, segments and event types lose no row (nothing is filtered by a literal)."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from panelspark.operators import customer as cu
from panelspark.plans import QUERIES
from panelspark.sources import panels
from panelspark.sources.tables import SCHEMAS, read_table


@pytest.fixture(scope="module")
def wider(spark, tmp_path_factory):
    """The smallest tables with orders from 1980 to 2031, a seventh part type, a sixth segment and a sixth event type."""
    d = str(tmp_path_factory.mktemp("wider"))
    for name in ("orders", "lineitem", "part", "customer", "events"):
        df = read_table(spark, SF001, name)
        if name == "orders":
            shift = F.when(F.col("o_orderkey") % 50 == 0, F.expr("INTERVAL 30 YEAR")).when(
                F.col("o_orderkey") % 50 == 1, F.expr("INTERVAL -15 YEAR")).otherwise(F.expr("INTERVAL 0 YEAR"))
            df = df.withColumn("o_orderdate", (F.col("o_orderdate") + shift).cast("timestamp_ntz"))
        if name == "part":
            df = df.withColumn("p_type", F.when(F.col("p_partkey") % 9 == 0, "NOVELTY").otherwise(F.col("p_type")))
        if name == "customer":
            df = df.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "AEROSPACE").otherwise(F.col("c_mktsegment")))
        if name == "events":
            df = df.withColumn("event_type", F.when(F.col("event_id") % 11 == 0, "refund").otherwise(F.col("event_type")))
        df.select([f.name for f in SCHEMAS[name]]).write.parquet(f"{d}/{name}.parquet")
    return d


def test_customer_panel_keeps_every_order_and_line(spark, wider):
    p = cu.customer_panel(spark, wider)
    assert "NOVELTY" in cu.products_of(p) and len(cu.products_of(p)) == 7
    orders, li, part = (read_table(spark, wider, t) for t in ("orders", "lineitem", "part"))
    spent = orders.agg(F.sum("o_totalprice")).first()[0]
    used = li.join(orders, li.l_orderkey == orders.o_orderkey).join(part, li.l_partkey == part.p_partkey).agg(
        F.sum("l_quantity")).first()[0]
    row = p.agg(F.sum("TotalSpend").alias("s"), sum((F.sum(cu.usage_col(x)) for x in cu.products_of(p)), F.lit(0.0)).alias("u"),
                F.countDistinct("TimePeriod").alias("periods"), F.sum(F.col("CustomerType").isNull().cast("int")).alias("none")).first()
    assert row.s == pytest.approx(spent) and row.u == pytest.approx(used)
    assert row.periods == 1 + orders.agg(F.max(F.year("o_orderdate")) - F.min(F.year("o_orderdate"))).first()[0] > 45
    assert row.none == 0


def test_features_and_reports_hold_the_new_product(spark, wider):
    f = cu.customer_features(spark, wider, 2)
    assert "NOVELTY_UsageTrend" in f.columns and f.count() == read_table(spark, wider, "customer").count()
    heat = QUERIES["j16_shift_heat_table"](spark, wider)
    assert "NOVELTY" in heat.columns


def test_no_period_looks_ahead_in_assigned_products(spark, wider):
    h = cu.assigned_products(cu.customer_panel(spark, wider))
    for r in h.select("CustomerID", "TimePeriod", "AssignedProducts", *map(cu.usage_col, cu.products_of(h))).limit(200).collect():
        for product in cu.products_of(h):
            if r[cu.usage_col(product)] > 0:
                assert product in r["AssignedProducts"]
    first = h.where("TimePeriod = 0")
    sizes = sum((F.when(F.col(cu.usage_col(p)) > 0, 1).otherwise(0) for p in cu.products_of(h)), F.lit(0))
    assert first.where(F.size("AssignedProducts") != sizes).count() == 0


def test_monthly_orders_and_event_series_are_whole(spark, wider):
    m = panels.orders_monthly(spark, wider)
    total = read_table(spark, wider, "orders").agg(F.sum("o_totalprice")).first()[0]
    assert m.agg(F.sum("y")).first()[0] == pytest.approx(total)
    assert {r[0] for r in m.select("unique_id").distinct().collect()} >= {"AEROSPACE"}
    given = QUERIES["h13_forecast_from_given_coefficients"](spark, wider)
    assert "refund" in {r[0] for r in given.select("unique_id").distinct().collect()}
    n = read_table(spark, wider, "events").count()
    assert QUERIES["k1_online_lag_features"](spark, wider).count() == n == QUERIES["k3_online_portfolio"](spark, wider).count()


def test_hash_split_takes_any_key(spark):
    rows = [(k,) for k in (-9_000_000_000_000_000_000, -1, 0, 1, 3_470_000_000, 9_200_000_000_000_000_000)]
    u = spark.createDataFrame(rows, "CustomerID long").select(cu.hash_fraction("CustomerID").alias("u")).collect()
    assert all(0 <= r.u < 1 for r in u)
    share = spark.range(20_000).select(F.avg((cu.hash_fraction("id") < 0.8).cast("int"))).first()[0]
    assert abs(share - 0.8) < 0.01
