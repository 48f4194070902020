"""Physical-plan properties the scale design relies on (checked on the planned, not executed, plan)."""

import re

from conftest import SF001, SF01

import __spark_entry__ as E


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_has_one_scan_two_exchanges_and_a_narrow_read(spark):
    p = _plan(E.queries()["flagship_anomalies"](spark, SF01))
    assert p.count("FileScan parquet") == 1
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 2
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in p


def test_bar_scan_pushes_time_and_id_filters(spark):
    p = _plan(E.queries()["a2_load_bars"](spark, SF01))
    assert "PushedFilters:" in p
    pushed = p[p.index("PushedFilters:"):].split("]")[0]
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed and "In(event_" in pushed
    assert "Exchange" not in p  # a pure scan-filter-project: no shuffle


def test_orders_are_aggregated_before_the_customer_join(spark):
    p = _plan(E.queries()["f14_decompose_monthly_additive"](spark, SF01))
    join_at = p.find("Join")
    agg_below = p.find("partial_sum(o_totalprice", join_at)
    assert join_at >= 0 and agg_below > join_at  # the partial aggregate sits under (before) the join


def _scans(df, table: str) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count(f"/{table}.parquet]")


def test_workload_shifts_read_lineitem_once(spark):
    from panelspark.operators import customer as cu

    df = cu.workload_shifts(cu.customer_panel(spark, SF001))
    assert _scans(df, "lineitem") == 1


def test_frequency_gaps_are_taken_inside_days(spark):
    """No window over raw rows is partitioned by the series alone."""
    from panelspark.operators.explore import infer_frequency

    ev = spark.read.parquet(f"{SF001}/events.parquet").selectExpr("event_type as unique_id", "ts as ds", "value as y")
    plan = infer_frequency(ev)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "lag(__s" in line]
    assert windows and all("__day" in line for line in windows)


def test_reports_scan_their_source_at_most_once(spark):
    from panelspark.plans import QUERIES

    assert _scans(QUERIES["f11_auto_differences"](spark, SF001), "orders") <= 1
    assert _scans(QUERIES["f22_insight_report"](spark, SF001), "events") <= 1
    assert _scans(QUERIES["d13_describe"](spark, SF001), "lineitem") <= 1
