"""DuckDB text for the oracle side: the derived panels as CTEs plus a few generators for repeated window SQL.

This is the *reference* answer for the correctness check, written independently of the DataFrame code.
"""

from __future__ import annotations

def _panel(name: str, raw_select: str, step: str | None, monthly: bool = False) -> str:
    raw, b = f"{name}__raw", f"{name}__b"
    if monthly:
        spine = (f"{name}__s AS (SELECT unique_id, CAST(last_day(m) AS TIMESTAMP) AS ds FROM "
                 f"(SELECT unique_id, UNNEST(generate_series(date_trunc('month', lo), date_trunc('month', hi), "
                 f"INTERVAL 1 MONTH)) AS m FROM {b}))")
    else:
        spine = (f"{name}__s AS (SELECT unique_id, UNNEST(generate_series(lo, hi, INTERVAL {step})) AS ds "
                 f"FROM {b})")
    return (f"{raw} AS ({raw_select}),\n"
            f"{b} AS (SELECT unique_id, min(ds) AS lo, max(ds) AS hi FROM {raw} GROUP BY unique_id),\n"
            f"{spine},\n"
            f"{name} AS (SELECT s.unique_id, CAST(s.ds AS TIMESTAMP) AS ds, COALESCE(r.y, 0.0) AS y FROM {name}__s s "
            f"LEFT JOIN {raw} r ON s.unique_id = r.unique_id AND s.ds = r.ds)")


PANEL_CTES = {
    "events_daily": _panel(
        "events_daily",
        "SELECT event_type AS unique_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ds, SUM(value) AS y "
        "FROM events GROUP BY 1, 2", "1 DAY"),
    "events_hourly": _panel(
        "events_hourly",
        "SELECT event_type AS unique_id, date_trunc('hour', ts) AS ds, SUM(value) AS y FROM events GROUP BY 1, 2",
        "1 HOUR"),
    "orders_monthly": _panel(
        "orders_monthly",
        "SELECT c_mktsegment AS unique_id, CAST(last_day(o_orderdate) AS TIMESTAMP) AS ds, SUM(o_totalprice) AS y "
        "FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2", None, monthly=True),
    "ship_daily": _panel(
        "ship_daily",
        "SELECT l_returnflag AS unique_id, CAST(CAST(l_shipdate AS DATE) AS TIMESTAMP) AS ds, SUM(l_quantity) AS y "
        "FROM lineitem GROUP BY 1, 2", "1 DAY"),
}


def with_ctes(*parts: str) -> str:
    """``with_ctes('events_daily', 'x AS (...)', body)``: panel names expand to their CTEs; the last part is the body."""
    *ctes, body = parts
    items = [PANEL_CTES.get(c, c) for c in ctes]
    return ("WITH " + ",\n".join(items) + "\n" + body) if items else body


def W(extra: str = "") -> str:
    return f"(PARTITION BY unique_id ORDER BY ds{(' ' + extra) if extra else ''})"


def decompose_ctes(src: str, period: int, model: str = "additive", out: str = "dec") -> list[str]:
    """CTEs computing trend/seasonal/resid of ``src`` (a panel CTE) into ``out``."""
    m, h = period, period // 2
    frame = W(f"ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING")
    if m % 2:
        trend = f"CASE WHEN count(y) OVER {frame} = {m} THEN avg(y) OVER {frame} END"
    else:
        trend = (f"CASE WHEN count(y) OVER {frame} = {m + 1} THEN (sum(y) OVER {frame} - 0.5 * "
                 f"(lag(y, {h}) OVER {W()} + lead(y, {h}) OVER {W()})) / {m} END")
    add = model == "additive"
    det = "y - trend" if add else "y / trend"
    c1 = (f"{out}__a AS (SELECT *, row_number() OVER {W()} - 1 AS pos, count(*) OVER (PARTITION BY unique_id) AS n, "
          f"{trend} AS trend0 FROM {src})")
    c2 = (f"{out}__b AS (SELECT * EXCLUDE (trend0), CASE WHEN n >= {2 * m} THEN trend0 END AS trend FROM {out}__a)")
    c3 = f"{out}__c AS (SELECT *, {det} AS det FROM {out}__b)"
    c4 = f"{out}__d AS (SELECT *, avg(det) OVER (PARTITION BY unique_id, pos % {m}) AS pm FROM {out}__c)"
    c5 = (f"{out}__e AS (SELECT *, avg(CASE WHEN pos < {m} THEN pm END) OVER (PARTITION BY unique_id) AS centre "
          f"FROM {out}__d)")
    seas = "pm - centre" if add else "pm / centre"
    c6 = f"{out}__f AS (SELECT *, CASE WHEN n >= {2 * m} THEN {seas} END AS seasonal FROM {out}__e)"
    res = "det - seasonal" if add else "det / seasonal"
    c7 = (f"{out} AS (SELECT * EXCLUDE (pos, n, det, pm, centre), {res} AS resid FROM {out}__f)")
    return [c1, c2, c3, c4, c5, c6, c7]
