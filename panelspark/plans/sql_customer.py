"""DuckDB text for the customer panel, growth/status rules and the feature table (oracle side)."""

from __future__ import annotations

#: The part types of the test tables, and the definitions of types and risk labels, stated here for the oracle alone.
P = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SEGMENTS = {"FURNITURE": "Stable", "AUTOMOBILE": "Stable", "BUILDING": "Growing", "MACHINERY": "Declining",
            "HOUSEHOLD": "Shifting"}
RISKS = [(-0.2, "Very High"), (-0.1, "High"), (0.0, "Medium"), (0.1, "Low"), (None, "Very Low")]
CW = "(PARTITION BY CustomerID ORDER BY TimePeriod)"


def panel_ctes() -> list[str]:
    usage = ", ".join(f"SUM(CASE WHEN p_type = '{p}' THEN l_quantity END) AS {p}_Usage" for p in P)
    seg = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENTS.items())
    per = "CAST(year(o_orderdate) - (SELECT min(year(o_orderdate)) FROM orders) AS INTEGER)"
    lo, third = "(SELECT min(c_acctbal) FROM customer)", "((SELECT max(c_acctbal) - min(c_acctbal) FROM customer) / 3.0)"
    return [
        f"cp_u AS (SELECT o_custkey AS CustomerID, {per} AS TimePeriod, {usage} FROM lineitem "
        f"JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)",
        f"cp_s AS (SELECT o_custkey AS CustomerID, {per} AS TimePeriod, SUM(o_totalprice) AS TotalSpend "
        f"FROM orders GROUP BY 1, 2)",
        "cp_n AS (SELECT CAST(max(year(o_orderdate)) - min(year(o_orderdate)) + 1 AS INTEGER) AS n FROM orders)",
        f"cp_sp AS (SELECT c_custkey AS CustomerID, c_name AS CompanyName, CASE WHEN c_acctbal < {lo} + {third} "
        f"THEN 'Small' WHEN c_acctbal < {lo} + 2.0 * {third} THEN 'Medium' ELSE 'Large' END AS CompanySize, "
        f"COALESCE(CASE c_mktsegment {seg} END, 'Stable') AS CustomerType, "
        f"CAST(UNNEST(range(0, (SELECT n FROM cp_n))) AS INTEGER) AS TimePeriod FROM customer)",
        "cpanel AS (SELECT sp.*, COALESCE(s.TotalSpend, 0.0) AS TotalSpend, "
        + ", ".join(f"COALESCE(u.{p}_Usage, 0.0) AS {p}_Usage" for p in P)
        + " FROM cp_sp sp LEFT JOIN cp_s s ON sp.CustomerID = s.CustomerID AND sp.TimePeriod = s.TimePeriod "
          "LEFT JOIN cp_u u ON sp.CustomerID = u.CustomerID AND sp.TimePeriod = u.TimePeriod)",
    ]


def health_ctes(variant: int = 1) -> list[str]:
    """``health``: panel + growth + adoption + status for a rule variant."""
    lags = ", ".join(f"lag({p}_Usage) OVER {CW} AS pv_{p}" for p in P)
    grows = ", ".join(f"COALESCE(CASE WHEN pv_{p} > 0 THEN ({p}_Usage - pv_{p}) / pv_{p} END, 0.0) AS {p}_Growth"
                      for p in P)
    total = " + ".join(f"{p}_Growth" for p in P)
    if variant == 2:
        ncur = " + ".join(f"CASE WHEN sum({p}_Usage) OVER {CW} > 0 THEN 1 ELSE 0 END" for p in P)
        assigned = "list_filter([" + ", ".join(
            f"CASE WHEN sum({p}_Usage) OVER {CW} > 0 THEN '{p}' END" for p in P) + "], lambda x: x IS NOT NULL)"
        c0 = f"h0 AS (SELECT *, {lags}, {ncur} AS ncur, {assigned} AS AssignedProducts FROM cpanel)"
        tg = f"CASE WHEN ncur > 0 THEN ({total}) / ncur ELSE 0.0 END"
    else:
        c0 = f"h0 AS (SELECT *, {lags} FROM cpanel)"
        tg = f"({total}) / {len(P)}"
    adopt = "COALESCE(" + ", ".join(f"CASE WHEN {p}_Usage > 0 AND pv_{p} = 0 THEN '{p}' END" for p in P) + ")"
    c1 = f"h1 AS (SELECT *, {grows} FROM h0)"
    c2 = (f"h2 AS (SELECT *, CASE WHEN TimePeriod = 0 THEN 0.0 ELSE {tg} END AS TotalGrowth, "
          f"CASE WHEN TimePeriod > 0 THEN {adopt} END AS NewProductAdoption FROM h1)")
    if variant == 3:
        shift = "(" + " OR ".join(f"abs({p}_Growth) > 0.3" for p in P) + ")"
    else:
        shift = "(abs(TotalGrowth) > 0.2)"
    adopt_b = "(NewProductAdoption IS NOT NULL)"
    red = f"CustomerType = 'Declining' AND TotalGrowth < -0.1 AND NOT {adopt_b}"
    if variant == 2:
        red += f" AND NOT {shift}"
    c3 = (f"health AS (SELECT * EXCLUDE ({', '.join('pv_' + p for p in P)}{', ncur' if variant == 2 else ''}), "
          f"CASE WHEN TimePeriod = 0 THEN 'New' WHEN {red} THEN 'Red Flag' "
          f"WHEN {adopt_b} OR (CustomerType = 'Shifting' AND {shift}) THEN 'Shifting' "
          f"WHEN TotalGrowth > 0.1 THEN 'Growing' WHEN TotalGrowth < -0.05 THEN 'Declining' ELSE 'Stable' END AS Status "
          f"FROM h2)")
    return panel_ctes() + [c0, c1, c2, c3]


def feature_ctes(variant: int = 1, label_variant: int | None = None) -> list[str]:
    """``features``: one row per customer (J4 + D8 + J5)."""
    lv = label_variant or variant
    if variant == 2:
        div = "len(AssignedProducts)"
    else:
        div = " + ".join(f"CASE WHEN {p}_Usage > 0 THEN 1 ELSE 0 END" for p in P)
    f0 = f"f0 AS (SELECT *, CAST({div} AS INTEGER) AS ProductDiversity FROM health)"
    pcs = ", ".join(f"({p}_Usage - lag({p}_Usage) OVER {CW}) / NULLIF(lag({p}_Usage) OVER {CW}, 0) AS pc_{p}" for p in P)
    f1 = (f"f1 AS (SELECT *, {pcs}, (TotalSpend - lag(TotalSpend) OVER {CW}) / NULLIF(lag(TotalSpend) OVER {CW}, 0) "
          f"AS pc_spend, ProductDiversity - lag(ProductDiversity) OVER {CW} AS ddiv FROM f0)")

    def trend(pc, base):
        if variant == 2:
            return f"CASE WHEN count(*) > 1 AND arg_min({base}, TimePeriod) > 0 THEN avg({pc}) ELSE 0.0 END"
        return f"avg({pc})"

    base_cols = ["CompanyName", "CompanySize", "CustomerType", "TimePeriod", "TotalSpend"] + [f"{p}_Usage" for p in P] \
        + [f"{p}_Growth" for p in P] + ["TotalGrowth", "NewProductAdoption", "Status", "ProductDiversity"]
    if variant == 2:
        base_cols.append("AssignedProducts")
    lasts = ", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN TimePeriod END) AS {c}" for c in base_cols)
    aggs = ", ".join([f"avg({p}_Growth) AS {p}_GrowthTrend" for p in P]
                     + [f"{trend('pc_' + p, p + '_Usage')} AS {p}_UsageTrend" for p in P]
                     + ["avg(TotalGrowth) AS OverallGrowthTrend", f"{trend('pc_spend', 'TotalSpend')} AS SpendTrend",
                        "avg(ddiv) AS ProductDiversityTrend"])
    f2 = f"f2 AS (SELECT CustomerID, {aggs}, {lasts} FROM f1 GROUP BY CustomerID)"
    f3 = ("f3 AS (SELECT *, COALESCE(CAST((abs(OverallGrowthTrend) > 0.2 OR ProductDiversityTrend > 0) AS INTEGER), 0) "
          "AS SignificantShift FROM f2)")
    red = "Status = 'Red Flag'"
    if lv == 1:
        red += " AND OverallGrowthTrend < -0.1 AND SignificantShift = 0"
    elif lv == 2:
        red += " AND SignificantShift = 0"
    f4 = f"features AS (SELECT *, CAST(COALESCE({red}, false) AS INTEGER) AS RedFlag FROM f3)"
    return health_ctes(variant) + [f0, f1, f2, f3, f4]


def risk_case(col: str = "OverallGrowthTrend") -> str:
    parts = [f"WHEN {col} <= {e} THEN '{lab}'" if e is not None else f"WHEN {col} IS NOT NULL THEN '{lab}'"
             for e, lab in RISKS]
    return "CASE " + " ".join(parts) + " END"


def sql(*parts: str) -> str:
    *ctes, body = parts
    return "WITH " + ",\n".join(ctes) + "\n" + body
