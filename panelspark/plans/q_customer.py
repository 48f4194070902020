"""Customer-health queries (J1–J20) and the relational operators exercised on the customer tables (C5, C6, D2–D15,
E1, E4, B9, B11, B13)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelspark.functions.util import rnd, round_doubles, sql_select
from panelspark.operators import customer as cu
from panelspark.operators import relational as rel
from panelspark.plans.registry import register
from panelspark.plans.sql_customer import P, feature_ctes, health_ctes, panel_ctes, risk_case, sql

USAGE = [f"{p}_Usage" for p in P]
GROWTH = [f"{p}_Growth" for p in P]
FEATS = cu.feature_cols(P)
#: Columns above are the oracle texts'; the DataFrame side reads its own products from the panel (``cu.products_of``).
FEAT_DOUBLES = [c for c in FEATS if c not in ("ProductDiversity", "SignificantShift")]


# ---------------------------------------------------------------- panel, growth, status

@register("j_customer_panel", sql(*panel_ctes(), "SELECT CustomerID, TimePeriod, CompanyName, CompanySize, CustomerType, "
                                  "round(TotalSpend, 2) AS TotalSpend, " + ", ".join(USAGE) + " FROM cpanel"))
def j_customer_panel(spark, sf_dir):
    p = cu.customer_panel(spark, sf_dir)
    return round_doubles(p.select("CustomerID", "TimePeriod", "CompanyName", "CompanySize", "CustomerType",
                                  "TotalSpend", *[cu.usage_col(x) for x in cu.products_of(p)]), 6, {"TotalSpend": 2})


@register("j1_growth", sql(*health_ctes(1), "SELECT CustomerID, TimePeriod, "
                           + sql_select(GROWTH + ["TotalGrowth"], GROWTH + ["TotalGrowth"]) + " FROM health"))
def j1_growth(spark, sf_dir):
    h = cu.health_panel(spark, sf_dir, 1)
    return round_doubles(h.select("CustomerID", "TimePeriod", *[cu.growth_col(x) for x in cu.products_of(h)], "TotalGrowth"))


@register("j1_growth_assigned", sql(*health_ctes(2), "SELECT CustomerID, TimePeriod, round(TotalGrowth, 6) AS TotalGrowth, "
                                    "array_to_string(AssignedProducts, ',') AS AssignedProducts FROM health"))
def j1_growth_assigned(spark, sf_dir):
    h = cu.health_panel(spark, sf_dir, 2)
    return h.select("CustomerID", "TimePeriod", rnd("TotalGrowth", 6).alias("TotalGrowth"),
                    F.array_join("AssignedProducts", ",").alias("AssignedProducts"))


@register("j2_adoption", sql(*health_ctes(1), "SELECT CustomerID, TimePeriod, NewProductAdoption, "
                             "NewProductAdoption IS NOT NULL AS adopted FROM health"))
def j2_adoption(spark, sf_dir):
    h = cu.health_panel(spark, sf_dir, 1)
    return h.select("CustomerID", "TimePeriod", "NewProductAdoption",
                    F.col("NewProductAdoption").isNotNull().alias("adopted"))


for _v in (1, 2, 3):
    register(f"j3_status_v{_v}", sql(*health_ctes(_v), "SELECT CustomerID, TimePeriod, Status FROM health"))(
        (lambda v: lambda spark, sf_dir: cu.health_panel(spark, sf_dir, v).select("CustomerID", "TimePeriod", "Status"))(_v))


# ---------------------------------------------------------------- feature table and labels

_FOUT = ["CustomerID", *FEATS, "Status", "CustomerType", "CompanySize", "TotalSpend", *USAGE, "RedFlag"]
_FOUT_D = FEAT_DOUBLES + ["TotalSpend"] + USAGE



def _feature_table(f):
    products = cu.products_of(f)
    return round_doubles(f.select("CustomerID", *cu.feature_cols(products), "Status", "CustomerType", "CompanySize",
                                  "TotalSpend", *map(cu.usage_col, products), "RedFlag"), 6, {"TotalSpend": 2})


for _v in (1, 2):
    register(f"j4_features_v{_v}", sql(*feature_ctes(_v), f"SELECT {sql_select(_FOUT, _FOUT_D, 6, {'TotalSpend': 2})} FROM features"))(
        (lambda v: lambda spark, sf_dir: _feature_table(cu.customer_features(spark, sf_dir, v)))(_v))

for _lv, _fv in ((1, 1), (2, 2), (3, 3)):
    register(f"j5_label_v{_lv}", sql(*feature_ctes(_fv, _lv), "SELECT CustomerID, RedFlag FROM features"))(
        (lambda fv, lv: lambda spark, sf_dir: cu.customer_features(spark, sf_dir, fv, lv).select("CustomerID", "RedFlag"))(_fv, _lv))


# ---------------------------------------------------------------- J6–J7 split and scaling

def _hash(seed: int = 42) -> str:
    x = f"((((CustomerID % 2147483647) + 2147483647) % 2147483647) * 2654435761 + {seed * 40503 + 12345}) % 4294967296"
    y = f"(xor(CAST({x} AS BIGINT), CAST({x} AS BIGINT) >> 15) * 1103515245 + 12345) % 4294967296"
    return f"xor(CAST({y} AS BIGINT), CAST({y} AS BIGINT) >> 13) / 4294967296.0"


@register("j6_split", sql(*feature_ctes(3), f"SELECT CustomerID, RedFlag, {_hash()} < 0.8 AS is_train FROM features"))
def j6_split(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 3)
    return cu.split(f, "CustomerID", 0.8, 42).select("CustomerID", "RedFlag", "is_train")


@register("j6_split_stratified", sql(*feature_ctes(3), f"h AS (SELECT CustomerID, RedFlag, {_hash()} AS u FROM features)",
                                      "t AS (SELECT RedFlag, quantile_cont(u, 0.8) AS thr FROM h GROUP BY 1)",
                                      "SELECT h.CustomerID, h.RedFlag, h.u <= t.thr AS is_train FROM h JOIN t ON h.RedFlag = t.RedFlag"))
def j6_split_stratified(spark, sf_dir):
    """Stratified by the label: each class is split 80/20 (up to one row), as ``stratify=y`` does."""
    f = cu.customer_features(spark, sf_dir, 3)
    return cu.split(f, "CustomerID", 0.8, 42, stratify="RedFlag").select("CustomerID", "RedFlag", "is_train")


_SCALE = ["OverallGrowthTrend", "ProductDiversity", "ProductDiversityTrend"]


@register("j7_standard_scaling", sql(
    *feature_ctes(3), f"sp AS (SELECT *, {_hash()} < 0.8 AS is_train FROM features)",
    "st AS (SELECT " + ", ".join(f"avg({c}) FILTER (WHERE is_train) AS m_{c}, stddev_pop({c}) FILTER (WHERE is_train) AS s_{c}"
                                 for c in _SCALE) + " FROM sp)",
    "SELECT CustomerID, is_train, " + ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END, 6) AS {c}_scaled" for c in _SCALE)
    + " FROM sp, st"))
def j7_standard_scaling(spark, sf_dir):
    f = cu.split(cu.customer_features(spark, sf_dir, 3), "CustomerID", 0.8, 42)
    return round_doubles(rel.standard_scale(f, _SCALE, fit_filter=F.col("is_train"), suffix="_scaled")
                         .select("CustomerID", "is_train", *[c + "_scaled" for c in _SCALE]))


# ---------------------------------------------------------------- J9/J10 report of a strict rule vs the broad label

def _pred_vs_label(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1, 1)
    return f.select(F.col("RedFlag").alias("prediction"), (F.col("Status") == "Red Flag").cast("int").alias("label"))


_PL = "pl AS (SELECT RedFlag AS prediction, CAST(Status = 'Red Flag' AS INTEGER) AS label FROM features)"


@register("j10_confusion_matrix", sql(*feature_ctes(1, 1), _PL,
                                      "SELECT label, prediction, count(*) AS n FROM pl GROUP BY 1, 2"))
def j10_confusion_matrix(spark, sf_dir):
    return cu.confusion(_pred_vs_label(spark, sf_dir))


@register("j9_classification_report", sql(
    *feature_ctes(1, 1), _PL,
    "cm AS (SELECT label, prediction, count(*) AS n FROM pl GROUP BY 1, 2)",
    "cls AS (SELECT label AS cls FROM cm UNION SELECT prediction FROM cm)",
    "per AS (SELECT cls, COALESCE((SELECT sum(n) FROM cm WHERE label = cls AND prediction = cls), 0) AS tp, "
    "COALESCE((SELECT sum(n) FROM cm WHERE label = cls), 0) AS support, "
    "COALESCE((SELECT sum(n) FROM cm WHERE prediction = cls), 0) AS npred FROM cls)",
    "pr AS (SELECT CAST(cls AS VARCHAR) AS class, COALESCE(tp / NULLIF(CAST(npred AS DOUBLE), 0), 0.0) AS precision, "
    "COALESCE(tp / NULLIF(CAST(support AS DOUBLE), 0), 0.0) AS recall, CAST(support AS BIGINT) AS support, tp FROM per)",
    "pf AS (SELECT *, COALESCE(2 * precision * recall / NULLIF(precision + recall, 0), 0.0) AS f1 FROM pr)",
    "SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM pf "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf "
    "UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM pf "
    "UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), "
    "round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pf"))
def j9_classification_report(spark, sf_dir):
    return round_doubles(cu.classification_report(_pred_vs_label(spark, sf_dir)))


# ---------------------------------------------------------------- J13–J20 analyses

@register("j13_top_decliners", sql(
    *feature_ctes(1), "t AS (SELECT * FROM features ORDER BY OverallGrowthTrend ASC, CustomerID ASC LIMIT 10)",
    "SELECT CustomerID, CompanyName, CustomerType, printf('%.2f%%', round(OverallGrowthTrend * 100, 2)) AS overall_growth, "
    "CAST(ProductDiversity AS BIGINT) AS ProductDiversity, concat_ws('; ', "
    + ", ".join(f"printf('%s: %.0f (Growth: %.2f%%)', '{p}', round({p}_Usage, 0), round({p}_GrowthTrend * 100, 2))" for p in P)
    + ") AS product_detail FROM t"))
def j13_top_decliners(spark, sf_dir):
    return cu.top_decliners(cu.customer_features(spark, sf_dir, 1), 10)


@register("j13_top_red_flags", sql(
    *feature_ctes(1, 3), "t AS (SELECT * FROM features WHERE RedFlag = 1 ORDER BY OverallGrowthTrend ASC, CustomerID ASC LIMIT 5)",
    "SELECT CustomerID, CompanyName, CustomerType, printf('%.2f%%', round(OverallGrowthTrend * 100, 2)) AS overall_growth, "
    "CAST(ProductDiversity AS BIGINT) AS ProductDiversity, concat_ws('; ', "
    + ", ".join(f"printf('%s: %.0f (Growth: %.2f%%)', '{p}', round({p}_Usage, 0), round({p}_GrowthTrend * 100, 2))" for p in P)
    + ") AS product_detail FROM t"))
def j13_top_red_flags(spark, sf_dir):
    return cu.top_decliners(cu.customer_features(spark, sf_dir, 1, 3), 5, red_only=True)


@register("j14_churn_risk", sql(
    *feature_ctes(1), "lab AS (SELECT * FROM (VALUES (0, 'Very High'), (1, 'High'), (2, 'Medium'), (3, 'Low'), (4, 'Very Low')) v(ord, risk))",
    f"c AS (SELECT {risk_case()} AS risk, count(*) AS n FROM features GROUP BY 1)",
    "SELECT ord, lab.risk, CAST(COALESCE(n, 0) AS BIGINT) AS customers FROM lab LEFT JOIN c ON lab.risk = c.risk"))
def j14_churn_risk(spark, sf_dir):
    return cu.churn_risk_distribution(cu.customer_features(spark, sf_dir, 1))


@register("b9_risk_bins", sql(*feature_ctes(1), f"SELECT CustomerID, {risk_case()} AS risk FROM features"))
def b9_risk_bins(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1)
    return f.select("CustomerID", cu.churn_risk(f).alias("risk"))


_LONG = ("lu AS (SELECT CustomerID, TimePeriod, regexp_replace(Product, '_Usage$', '') AS Product, Usage FROM "
         "(UNPIVOT cpanel ON " + ", ".join(USAGE) + " INTO NAME Product VALUE Usage))")
_SHIFTS = ("sh AS (SELECT a.CustomerID, a.TimePeriod, a.Product, a.Usage - b.Usage AS UsageChange FROM lu a "
           "JOIN lu b ON a.CustomerID = b.CustomerID AND a.Product = b.Product AND a.TimePeriod = b.TimePeriod + 1 "
           "WHERE abs(a.Usage - b.Usage) > 100)")


@register("e1_unpivot_usage", sql(*panel_ctes(), _LONG, "SELECT * FROM lu"))
def e1_unpivot_usage(spark, sf_dir):
    return cu.long_usage(cu.customer_panel(spark, sf_dir))


@register("j15_workload_shifts", sql(*panel_ctes(), _LONG, _SHIFTS, "SELECT * FROM sh"))
def j15_workload_shifts(spark, sf_dir):
    return cu.workload_shifts(cu.customer_panel(spark, sf_dir))


@register("j16_shift_counts", sql(*panel_ctes(), _LONG, _SHIFTS, "SELECT Product, count(*) AS shifts FROM sh GROUP BY 1"))
def j16_shift_counts(spark, sf_dir):
    return rel.value_counts(cu.workload_shifts(cu.customer_panel(spark, sf_dir)), "Product", "shifts")


@register("j16_shift_heat_table", sql(*panel_ctes(), _LONG, _SHIFTS,
                                      "SELECT TimePeriod, " + ", ".join(f"count(*) FILTER (WHERE Product = '{p}') AS {p}" for p in P)
                                      + " FROM sh GROUP BY 1"))
def j16_shift_heat_table(spark, sf_dir):
    panel = cu.customer_panel(spark, sf_dir)
    sh = cu.workload_shifts(panel)
    return rel.pivot_counts(sh, "TimePeriod", "Product", cu.products_of(panel))


@register("d7_argmax_shift_product", sql(*panel_ctes(), _LONG, _SHIFTS,
                                         "SELECT Product, shifts FROM (SELECT Product, count(*) AS shifts FROM sh GROUP BY 1) "
                                         "ORDER BY shifts DESC, Product ASC LIMIT 1"))
def d7_argmax_shift_product(spark, sf_dir):
    return rel.argmax_count(cu.workload_shifts(cu.customer_panel(spark, sf_dir)), "Product", "shifts")


@register("j17_product_flow", sql(*panel_ctes(),
                                  "s AS (SELECT " + ", ".join(f"sum({p}_Usage) FILTER (WHERE TimePeriod = 0) AS s_{p}, "
                                                              f"sum({p}_Usage) FILTER (WHERE TimePeriod = (SELECT max(TimePeriod) FROM cpanel)) AS e_{p}"
                                                              for p in P) + " FROM cpanel)",
                                  " UNION ALL ".join([f"SELECT {i} AS ord, '{p} Start' AS label, s_{p} AS flow FROM s WHERE s_{p} > 0"
                                                      for i, p in enumerate(P)]
                                                     + [f"SELECT {len(P) + i}, '{p} End', -e_{p} FROM s" for i, p in enumerate(P)])))
def j17_product_flow(spark, sf_dir):
    return cu.product_flow(cu.customer_panel(spark, sf_dir))


@register("j18_avg_usage_by_period", sql(*panel_ctes(), "SELECT TimePeriod, " + ", ".join(f"round(avg({u}), 6) AS {u}" for u in USAGE)
                                         + " FROM cpanel GROUP BY 1"))
def j18_avg_usage_by_period(spark, sf_dir):
    p = cu.customer_panel(spark, sf_dir)
    return round_doubles(p.groupBy("TimePeriod").agg(*[F.avg(u).alias(u) for u in map(cu.usage_col, cu.products_of(p))]))


_UT = [f"{p}_UsageTrend" for p in P]


@register("j18_usage_trend_by_redflag", sql(
    *feature_ctes(1, 3), "a AS (SELECT RedFlag, " + ", ".join(f"avg({c}) AS {c}" for c in _UT) + " FROM features GROUP BY 1)",
    "SELECT RedFlag, Product, round(AverageUsage, 6) AS AverageUsage FROM (UNPIVOT a ON " + ", ".join(_UT)
    + " INTO NAME Product VALUE AverageUsage)"))
def j18_usage_trend_by_redflag(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1, 3)
    trends = [f"{x}_UsageTrend" for x in cu.products_of(f)]
    a = f.groupBy("RedFlag").agg(*[F.avg(c).alias(c) for c in trends])
    return round_doubles(a.unpivot(["RedFlag"], trends, "Product", "AverageUsage"))


@register("j19_health_overview", sql(*feature_ctes(1), "SELECT Status, count(*) AS customers FROM features GROUP BY 1"))
def j19_health_overview(spark, sf_dir):
    return rel.value_counts(cu.customer_features(spark, sf_dir, 1), "Status", "customers")


@register("j19_kpi_table", sql(
    *feature_ctes(1, 3),
    "SELECT count(*) AS total_customers, CAST(sum(RedFlag) AS BIGINT) AS red_flags, round(100.0 * sum(RedFlag) / count(*), 4) AS red_flag_pct, "
    "round(avg(ProductDiversity) FILTER (WHERE RedFlag = 1), 6) AS red_avg_diversity, "
    "round(100.0 * avg(SignificantShift) FILTER (WHERE RedFlag = 1), 4) AS red_shift_pct, "
    "CAST(sum(SignificantShift) AS BIGINT) AS shifted, round(100.0 * sum(SignificantShift) / count(*), 4) AS shifted_pct "
    "FROM features"))
def j19_kpi_table(spark, sf_dir):
    return rel.kpi_row(cu.customer_features(spark, sf_dir, 1, 3))


@register("j20_customer_usage_history", sql(
    *feature_ctes(1), _LONG.replace("FROM (UNPIVOT cpanel", "FROM (UNPIVOT cpanel"),
    "pick AS (SELECT min(CustomerID) AS cid FROM features WHERE SignificantShift = 1)",
    "SELECT TimePeriod, Product, Usage FROM lu WHERE CustomerID = (SELECT cid FROM pick)"))
def j20_customer_usage_history(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1)
    cid = f.filter(F.col("SignificantShift") == 1).agg(F.min("CustomerID")).scalar()
    p = cu.customer_panel(spark, sf_dir).filter(F.col("CustomerID") == cid)
    return cu.long_usage(p).select("TimePeriod", "Product", "Usage")


# ---------------------------------------------------------------- relational operators on the customer tables

@register("c5_previous_period_join", sql(*panel_ctes(),
                                         "SELECT a.CustomerID, a.TimePeriod, round(a.TotalSpend, 2) AS TotalSpend, "
                                         "round(b.TotalSpend, 2) AS prev_spend FROM cpanel a LEFT JOIN cpanel b "
                                         "ON a.CustomerID = b.CustomerID AND a.TimePeriod = b.TimePeriod + 1"))
def c5_previous_period_join(spark, sf_dir):
    p = cu.customer_panel(spark, sf_dir).select("CustomerID", "TimePeriod", "TotalSpend")
    j = rel.previous_period_join(p, "CustomerID", "TimePeriod", ["TotalSpend"])
    return round_doubles(j.withColumnRenamed("prev_TotalSpend", "prev_spend"), 2)


@register("c6_semi_join_red_flag_orders", sql(*feature_ctes(1, 3),
                                              "SELECT o_orderkey, o_custkey, round(o_totalprice, 2) AS o_totalprice FROM orders "
                                              "WHERE o_custkey IN (SELECT CustomerID FROM features WHERE RedFlag = 1)"))
def c6_semi_join_red_flag_orders(spark, sf_dir):
    from panelspark.sources.tables import read_table

    red = cu.customer_features(spark, sf_dir, 1, 3).filter(F.col("RedFlag") == 1).select(F.col("CustomerID").alias("o_custkey"))
    o = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return round_doubles(o.join(red, "o_custkey", "left_semi"), 2).select("o_orderkey", "o_custkey", "o_totalprice")


@register("d2_group_mean_broadcast", sql(*panel_ctes(), "SELECT CustomerID, TimePeriod, round(avg(TotalSpend) OVER (PARTITION BY CustomerID), 2) AS mean_spend FROM cpanel"))
def d2_group_mean_broadcast(spark, sf_dir):
    p = cu.customer_panel(spark, sf_dir)
    return p.select("CustomerID", "TimePeriod", rnd(F.avg("TotalSpend").over(Window.partitionBy("CustomerID")), 2).alias("mean_spend"))


_D3 = ["OverallGrowthTrend", "SpendTrend", "ProductDiversityTrend", "SignificantShift"]


@register("d3_red_flag_patterns", sql(*feature_ctes(1, 3), "SELECT CustomerType, " + ", ".join(f"round(avg({c}), 6) AS {c}" for c in _D3)
                                      + " FROM features WHERE RedFlag = 1 GROUP BY 1"))
def d3_red_flag_patterns(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1, 3).filter("RedFlag = 1")
    return round_doubles(f.groupBy("CustomerType").agg(*[F.avg(c).alias(c) for c in _D3]))


@register("d5_type_by_redflag_counts", sql(*feature_ctes(1, 3), "SELECT CustomerType, RedFlag, count(*) AS n FROM features GROUP BY 1, 2"))
def d5_type_by_redflag_counts(spark, sf_dir):
    return cu.customer_features(spark, sf_dir, 1, 3).groupBy("CustomerType", "RedFlag").agg(F.count("*").alias("n"))


@register("d5_size_by_redflag_counts", sql(*feature_ctes(1, 3), "SELECT CompanySize, RedFlag, count(*) AS n FROM features GROUP BY 1, 2"))
def d5_size_by_redflag_counts(spark, sf_dir):
    return cu.customer_features(spark, sf_dir, 1, 3).groupBy("CompanySize", "RedFlag").agg(F.count("*").alias("n"))


@register("d6_mode_type_per_status", sql(*feature_ctes(1),
                                         "c AS (SELECT Status, CustomerType, count(*) AS n FROM features GROUP BY 1, 2)",
                                         "SELECT Status, CustomerType AS mode_type FROM (SELECT *, row_number() OVER "
                                         "(PARTITION BY Status ORDER BY n DESC, CustomerType ASC) AS rn FROM c) WHERE rn = 1"))
def d6_mode_type_per_status(spark, sf_dir):
    return rel.mode_by(cu.customer_features(spark, sf_dir, 1), "Status", "CustomerType", "mode_type")


@register("d9_distinct_products", sql(*health_ctes(2), "SELECT CustomerID, count(DISTINCT p) AS distinct_products FROM "
                                      "(SELECT CustomerID, UNNEST(AssignedProducts) AS p FROM health) GROUP BY 1"))
def d9_distinct_products(spark, sf_dir):
    h = cu.health_panel(spark, sf_dir, 2)
    return rel.distinct_in_arrays(h, "CustomerID", "AssignedProducts", "distinct_products")


@register("d11_usage_correlation", sql(
    *feature_ctes(1, 3), "r AS (SELECT * FROM features WHERE RedFlag = 1)",
    " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(covar_pop({a}, {b}) / NULLIF(stddev_pop({a}) * stddev_pop({b}), 0), 6) AS corr FROM r HAVING count(*) > 0"
                       for a in USAGE for b in USAGE)))
def d11_usage_correlation(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1, 3).filter("RedFlag = 1")
    return round_doubles(rel.correlation_matrix(f, list(map(cu.usage_col, cu.products_of(f)))))


_D13 = ["OverallGrowthTrend", "ProductDiversityTrend", "TotalSpend"]


@register("d13_describe", sql(
    *feature_ctes(1),
    " UNION ALL ".join(
        f"SELECT '{c}' AS col, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
        f"round(quantile_cont({c}, 0.75), 6) AS q75, round(max({c}), 6) AS max FROM features" for c in _D13)))
def d13_describe(spark, sf_dir):
    from panelspark.session import cut_lineage

    # read by the moments and by each level of the percentiles: materialised once
    f = cut_lineage(cu.customer_features(spark, sf_dir, 1).select(*_D13))
    return round_doubles(rel.describe(f, _D13))


@register("d17_growth_density", sql(
    *feature_ctes(1, 3),
    "st AS (SELECT RedFlag, count(OverallGrowthTrend) AS n, min(OverallGrowthTrend) AS lo, max(OverallGrowthTrend) AS hi, "
    "stddev_samp(OverallGrowthTrend) * pow(count(OverallGrowthTrend), -0.2) AS bw FROM features GROUP BY 1)",
    "g AS (SELECT RedFlag, i, lo - 3 * bw + i * ((hi - lo) + 6 * bw) / 199 AS x, n, bw FROM st, range(200) t(i) WHERE bw > 0)",
    "SELECT g.RedFlag, CAST(i AS INTEGER) AS i, round(x, 6) AS x, round(sum(exp(-0.5 * pow((x - f.OverallGrowthTrend) / bw, 2))) "
    "/ (n * bw * sqrt(2 * pi())), 6) AS density FROM g JOIN features f ON f.RedFlag = g.RedFlag "
    "WHERE f.OverallGrowthTrend IS NOT NULL GROUP BY g.RedFlag, i, x, n, bw"))
def d17_growth_density(spark, sf_dir):
    f = cu.customer_features(spark, sf_dir, 1, 3)
    return round_doubles(rel.kde(f, "RedFlag", "OverallGrowthTrend", 200))
