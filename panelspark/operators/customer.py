"""Customer health (J1–J20): a customer × period usage panel, growth and status rules, feature table, labels, KPIs.

The wide panel has one row per (customer, period) with ``{product}_Usage`` columns.  All per-customer logic runs on
``Window.partitionBy("CustomerID")`` or ``groupBy("CustomerID")`` — the same hash partitioning, so the feature table,
the status rules and the "last row per customer" reduction share one shuffle.  Usage is pre-aggregated (partial
aggregation) before that shuffle, so a customer holding a large share of the line items never reaches one task as raw
rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.functions.util import rnd
from panelspark.sources.tables import read_table

# ---- fixed values (must stay as they are for the derived panel to match FIXTURES.md §3)
SEGMENT_TYPE = {"FURNITURE": "Stable", "AUTOMOBILE": "Stable", "BUILDING": "Growing", "MACHINERY": "Declining",
                "HOUSEHOLD": "Shifting"}
DEFAULT_TYPE = "Stable"  # a segment that the mapping does not name
RISK_BINS = [(-0.2, "Very High"), (-0.1, "High"), (0.0, "Medium"), (0.1, "Low"), (None, "Very Low")]
STATUS_ORDER = ["New", "Red Flag", "Shifting", "Growing", "Declining", "Stable"]


def _cw() -> Window:
    return Window.partitionBy("CustomerID").orderBy("TimePeriod")


def usage_col(p: str) -> str:
    return f"{p}_Usage"


def growth_col(p: str) -> str:
    return f"{p}_Growth"


def products_of(df: DataFrame) -> list[str]:
    """The products of a wide panel or feature table, from its usage columns."""
    return [c[:-len("_Usage")] for c in df.columns if c.endswith("_Usage")]


# ---------------------------------------------------------------------------------------------------------------
# panel
# ---------------------------------------------------------------------------------------------------------------

def customer_panel(spark: SparkSession, sf_dir: str, products: list[str] | None = None) -> DataFrame:
    """Wide customer × period panel (unfilled growth columns): ids, type, size, ``TotalSpend``, ``{p}_Usage``.

    Nothing is cut: the periods run from the first to the last order year, the products are the distinct part types and
    the sizes are thirds of the balance range, all read from the tables (three small aggregates)."""
    li = read_table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_quantity"])
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    cust = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    if products is None:
        products = [r[0] for r in part.select("p_type").dropna().distinct().orderBy("p_type").collect()]
    years = orders.agg(F.min(F.year("o_orderdate")).alias("lo"), F.max(F.year("o_orderdate")).alias("hi")).first()
    start_year, n_periods = (years["lo"], years["hi"] - years["lo"] + 1) if years["lo"] is not None else (0, 1)
    bal = cust.agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")).first()
    third = ((bal["hi"] or 0.0) - (bal["lo"] or 0.0)) / 3.0
    cuts = ((bal["lo"] or 0.0) + third, (bal["lo"] or 0.0) + 2.0 * third)
    period = (F.year("o_orderdate") - start_year).alias("TimePeriod")
    o = orders.select(F.col("o_orderkey"), F.col("o_custkey").alias("CustomerID"), period, "o_totalprice")
    # one partial/final aggregate with a conditional sum per product (a pivot would add a second aggregate and
    # exchange); partial aggregation also folds a very active customer's rows map-side before the shuffle
    usage = (li.join(o, li.l_orderkey == o.o_orderkey).join(part, li.l_partkey == part.p_partkey)
               .groupBy("CustomerID", "TimePeriod")
               .agg(*[F.sum(F.when(F.col("p_type") == p, F.col("l_quantity"))).alias(usage_col(p)) for p in products]))
    spend = o.groupBy("CustomerID", "TimePeriod").agg(F.sum("o_totalprice").alias("TotalSpend"))
    kinds = F.create_map(*[F.lit(x) for kv in SEGMENT_TYPE.items() for x in kv])
    ctype = F.coalesce(F.try_element_at(kinds, F.col("c_mktsegment")), F.lit(DEFAULT_TYPE))
    size = F.when(F.col("c_acctbal") < cuts[0], "Small").when(F.col("c_acctbal") < cuts[1], "Medium").otherwise("Large")
    spine = cust.select(F.col("c_custkey").alias("CustomerID"), F.col("c_name").alias("CompanyName"),
                        size.alias("CompanySize"), ctype.alias("CustomerType"),
                        F.explode(F.sequence(F.lit(0), F.lit(n_periods - 1))).alias("TimePeriod"))
    panel = (spine.join(spend, ["CustomerID", "TimePeriod"], "left")
                  .join(usage, ["CustomerID", "TimePeriod"], "left"))
    fills = {"TotalSpend": F.coalesce("TotalSpend", F.lit(0.0))}
    fills.update({usage_col(p): F.coalesce(usage_col(p), F.lit(0.0)) for p in products})
    return panel.withColumns(fills)


def assigned_products(panel: DataFrame, products=None) -> DataFrame:
    """``AssignedProducts``: products the customer has used up to and including the period, in product order
    (array<string>); the set only grows, and no later period is looked at."""
    so_far = _cw().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    arr = F.filter(F.array(*[F.when(F.sum(usage_col(p)).over(so_far) > 0, F.lit(p))
                             for p in products or products_of(panel)]), lambda x: x.isNotNull())
    return panel.withColumn("AssignedProducts", arr)


# ---------------------------------------------------------------------------------------------------------------
# J1–J3 growth, adoption, status
# ---------------------------------------------------------------------------------------------------------------

def add_growth(panel: DataFrame, products=None, variant: int = 1) -> DataFrame:
    """``{p}_Growth`` (0 at the first period or on a zero base), ``TotalGrowth``, ``NewProductAdoption``.

    The spine is complete, so ``lag`` is the previous-period row (C5).  Variant 2 averages growth over the
    customer's assigned products only and names the adopted product.
    """
    w, products = _cw(), products or products_of(panel)
    prev = {p: F.lag(usage_col(p), 1).over(w) for p in products}
    d = panel.withColumns({f"__prev_{p}": prev[p] for p in products})
    g = {growth_col(p): F.coalesce(F.try_divide(F.col(usage_col(p)) - F.col(f"__prev_{p}"),
                                                F.when(F.col(f"__prev_{p}") > 0, F.col(f"__prev_{p}"))), F.lit(0.0))
         for p in products}
    d = d.withColumns(g)
    total = reduce(lambda a, b: a + b, [F.col(growth_col(p)) for p in products])
    if variant == 2:
        if "AssignedProducts" not in d.columns:
            d = assigned_products(d, products)
        n_cur = F.size("AssignedProducts")
        tg = F.when(n_cur > 0, total / n_cur).otherwise(F.lit(0.0))
    else:
        tg = total / len(products)
    adopted = [F.when((F.col(usage_col(p)) > 0) & (F.col(f"__prev_{p}") == 0), F.lit(p)) for p in products]
    first = F.col("TimePeriod") == 0
    d = d.withColumns({"TotalGrowth": F.when(first, F.lit(0.0)).otherwise(tg),
                       "NewProductAdoption": F.when(~first, F.coalesce(*adopted))})
    return d.drop(*[f"__prev_{p}" for p in products])


def significant_shift(variant: int, products) -> Column:
    if variant == 3:
        return reduce(lambda a, b: a | b, [F.abs(F.col(growth_col(p))) > 0.3 for p in products])
    return F.abs(F.col("TotalGrowth")) > 0.2


def add_status(d: DataFrame, variant: int = 1, products=None) -> DataFrame:
    """Ordered rule chain → ``Status``.  Variants differ in the shift test and the red-flag test."""
    adopt = F.col("NewProductAdoption").isNotNull()
    shift = significant_shift(variant, products or products_of(d))
    red = (F.col("CustomerType") == "Declining") & (F.col("TotalGrowth") < -0.1) & ~adopt
    if variant == 2:
        red = red & ~shift
    status = (F.when(F.col("TimePeriod") == 0, "New")
               .when(red, "Red Flag")
               .when(adopt | ((F.col("CustomerType") == "Shifting") & shift), "Shifting")
               .when(F.col("TotalGrowth") > 0.1, "Growing")
               .when(F.col("TotalGrowth") < -0.05, "Declining")
               .otherwise("Stable"))
    return d.withColumn("Status", status)


def health_panel(spark: SparkSession, sf_dir: str, variant: int = 1, products=None) -> DataFrame:
    """Panel + growth + status (the reference's generated table, rebuilt from stored rows)."""
    p = customer_panel(spark, sf_dir, products)
    if variant == 2:
        p = assigned_products(p, products)
    return add_status(add_growth(p, products, variant), variant, products)


# ---------------------------------------------------------------------------------------------------------------
# J4–J5 feature table and labels
# ---------------------------------------------------------------------------------------------------------------

def _pct(col: str) -> Column:
    prev = F.lag(col, 1).over(_cw())
    return F.try_divide(F.col(col) - prev, F.when(prev != 0, prev))


def _last(col: str) -> Column:
    """Latest non-null value of ``col`` per group."""
    return F.max_by(F.col(col), F.when(F.col(col).isNotNull(), F.col("TimePeriod")))


def feature_cols(products) -> list[str]:
    return ([f"{p}_GrowthTrend" for p in products] + [f"{p}_UsageTrend" for p in products]
            + ["OverallGrowthTrend", "SpendTrend", "ProductDiversity", "ProductDiversityTrend", "SignificantShift"])


def engineer_features(health: DataFrame, variant: int = 1, products=None) -> DataFrame:
    """J4 + D8: one row per customer — trends (group means), diversity and its trend, shift flag, and the latest
    non-null value of every panel column.  Variant 2 guards percentage changes (0 unless >1 row and first value > 0)
    and measures diversity as the number of assigned products."""
    w, products = _cw(), products or products_of(health)
    if variant == 2:
        div = F.size("AssignedProducts")
    else:
        div = reduce(lambda a, b: a + b, [(F.col(usage_col(p)) > 0).cast("int") for p in products])
    d = health.withColumn("ProductDiversity", div)
    d = d.withColumns({**{f"__pc_{p}": _pct(usage_col(p)) for p in products},
                       "__pc_spend": _pct("TotalSpend"),
                       "__ddiv": F.col("ProductDiversity") - F.lag("ProductDiversity", 1).over(w)})
    pass_cols = [c for c in health.columns if c not in ("CustomerID",)] + ["ProductDiversity"]

    def trend(pc: str, base: str) -> Column:
        m = F.avg(pc)
        if variant == 2:
            return F.when((F.count("*") > 1) & (F.min_by(base, "TimePeriod") > 0), m).otherwise(F.lit(0.0))
        return m

    aggs = [F.avg(growth_col(p)).alias(f"{p}_GrowthTrend") for p in products]
    aggs += [trend(f"__pc_{p}", usage_col(p)).alias(f"{p}_UsageTrend") for p in products]
    aggs += [F.avg("TotalGrowth").alias("OverallGrowthTrend"), trend("__pc_spend", "TotalSpend").alias("SpendTrend"),
             F.avg("__ddiv").alias("ProductDiversityTrend")]
    aggs += [_last(c).alias(c) for c in pass_cols]
    f = d.groupBy("CustomerID").agg(*aggs)
    shift = ((F.abs(F.col("OverallGrowthTrend")) > 0.2) | (F.col("ProductDiversityTrend") > 0)).cast("int")
    return f.withColumn("SignificantShift", F.coalesce(shift, F.lit(0)))


def add_label(features: DataFrame, variant: int = 1) -> DataFrame:
    """``RedFlag`` 0/1 — v1 red ∧ overall < −0.1 ∧ no shift; v2 red ∧ no shift; v3 red."""
    red = F.col("Status") == "Red Flag"
    if variant == 1:
        red = red & (F.col("OverallGrowthTrend") < -0.1) & (F.col("SignificantShift") == 0)
    elif variant == 2:
        red = red & (F.col("SignificantShift") == 0)
    return features.withColumn("RedFlag", F.coalesce(red, F.lit(False)).cast("int"))


def customer_features(spark: SparkSession, sf_dir: str, variant: int = 1, label_variant: int | None = None,
                      products=None) -> DataFrame:
    h = health_panel(spark, sf_dir, variant, products)
    return add_label(engineer_features(h, variant, products), label_variant or variant)


# ---------------------------------------------------------------------------------------------------------------
# J6–J7 split and scaling
# ---------------------------------------------------------------------------------------------------------------

def hash_fraction(col: str, seed: int = 42) -> Column:
    """Deterministic uniform number in [0,1) from any integer key, in engine-independent integer arithmetic: the key is
    reduced first (no overflow, negative keys too), then two multiply-and-shift rounds mix all its bits."""
    x = F.pmod(F.col(col).cast("bigint"), F.lit(2147483647).cast("bigint"))
    x = (x * F.lit(2654435761) + F.lit(seed * 40503 + 12345)) % F.lit(4294967296)
    x = (x.bitwiseXOR(F.shiftright(x, 15)) * F.lit(1103515245).cast("bigint") + F.lit(12345)) % F.lit(4294967296)
    x = x.bitwiseXOR(F.shiftright(x, 13))
    return x.cast("double") / F.lit(4294967296.0)


def split(df: DataFrame, key: str = "CustomerID", train_frac: float = 0.8, seed: int = 42,
          stratify: str | None = None) -> DataFrame:
    """Seeded, repeatable train/test flag by key hash (``is_train``; 80/20 in expectation, no sort).

    ``stratify``: exact per-class proportions — a row is train when its hash is below its class's ``train_frac``
    quantile of hashes, taken by the distributed exact percentile (a class never sits in one task)."""
    u = hash_fraction(key, seed)
    if stratify is None:
        return df.withColumn("is_train", u < train_frac)
    from panelspark.operators.relational import exact_percentiles

    d = df.withColumn("__u", u)
    thr = exact_percentiles(d, [stratify], "__u", [train_frac], ["__thr"])
    # one row per class, so no row is dealt by its class: a shuffle would put a whole class into one task
    return d.join(F.broadcast(thr), stratify, "left").withColumn("is_train", F.col("__u") <= F.col("__thr")).drop("__u", "__thr")


# J7 (standard scaling fitted on train rows only) is ``relational.standard_scale(df, cols, fit_filter=...)``.


# ---------------------------------------------------------------------------------------------------------------
# J9–J10 classification report and confusion matrix
# ---------------------------------------------------------------------------------------------------------------

def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).cast("int").alias("label"), F.col(pred).cast("int").alias("prediction")) \
             .agg(F.count("*").alias("n"))


def classification_report(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """Per class precision, recall, f1, support plus accuracy, macro and weighted averages (long table)."""
    c = confusion(df, label, pred)
    classes = c.select(F.col("label").alias("cls")).union(c.select(F.col("prediction").alias("cls"))).distinct()
    tp = c.filter(F.col("label") == F.col("prediction")).groupBy("label").agg(F.sum("n").alias("tp"))
    sup = c.groupBy("label").agg(F.sum("n").alias("support"))
    npred = c.groupBy("prediction").agg(F.sum("n").alias("npred"))
    per = (classes.join(tp, classes.cls == tp.label, "left").drop("label")
                  .join(sup, classes.cls == sup.label, "left").drop("label")
                  .join(npred, classes.cls == npred.prediction, "left").drop("prediction")
                  .na.fill(0, ["tp", "support", "npred"]))
    per = per.select(F.col("cls").cast("string").alias("class"),
                     F.coalesce(F.try_divide(F.col("tp"), F.col("npred").cast("double")), F.lit(0.0)).alias("precision"),
                     F.coalesce(F.try_divide(F.col("tp"), F.col("support").cast("double")), F.lit(0.0)).alias("recall"),
                     F.col("support").cast("bigint").alias("support"), F.col("tp"))
    per = per.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                       F.col("precision") + F.col("recall")), F.lit(0.0)))
    tot = per.agg(F.sum("tp").alias("tp"), F.sum("support").alias("n"), F.avg("precision").alias("mp"),
                  F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
                  F.try_divide(F.sum(F.col("precision") * F.col("support")), F.sum("support")).alias("wp"),
                  F.try_divide(F.sum(F.col("recall") * F.col("support")), F.sum("support")).alias("wr"),
                  F.try_divide(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("wf"))
    acc = tot.select(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                     F.lit(None).cast("double").alias("recall"),
                     F.try_divide(F.col("tp"), F.col("n").cast("double")).alias("f1"),
                     F.col("n").cast("bigint").alias("support"))
    macro = tot.select(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"), F.col("mr").alias("recall"),
                       F.col("mf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    weighted = tot.select(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                          F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").cast("bigint").alias("support"))
    return per.drop("tp").select("class", "precision", "recall", "f1", "support") \
              .unionByName(acc).unionByName(macro).unionByName(weighted)


# ---------------------------------------------------------------------------------------------------------------
# J13–J20 analyses
# ---------------------------------------------------------------------------------------------------------------

def top_decliners(features: DataFrame, n: int = 10, products=None, red_only: bool = False) -> DataFrame:
    """The n customers with the lowest overall growth trend (id breaks ties), with formatted product detail."""
    f = features.filter(F.col("RedFlag") == 1) if red_only else features
    top = f.orderBy(F.col("OverallGrowthTrend").asc(), F.col("CustomerID").asc()).limit(n)
    # values are rounded half-up before printing so the text does not depend on a formatter's tie rule
    detail = F.concat_ws("; ", *[F.format_string("%s: %.0f (Growth: %.2f%%)", F.lit(p), rnd(F.col(usage_col(p)), 0),
                                                 rnd(F.col(f"{p}_GrowthTrend") * 100, 2))
                                 for p in products or products_of(features)])
    return top.select("CustomerID", "CompanyName", "CustomerType",
                      F.format_string("%.2f%%", rnd(F.col("OverallGrowthTrend") * 100, 2)).alias("overall_growth"),
                      F.col("ProductDiversity").cast("bigint").alias("ProductDiversity"),
                      detail.alias("product_detail"))


def churn_risk(features: DataFrame, col: str = "OverallGrowthTrend") -> Column:
    """Right-closed bins (-inf,-.2] (-.2,-.1] (-.1,0] (0,.1] (.1,inf) → ordered labels."""
    expr = None
    for edge, label in RISK_BINS:
        cond = F.col(col) <= edge if edge is not None else F.col(col).isNotNull()
        expr = F.when(cond, label) if expr is None else expr.when(cond, label)
    return expr


def churn_risk_distribution(features: DataFrame) -> DataFrame:
    """J14 = B9 + D15: counts per risk label, zero-count labels kept, label order kept (``ord``)."""
    spark = features.sparkSession
    labels = spark.createDataFrame([(i, lab) for i, (_, lab) in enumerate(RISK_BINS)], "ord int, risk string")
    counts = features.select(churn_risk(features).alias("risk")).groupBy("risk").agg(F.count("*").alias("n"))
    return (F.broadcast(labels).join(counts, "risk", "left")  # 5-row label dimension
            .select("ord", "risk", F.coalesce("n", F.lit(0)).cast("bigint").alias("customers")))


def long_usage(panel: DataFrame, products=None, ids=("CustomerID", "TimePeriod")) -> DataFrame:
    """E1 + B11: wide usage columns → ``(ids…, Product, Usage)`` with the ``_Usage`` suffix stripped."""
    long = panel.unpivot(list(ids), [usage_col(p) for p in products or products_of(panel)], "Product", "Usage")
    return long.withColumn("Product", F.regexp_replace("Product", "_Usage$", ""))


def workload_shifts(panel: DataFrame, threshold: float = 100.0, products=None) -> DataFrame:
    """|usage − usage at period−1| > threshold, one row per (customer, period, product).  The change is a ``lag`` on
    the wide panel (a period that is not the next one gives no change), so the panel is read once and not joined."""
    w, products = _cw(), products or products_of(panel)
    follows = F.lag("TimePeriod", 1).over(w) == F.col("TimePeriod") - 1
    d = panel.select("CustomerID", "TimePeriod", *[
        F.when(follows, F.col(usage_col(p)) - F.lag(usage_col(p), 1).over(w)).alias(usage_col(p)) for p in products])
    return (long_usage(d, products).withColumnRenamed("Usage", "UsageChange")
            .filter(F.abs("UsageChange") > threshold))


def product_flow(panel: DataFrame, products=None) -> DataFrame:
    """Total usage at the first period (>0 only) as inflow, at the last period as negative outflow."""
    products = products or products_of(panel)
    sums = panel.agg(*[F.sum(F.when(F.col("TimePeriod") == 0, F.col(usage_col(p)))).alias(f"s_{p}") for p in products])
    # end totals at the last period present: equi-join on a one-row aggregate (size is 1 by construction)
    maxp = panel.groupBy().agg(F.max("TimePeriod").alias("__maxp"))
    end = (panel.join(F.broadcast(maxp), F.col("TimePeriod") == F.col("__maxp"))
                .agg(*[F.sum(usage_col(p)).alias(f"e_{p}") for p in products]))
    starts = sums.select(F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(f"{p} Start").alias("label"),
                                                      F.col(f"s_{p}").alias("flow")) for i, p in enumerate(products)]))
                         .alias("r")).select("r.*").filter(F.col("flow") > 0)
    ends = end.select(F.explode(F.array(*[F.struct(F.lit(len(products) + i).alias("ord"), F.lit(f"{p} End").alias("label"),
                                                   (-F.col(f"e_{p}")).alias("flow")) for i, p in enumerate(products)]))
                      .alias("r")).select("r.*")
    return starts.unionByName(ends)
