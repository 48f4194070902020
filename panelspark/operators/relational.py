"""Relational operators (B, C, D, E families) written as plain DataFrame plans.

Aggregates are single ``agg`` calls so Spark can combine partially before any shuffle; joins are equi-joins (size-based
strategy left to Catalyst/AQE); scalar statistics used as parameters of a row-wise expression are scalar subqueries
(``DataFrame.scalar()``) — no driver round-trip and no cross join.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.functions.util import rnd


# ---------------------------------------------------------------- C: joins

def previous_period_join(df: DataFrame, key: str, period: str, cols, prefix: str = "prev_") -> DataFrame:
    """Attach the same entity's row at exactly ``period-1`` (a gap means no match, unlike ``lag``)."""
    prev = df.select(key, (F.col(period) + 1).alias(period), *[F.col(c).alias(prefix + c) for c in cols])
    return df.join(prev, [key, period], "left")


def merge_models(tables, keys=("unique_id", "ds"), how: str = "full") -> DataFrame:
    """Fold many model tables on the same keys (a using-join coalesces the keys of an outer join)."""
    return reduce(lambda a, b: a.join(b, list(keys), how), tables)


def stack(tables) -> DataFrame:
    """Stack tables by name; a column missing on one side becomes null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


# ---------------------------------------------------------------- D: aggregates

def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """Counts per value (descending order is a presentation choice: ``orderBy`` at the end)."""
    return df.groupBy(col).agg(F.count("*").alias(name)).orderBy(F.desc(name), F.asc(col))


def pivot_counts(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Pivot table of counts (explicit pivot values → no extra job to discover them); empty cells are 0."""
    p = df.groupBy(row).pivot(col, list(values)).count()
    return p.select(row, *[F.coalesce(F.col(v), F.lit(0)).cast("bigint").alias(v) for v in values])


def argmax_count(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """The value with the most rows (ties → smallest value)."""
    c = df.groupBy(col).agg(F.count("*").alias(name))
    return c.orderBy(F.desc(name), F.asc(col)).limit(1)


def mode_by(df: DataFrame, group: str, col: str, name: str = "mode") -> DataFrame:
    """Mode of ``col`` per group; ties → smallest value (min over (−count, value))."""
    c = df.groupBy(group, col).agg(F.count("*").alias("__n"))
    return c.groupBy(group).agg(F.min_by(F.col(col), F.struct(-F.col("__n"), F.col(col))).alias(name))


def group_sizes(df: DataFrame, key: str = "unique_id") -> DataFrame:
    """Size of every group and the smallest size (scalar subquery, one extra aggregate)."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n"))
    return sizes.withColumn("min_n", sizes.agg(F.min("n")).scalar())


def distinct_in_arrays(df: DataFrame, key: str, arr: str, name: str) -> DataFrame:
    """Number of distinct elements over a group's array column (explode + distinct count: no per-group list)."""
    return df.select(key, F.explode(arr).alias("__e")).groupBy(key).agg(F.countDistinct("__e").alias(name))


def correlation_matrix(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation of every ordered column pair in one aggregate, long form; empty input → no rows."""
    pairs = [(a, b) for a in cols for b in cols]
    # covariance over σ·σ with try_divide: a constant column gives null (ANSI ``corr`` would raise)
    agg = df.agg(F.count("*").alias("__n"),
                 *[F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"__c{i}")
                   for i, (a, b) in enumerate(pairs)])
    arr = F.array(*[F.struct(F.lit(a).alias("col_a"), F.lit(b).alias("col_b"), F.col(f"__c{i}").alias("corr"))
                    for i, (a, b) in enumerate(pairs)])
    return agg.filter(F.col("__n") > 0).select(F.explode(arr).alias("r")).select("r.*")


def describe(df: DataFrame, cols) -> DataFrame:
    """Count, mean, sample std, min, exact interpolated quartiles, max per column (long).  Moments are one
    partial/final aggregate; the quartiles come from ``exact_percentiles`` on the unpivoted values (distributed
    ranks, no single-task buffer)."""
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.min(c).cast("double").alias(f"lo{i}"), F.max(c).cast("double").alias(f"hi{i}")]
    a = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"n{i}").alias("count"), F.col(f"m{i}").alias("mean"),
                              F.col(f"s{i}").alias("std"), F.col(f"lo{i}").alias("min"),
                              F.col(f"hi{i}").alias("max")) for i, c in enumerate(cols)])
    mom = a.select(F.explode(rows).alias("r")).select("r.*")
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v"))
                                         for c in cols])).alias("r")).select("r.*")
    q = exact_percentiles(long, ["col"], "v", [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    return mom.join(q, "col", "left").select("col", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


#: Relative rank error 1/SKETCH of the sketch that brackets wanted ranks; a key with fewer rows is ranked whole.
SKETCH = 10_000


def exact_percentiles(df: DataFrame, keys, col: str, probs, names=None, sketch: int = SKETCH) -> DataFrame:
    """Exact interpolated percentiles (rank ``h = p·(n−1)``, linear between neighbours — DuckDB
    ``quantile_cont``) per key, without holding a group in one task.

    A mergeable sketch (``percentile_approx``, rank error n / ``sketch``) brackets each wanted rank by two values 3n /
    ``sketch`` ranks before and after it.  One more pass counts the rows by value inside the brackets and by gap outside
    them, so about 6n / ``sketch`` values a rank are left, whatever the values' distribution; prefix sums over these counts give
    the exact ranks.  The input is read twice.  The sketch only chooses where to look: counts are exact, and a rank that its
    bracket does not hold (against the sketch's guarantee) is an error and no wrong answer.  NaN sorts last."""
    keys = list(keys)
    names = names or [f"p{int(round(p * 100)):02d}" if abs(p * 100 - round(p * 100)) < 1e-9 else f"p{p}" for p in probs]
    d = df.select(*keys, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    wide = 3.0 / sketch
    marks = [float(min(max(p + side * wide, 0.0), 1.0)) for p in probs for side in (-1, 1)]
    cuts = d.groupBy(*keys).agg(F.count("*").alias("__n"),
                                F.percentile_approx("__v", F.array(*map(F.lit, marks)), F.lit(sketch)).alias("__cuts"))
    lowest, highest = F.lit(float("-inf")), F.lit(float("nan"))  # NaN is the greatest double
    brackets = [(lowest if p - wide <= 0 else F.col("__cuts")[2 * i], highest if p + wide >= 1 else F.col("__cuts")[2 * i + 1])
                for i, p in enumerate(probs)]
    v = F.col("__v")
    near = F.col("__n") <= sketch
    for lo, hi in brackets:
        near = near | ((v >= lo) & (v <= hi))
    # a row in a gap stands right after the last bracket that ends before it
    gap = F.greatest(lowest, *[F.when(v > hi, hi).otherwise(lowest) for _, hi in brackets])
    rows = d.join(cuts, keys).select(*keys, "__n", F.when(near, v).otherwise(gap).alias("__at"), (~near).alias("__gap"))
    counts = rows.groupBy(*keys, "__n", "__at", "__gap").agg(F.count("*").alias("__c"))
    upto = Window.partitionBy(*keys).orderBy("__at", "__gap").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("__upto", F.sum("__c").over(upto))

    def at(rank):
        held = (rank >= F.col("__upto") - F.col("__c")) & (rank < F.col("__upto"))
        value = F.when(F.col("__gap"), F.raise_error(F.lit("a rank outside its bracket")).cast("double")).otherwise(F.col("__at"))
        return F.max(F.when(held, value))

    found = []
    for i, p in enumerate(probs):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        found += [at(F.floor(h)).alias(f"__a{i}"), at(F.ceil(h)).alias(f"__z{i}")]
    ends = ranked.groupBy(*keys, "__n").agg(*found)

    def between(i, p):
        h = F.lit(float(p)) * (F.col("__n") - 1)
        a, z = F.col(f"__a{i}"), F.col(f"__z{i}")
        return F.when(a == z, a).otherwise(a + (h - F.floor(h)) * (z - a))

    return ends.select(*keys, *[between(i, p).alias(name) for i, (p, name) in enumerate(zip(probs, names))])


def kpi_row(f: DataFrame) -> DataFrame:
    """One row of totals, shares, filtered means and rates over the customer feature table."""
    red = F.col("RedFlag") == 1
    return f.agg(F.count("*").alias("total_customers"), F.sum("RedFlag").cast("bigint").alias("red_flags"),
                 rnd(100.0 * F.sum("RedFlag") / F.count("*"), 4).alias("red_flag_pct"),
                 rnd(F.avg(F.when(red, F.col("ProductDiversity"))), 6).alias("red_avg_diversity"),
                 rnd(100.0 * F.avg(F.when(red, F.col("SignificantShift"))), 4).alias("red_shift_pct"),
                 F.sum("SignificantShift").cast("bigint").alias("shifted"),
                 rnd(100.0 * F.sum("SignificantShift") / F.count("*"), 4).alias("shifted_pct"))


def histogram(df: DataFrame, col: str, bins: int = 10, key: str | None = None) -> DataFrame:
    """Equal-width histogram between the (per-key) min and max, last bin closed, with density."""
    keys = [key] if key else []
    st = df.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"), F.count(col).alias("__n"))
    j = df.join(st, keys) if keys else df.join(F.broadcast(st), how="inner")  # one-row stats when unkeyed
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col(col) - F.col("__lo"), width)), F.lit(bins - 1))
    b = F.coalesce(b, F.lit(0)).cast("int")
    h = (j.filter(F.col(col).isNotNull()).withColumn("bin", b)
          .groupBy(*keys, "bin", "__lo", "__hi", "__n").agg(F.count("*").alias("count")))
    w = (F.col("__hi") - F.col("__lo")) / bins
    return h.select(*keys, "bin", (F.col("__lo") + F.col("bin") * w).alias("left"),
                    (F.col("__lo") + (F.col("bin") + 1) * w).alias("right"), "count",
                    F.try_divide(F.col("count"), F.col("__n") * w).alias("density"))


def kde(df: DataFrame, key: str, col: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density per group on a ``grid``-point grid, each group normalised by itself.

    Bandwidth ``std_samp · n^(-1/5)``; grid spans ``cut`` bandwidths beyond min and max.  Each Arrow batch sums the kernels
    of its rows over the grid points and yields ``grid`` rows per group it holds, so rows are never multiplied; a keyed
    sum joins the batches' parts.
    """
    import math

    st = df.groupBy(key).agg(F.count(col).alias("__n"), F.min(col).cast("double").alias("__lo"),
                             F.max(col).cast("double").alias("__hi"),
                             (F.stddev_samp(col) * F.pow(F.count(col), -0.2)).alias("__bw")) \
           .filter(F.col("__bw") > 0)
    rows = df.filter(F.col(col).isNotNull()).select(key, F.col(col).cast("double").alias("__v")).join(st, key)

    def sums(batches):
        import numpy as np
        import pandas as pd

        for batch in batches:
            for (k, n, lo, hi, bw), part in batch.groupby([key, "__n", "__lo", "__hi", "__bw"]):
                at = lo - cut * bw + np.arange(grid) * ((hi - lo) + 2 * cut * bw) / (grid - 1)
                total = np.zeros(grid)
                values = part["__v"].to_numpy()
                for i in range(0, len(values), 2048):
                    total += np.exp(-0.5 * ((at[None, :] - values[i:i + 2048, None]) / bw) ** 2).sum(axis=0)
                yield pd.DataFrame({key: k, "i": np.arange(grid, dtype="int32"), "x": at, "__n": n, "__bw": bw, "__k": total})

    kind = df.schema[key].dataType.simpleString()
    g = rows.mapInPandas(sums, f"`{key}` {kind}, i int, x double, __n bigint, __bw double, __k double")
    out = g.groupBy(key, "i").agg(F.first("x").alias("x"), F.first("__n").alias("__n"), F.first("__bw").alias("__bw"),
                                  F.sum("__k").alias("__s"))
    return out.select(key, "i", "x", (F.col("__s") / (F.col("__n") * F.col("__bw") * math.sqrt(2 * math.pi))).alias("density"))


def value_ranks(df: DataFrame, keys, col: str, name: str = "i", buckets: int = 1024) -> DataFrame:
    """``name``: the rank from 1 of each row's value in its key (ties in any order), and ``n``: the key's rows.  Rows are
    numbered inside equal parts of the key's value range, whose counts give the ranks before them, so no window orders a
    whole key."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(col).alias("__lo"), F.max(col).alias("__hi"), F.count("*").alias("n"))
    at = F.try_divide(F.col(col) - F.col("__lo"), F.col("__hi") - F.col("__lo")) * buckets
    d = df.join(span, keys).withColumn("__b", F.least(F.coalesce(F.floor(at), F.lit(0)), F.lit(buckets - 1)).cast("int"))
    upto = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = d.groupBy(*keys, "__b").agg(F.count("*").alias("__c")).select(
        *keys, "__b", F.coalesce(F.sum("__c").over(upto), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*keys, "__b").orderBy(col))
    return (d.withColumn("__r", inside).join(counts, [*keys, "__b"])
            .withColumn(name, (F.col("__before") + F.col("__r")).cast("int")).drop("__lo", "__hi", "__b", "__r", "__before"))


# ---------------------------------------------------------------- J7 standard scaling as scalar subqueries

def standard_scale(df: DataFrame, cols, fit_filter: Column | None = None, suffix: str = "") -> DataFrame:
    """``(x−μ)/σ`` with μ, σ (population) fitted on ``fit_filter`` rows only; σ = 0 → 1.

    Fit/transform like ``pyspark.ml``'s scaler: one aggregate job returns the 2·k statistics (size fixed by the
    column count, not the data) and the transform applies them as literals."""
    fit = df.filter(fit_filter) if fit_filter is not None else df
    row = fit.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
                  *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        m = 0.0 if m is None else float(m)
        s = 1.0 if (s is None or s == 0) else float(s)
        out[c + suffix] = (F.col(c) - F.lit(m)) / F.lit(s)
    return df.withColumns(out)


def random_distinct(df: DataFrame, col: str, k: int, seed: int = 42) -> DataFrame:
    """K distinct values drawn without replacement (seeded hash order), returned sorted; error when k exceeds the
    number of distinct values.  The ``limit`` is the sampling feature itself."""
    d = df.select(col).distinct()
    n = d.count()
    if k > n:
        raise ValueError(f"cannot draw {k} distinct values from {n}")
    if dict(df.dtypes)[col] == "date":  # engine-independent multiplicative hash of the epoch day
        key = F.datediff(F.col(col), F.lit("1970-01-01").cast("date")).cast("bigint")
        h = (key * F.lit(2654435761) + F.lit(seed * 40503 + 12345)) % F.lit(4294967296)
    else:
        h = F.xxhash64(F.col(col), F.lit(seed))
    return d.orderBy(h, col).limit(k).orderBy(col)
