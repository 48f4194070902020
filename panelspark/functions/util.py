"""Small column helpers shared by queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rnd(c, digits: int = 6) -> Column:
    """Half-up rounding as plain IEEE arithmetic, ``floor(x·10ⁿ + 0.5001) / 10ⁿ``.

    Unlike ``round`` (exact-decimal on Spark, scaled on other engines) every engine computes the same bits.  The
    1e-4 (scaled) nudge moves the rounding boundary off exact decimal ties (a 2-decimal sum over a power-of-two count
    is one), where two engines' last-bit summation differences would otherwise round apart."""
    c = F.col(c) if isinstance(c, str) else c
    s = float(10 ** digits)
    t = c.cast("double") * F.lit(s) + F.lit(0.5001)
    # beyond 2**52 a double has no fraction left to cut (and ``floor`` would leave the range of bigint); NaN and the
    # infinities pass through
    whole = F.when(F.isnan(t) | (F.abs(t) >= F.lit(float(1 << 52))), t).otherwise(F.floor(t).cast("double"))
    return F.when(c.isNotNull(), whole / F.lit(s))


def round_doubles(df: DataFrame, digits: int = 6, overrides: dict | None = None) -> DataFrame:
    """Round every double column (stable value hashes across engines); ``overrides``: per-column digits."""
    overrides = overrides or {}
    return df.select(*[rnd(F.col(c), overrides.get(c, digits)).alias(c) if t in ("double", "float")
                       else F.col(c) for c, t in df.dtypes])


def sql_select(cols, doubles=(), digits: int = 6, overrides: dict | None = None) -> str:
    """Matching SQL select list: ``round(c, n) AS c`` for the double columns."""
    overrides = overrides or {}
    return ", ".join(f"round({c}, {overrides.get(c, digits)}) AS {c}" if c in doubles else c for c in cols)


def sql_round_to_floor(sql: str) -> str:
    """Rewrite every ``round(expr, n)`` of an oracle SQL text into ``floor(expr·10ⁿ + 0.5) / 10ⁿ`` (see ``rnd``)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        while j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            j = sql.find(key, j + 1)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        out.append(sql[i:j])
        depth, k, comma = 1, j + len(key), -1
        while depth:
            ch = sql[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            elif ch == "'":
                k = sql.index("'", k + 1)
            k += 1
        inner = sql[j + len(key):k - 1]
        expr, n = (inner[:comma - j - len(key)], inner[comma - j - len(key) + 1:].strip()) if comma > 0 else (inner, "0")
        expr = sql_round_to_floor(expr)
        out.append(f"(floor(CAST({expr} AS DOUBLE) * 1e{n} + 0.5001) / 1e{n})")
        i = k
