"""Registry of named queries (Spark callables) and their DuckDB twins.

``@register(name, sql)`` records ``fn(spark, sf_dir) -> DataFrame`` and, when the operator is SQL-expressible, the
equivalent DuckDB SQL over the stored tables.  ``__spark_entry__`` exposes both dictionaries.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query name {name}")
        QUERIES[name] = fn
        if sql is not None:
            from panelspark.functions.util import sql_round_to_floor

            ORACLE[name] = sql_round_to_floor(sql)
        return fn
    return deco
