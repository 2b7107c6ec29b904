"""Registry of named queries: Spark callables and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rx(col: str, pattern: str) -> str:
    """Two-valued regex find in DuckDB SQL."""
    return f"coalesce(regexp_matches({col}, '{pattern}'), false)"


def add_tag_sql(tags: str, tag: str) -> str:
    return f"list_sort(list_distinct(list_concat(coalesce({tags}, []::VARCHAR[]), ['{tag}'])))"


def tags_text_sql(tags: str) -> str:
    return f"array_to_string(list_sort({tags}), ' ')"
