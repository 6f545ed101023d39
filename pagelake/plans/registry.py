"""Registry of queries: a callable per name, and where DuckDB can say the same, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagelake.functions.text import WHITESPACE

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def sql_strip(expression: str) -> str:
    return f"trim({expression}, '{WHITESPACE}')"


def sql_decode(expression: str) -> str:
    """Entities that occur in the stored pages."""
    for entity, char in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        expression = f"replace({expression}, '{entity}', '{char}')"
    return expression


def sql_text(expression: str) -> str:
    """Stripped text of markup that has no element boundaries inside."""
    return sql_strip(sql_decode(expression))


def sql_joined_text(markup: str) -> str:
    """Text runs between tags, each stripped, joined without a separator."""
    run = sql_text("x")
    return f"coalesce(array_to_string(list_transform(regexp_split_to_array({markup}, '<[^>]*>'), lambda x: {run}), ''), '')"
