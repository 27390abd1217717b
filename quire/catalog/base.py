"""Registry of runnable queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# --- DuckDB text shared by the SQL twins -------------------------------------------

SPACE = r"\s\p{Z}\x0b\x{85}"


def d_strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def d_norm(e: str) -> str:
    return rf"lower(regexp_replace({e}, '[{SPACE}\p{{P}}\p{{S}}]', '', 'g'))"


def d_prefix(e: str) -> str:
    inner = rf"regexp_replace({d_strip(e)}, '(?i)^(?:\[P\p{{Nd}}+(?:-\p{{Nd}}+)?\][{SPACE}]*)+', '')"
    return d_strip(inner)


def d_has(e: str, pattern: str) -> str:
    """Pattern written for Java turned into RE2: quote doubling and Unicode digits/spaces."""
    p = pattern.replace(r"\d", r"\p{Nd}").replace("'", "''")
    return f"regexp_matches({e}, '{p}')"
