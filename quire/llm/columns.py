"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for a row."""
    return F.transform(F.array(value), use)[0]


def with_fields(df: DataFrame, keep: list[str], found: Column, fields: list[str]) -> DataFrame:
    """``keep`` and the fields of the struct ``found``.

    A generator is never merged with what reads it, so the struct is computed once for a row.
    """
    rows = df.select(*keep, F.explode(F.array(found)).alias("_found"))
    return rows.select(*keep, *(F.col(f"_found.{f}").alias(f) for f in fields))
