"""One row per array element.

The plain generators make Catalyst infer a size filter on their array, which
computes a costly array expression again. The outer forms do not; the row they
give for an empty array is dropped here instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, items: Column, name: str, *keep: str | Column) -> DataFrame:
    """``keep`` and one non-null element per row."""
    return df.select(*keep, F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def each_at(df: DataFrame, items: Column, at: str, name: str, *keep: str | Column) -> DataFrame:
    """As ``each`` with the 0-based position."""
    return df.select(*keep, F.posexplode_outer(items).alias(at, name)).where(F.col(at).isNotNull())


def each_struct(df: DataFrame, items: Column, field: str, *keep: str | Column) -> DataFrame:
    """``keep`` and the fields of one struct per row; ``field`` names one that is never null."""
    return df.select(*keep, F.inline_outer(items)).where(F.col(field).isNotNull())
