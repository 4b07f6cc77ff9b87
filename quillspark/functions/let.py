"""Bind a value once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row.

    Catalyst may copy a projected expression into the lambda that uses it, where it
    would be computed once per element; a lambda variable cannot be copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
