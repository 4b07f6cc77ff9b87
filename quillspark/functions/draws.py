"""Seeded draws: md5 of the seed and the row's identity, so a re-run task draws the same."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: str | int, *parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def draw32(seed: str | int, *parts: Column) -> Column:
    """Integer in [0, 2^32)."""
    return F.conv(F.substring(seeded_key(seed, *parts), 1, 8), 16, 10).cast("long")


def draw_below(limit: Column, seed: str | int, *parts: Column) -> Column:
    """Integer in [0, limit) from 32 random bits, or from 60 where the limit needs them."""
    wide = F.conv(F.substring(seeded_key(seed, *parts), 1, 15), 16, 10).cast("long")
    return F.when(limit < (1 << 31), F.pmod(draw32(seed, *parts), limit)).otherwise(
        F.pmod(wide, limit)
    )
