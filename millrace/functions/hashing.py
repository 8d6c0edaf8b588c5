"""Draws that depend on (seed, purpose, key) only: the same in any engine and under any partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_key(seed: int, *parts: Column) -> Column:
    """A hex string to order by, in place of a seeded shuffle."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))


def uniform(seed: int, *parts: Column) -> Column:
    """A number in [0, 1)."""
    return F.conv(F.substring(rank_key(seed, *parts), 1, 8), 16, 10).cast("double") / float(1 << 32)
