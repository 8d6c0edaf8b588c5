"""Helpers for joins and helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fresh(taken: list[str], name: str) -> str:
    """`name`, with underscores added until no column in `taken` has it (case does not count)."""
    have = {x.lower() for x in taken}
    while name.lower() in have:
        name += "_"
    return name


def matched(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left.join(right, key), dealt anew by a struct of the key.

    A side that was aggregated by the key is dealt by it already, and then adaptive execution cannot split
    the rows of a key that very many rows of the other side have. No aggregation deals by the struct.
    """
    name = fresh([*left.columns, *right.columns], "matched")
    keyed_right = right.select(F.struct(key).alias(name), *[c for c in right.columns if c != key])
    return left.withColumn(name, F.struct(key)).join(keyed_right, name, how).drop(name)
