"""Maps as settings and vocabularies use them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def merged(under: Column, over: Column) -> Column:
    """Both maps' entries; where both have a key, that of `over`."""
    return F.map_concat(F.map_filter(under, lambda k, v: ~F.map_contains_key(over, k)), over)


def inverted(m: Column) -> Column:
    """Values to keys; of equal values the last key by order counts."""
    entries = F.array_sort(F.transform(F.map_entries(m), lambda e: F.struct(e["value"].alias("key"), e["key"].alias("value"))))
    last = F.filter(entries, lambda e, i: F.coalesce(F.get(entries, i + 1)["key"] != e["key"], F.lit(True)))
    return F.map_from_entries(last)
