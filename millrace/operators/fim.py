"""Fill-in-the-middle and end-of-sequence transforms of token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.hashing import uniform
from millrace.operators.tokenize import SPECIAL

PREFIX, MIDDLE, SUFFIX, END = (SPECIAL[x] for x in ("<|fim_prefix|>", "<|fim_middle|>", "<|fim_suffix|>", "<|eos|>"))


def with_end(ids: Column, end: int = END) -> Column:
    """The ids with the end token, unless it is there."""
    return F.when((F.size(ids) > 0) & (F.element_at(ids, -1) == end), ids).otherwise(F.concat(ids, F.array(F.lit(end))))


def fill_in_middle(ids: Column, key: Column, rate: float = 0.5, suffix_first: float = 0.5, min_length: int = 16, seed: int = 42) -> Column:
    """Cuts the ids in three non-empty parts and moves the middle behind; four tokens longer where it applies.

    Draws depend on seed and key only. Short arrays, and a share of 1 - rate of the others, stay.
    """
    n = F.size(ids)
    one = 1 + F.floor(uniform(seed, F.lit("cut1"), key) * (n - 2)).cast("int")
    two = one + 1 + F.floor(uniform(seed, F.lit("cut2"), key) * (n - 1 - one)).cast("int")
    pre, mid, suf = F.slice(ids, 1, one), F.slice(ids, one + 1, two - one), F.slice(ids, two + 1, n - two)
    tag = lambda t: F.array(F.lit(t))
    prefix_first = F.concat(tag(PREFIX), pre, tag(SUFFIX), suf, tag(MIDDLE), mid, tag(END))
    suffix_first_ = F.concat(tag(SUFFIX), suf, tag(PREFIX), pre, tag(MIDDLE), mid, tag(END))
    moved = F.when(uniform(seed, F.lit("order"), key) < suffix_first, suffix_first_).otherwise(prefix_first)
    return F.when((n >= min_length) & (uniform(seed, F.lit("apply"), key) <= rate), moved).otherwise(ids)
