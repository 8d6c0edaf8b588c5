"""Running sums over a global order without putting all rows into one task."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.joins import fresh

ROWS = 1_000_000  # of a stretch
MOST = 1 << 14  # stretches


def _place(order: Column, table: Column, cuts: int) -> Column:
    """How many of the cuts (sorted, one less than a power of two) are not above `order`, by binary search."""
    steps = []
    step = (cuts + 1) // 2
    while step:
        steps.append(step)
        step //= 2
    found = lambda at, step: F.when(F.get(table, at + step - 1) <= order, at + step).otherwise(at)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), found)


def stretched(df: DataFrame, order: str, name: str, rows: int = ROWS, most: int = MOST) -> tuple[DataFrame, int]:
    """df with `name`, the number of its stretch, and how many stretches there are: the order (whole numbers, or what casts
    to them) is cut at its quantiles into stretches of about `rows` rows, however the values lie."""
    (n,) = df.agg(F.count("*")).first()
    stretches = 1
    while stretches * rows < n and stretches < most:
        stretches *= 2
    return placed(df, order, quantiles(df, order, stretches), name), stretches


def quantiles(df: DataFrame, order: str, stretches: int) -> list[int]:
    """Where the order is cut into stretches (a power of two) of about as many rows each."""
    if stretches == 1:
        return []
    shares = [k / stretches for k in range(1, stretches)]
    return df.agg(F.percentile_approx(F.col(order).cast("long"), shares, 10 * stretches)).first()[0] or []


def placed(df: DataFrame, order: str, cuts: list[int], name: str) -> DataFrame:
    """df with `name`, the number of its stretch by cuts of `quantiles`."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    cuts_ = fresh([*df.columns, name], "cuts")
    table = df.sparkSession.range(1).select(F.array(*map(F.lit, cuts)).alias(cuts_))
    return df.crossJoin(F.broadcast(table)).withColumn(name, _place(F.col(order).cast("long"), F.col(cuts_), len(cuts))).drop(cuts_)


def running_sum(df: DataFrame, order: str, value: str, name: str, rows: int = ROWS) -> DataFrame:
    """df with `name`, the sum of `value` over all rows before this one by `order` (a unique integer, not null).

    The stretches' sums (MOST numbers at most) are added up first and joined back; within a stretch a window does the rest.
    A stretch is bounded in rows, so texts and arrays stay out of it: their rows get the sums by a join on `order`.
    """
    if any(re.match("string|binary|array|map|struct|variant|char|varchar", t) for c, t in df.dtypes if c not in (order, value)):
        sums = running_sum(df.select(*dict.fromkeys((order, value))), order, value, name, rows)
        return df.join(sums.select(order, name), order).select(*df.columns, name)
    stretch = fresh([*df.columns, name], "stretch")
    base, total = (fresh([*df.columns, name, stretch], x) for x in ("base", "total"))
    cut, stretches = stretched(df, order, stretch, rows)
    inside = Window.partitionBy(stretch).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = F.sum(value).over(inside) - F.col(value)
    if stretches == 1:
        return cut.withColumn(name, own.cast("long")).drop(stretch)
    sums = cut.groupBy(stretch).agg(F.sum(value).alias(total))
    before = sums.select(stretch, (F.sum(total).over(Window.orderBy(stretch)) - F.col(total)).alias(base))
    return cut.join(F.broadcast(before), stretch).withColumn(name, (F.col(base) + own).cast("long")).drop(stretch, base)
