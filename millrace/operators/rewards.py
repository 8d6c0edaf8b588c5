"""Verifiable rewards of completions, and their normalisation by group (reward rules, A4, A5, A12)."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from millrace.functions.text import occurrences, strip


def _doubles(*names: str) -> StructType:
    out = StructType()
    for name in names:
        out = out.add(name, DoubleType())
    return out


@F.pandas_udf(_doubles("good", "bad"))
def _python_blocks(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for series in parts:
        rows = []
        for blocks in series:
            good = bad = 0.0
            for code in blocks if blocks is not None else ():
                try:
                    ast.parse(code)
                    good += 1
                except SyntaxError:
                    bad += 1
                except ValueError:  # a null byte: neither
                    pass
            rows.append((good, bad))
        yield pd.DataFrame(rows, columns=["good", "bad"])


@F.pandas_udf(_doubles("tool", "other", "bad"))
def _tool_calls(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    decoder = json.JSONDecoder()
    for series in parts:
        rows = []
        for sections in series:
            tool = other = bad = 0.0
            for text in sections if sections is not None else ():
                try:
                    value, _ = decoder.raw_decode(text, text.index("{"))
                except ValueError:
                    bad += 1
                    continue
                if "tool" in value or "name" in value:
                    tool += 1
                else:
                    other += 1
            rows.append((tool, other, bad))
        yield pd.DataFrame(rows, columns=["tool", "other", "bad"])


def reward(completions: DataFrame, text: str = "completion") -> DataFrame:
    """completions with syntax_reward, tool_reward, format_penalty, reflection_reward and total_reward."""
    c = F.col(text)
    blocks = F.regexp_extract_all(c, F.lit(r"(?s)```python\s*(.*?)\s*```"), F.lit(1))
    sections = F.slice(F.split(c, r"\Q<|call tool|>\E", -1), 2, 1 << 30)
    checked = completions.withColumns({"_p": _python_blocks(F.when(c.contains("```python"), blocks)), "_t": _tool_calls(F.when(c.contains("<|call tool|>"), sections))})
    unbalanced = F.when(occurrences(c, "<|thought start|>") != occurrences(c, "<|thought end|>"), 1.5).otherwise(0.0)
    tail = strip(F.element_at(F.split(c, r"\Q<|reflect|>\E", -1), -1))
    parts = {
        "syntax_reward": F.col("_p.good") + 0.5 * F.col("_t.other"),
        "tool_reward": 2.0 * F.col("_t.tool"),
        "format_penalty": 0.0 - unbalanced - F.col("_p.bad") - 1.5 * F.col("_t.bad"),
        "reflection_reward": F.when(c.contains("<|reflect|>") & (F.length(tail) > 5), 1.0).otherwise(0.0),
    }
    total = F.col("syntax_reward") + F.col("tool_reward") + F.col("format_penalty") + F.col("reflection_reward")
    return checked.withColumns(parts).withColumn("total_reward", total).drop("_p", "_t")


def in_order(group: str, order: str) -> WindowSpec:
    """A whole group, its sums added up by order, so that they are the same in each run."""
    return Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def advantage(value: str, group: str, epsilon: float = 1e-8, order: str | None = None) -> Column:
    """A value's distance from its group's mean in population standard deviations.

    The sign of a value that is the mean itself hangs on rounding, so on the order in which the mean is added up: `order` fixes it.
    """
    w = in_order(group, order) if order else Window.partitionBy(group)
    return (F.col(value) - F.avg(value).over(w)) / (F.stddev_pop(value).over(w) + epsilon)


def group_summary(rows: DataFrame, value: str, group: str) -> DataFrame:
    return rows.groupBy(group).agg(F.avg(value).alias("mean_reward"), F.max(value).alias("max_reward"), F.min(value).alias("min_reward"))


def policy_loss(tokens: DataFrame, group: str, sample: str, new: str, old: str, advantage: str, reference: str | None = None, clip: float = 0.2, beta: float = 0.04, group_size: int | None = None) -> DataFrame:
    """(group, loss, policy, kl, clipped_low, clipped_high, tokens, samples) of sampled tokens' log probabilities.

    A token's policy term is the smaller of ratio * advantage and clipped ratio * advantage, with its sign turned, where the ratio is that of the new
    to the old probability; its divergence term is p_ref * (log p_ref - log p_new). Both are averaged over a sample's tokens,
    then added over the group's samples and divided by the group's size: `group_size` where samples without tokens
    count, else the number of samples. Clipping counts where it lowers the term: above 1 + clip for positive advantages, below 1 - clip for negative ones.
    """
    ratio, a = F.exp(F.col(new) - F.col(old)), F.col(advantage)
    held = F.least(F.greatest(ratio, F.lit(1.0 - clip)), F.lit(1.0 + clip))
    kl = F.exp(reference) * (F.col(reference) - F.col(new)) if reference else F.lit(0.0)
    each = tokens.select(
        F.col(group).alias(group), F.col(sample).alias(sample), (-F.least(ratio * a, held * a)).alias("policy"), kl.alias("kl"),
        ((ratio < 1.0 - clip) & (a < 0)).cast("long").alias("low"), ((ratio > 1.0 + clip) & (a > 0)).cast("long").alias("high"),
    )
    by = each.groupBy(group, sample).agg(F.avg("policy").alias("policy"), F.avg("kl").alias("kl"), F.sum("low").alias("low"), F.sum("high").alias("high"), F.count("*").alias("n"))
    size = F.lit(group_size) if group_size else F.count("*")
    policy, divergence = F.sum("policy") / size, F.sum("kl") / size
    return by.groupBy(group).agg(
        (policy + beta * divergence).alias("loss"), policy.alias("policy"), divergence.alias("kl"), F.sum("low").alias("clipped_low"), F.sum("high").alias("clipped_high"),
        F.sum("n").alias("tokens"), F.count("*").alias("samples"),
    )
