"""Table, template, prompt and checkpoint sources."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import files
from millrace.functions.joins import fresh
from millrace.functions.prefix import running_sum
from millrace.functions.text import not_blank
from millrace.operators.mixing import split_quota
from millrace.operators.quality import accepted_source, has_tool_markers, passes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def textbooks(df: DataFrame) -> DataFrame:
    """Textbook records: not blank, heuristics from 128 characters."""
    return df.where(not_blank(F.col("text")) & passes(F.col("text"), min_chars=128))


def scored_web(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    """Web records with a score column."""
    return df.where(accepted_source(F.col("text"), F.col("score"), threshold))


def bounded_textbooks(books: DataFrame, web: DataFrame, count: int, ratio: float = 0.60, threshold: float = 4.0, order: str = "ord") -> DataFrame:
    """(part, order, text): the first textbooks (part 0) and the first accepted web records (part 1), by a ratio of `count`."""
    n_books, n_web = split_quota(count, ratio)
    first = textbooks(books).orderBy(order).limit(n_books).select(F.lit(0).alias("part"), order, "text")
    return first.unionByName(scored_web(web, threshold).orderBy(order).limit(n_web).select(F.lit(1).alias("part"), order, "text"))


def cycled(rows: DataFrame, count: int, order: str, otherwise: DataFrame | None = None) -> DataFrame:
    """(place, ...): `count` rows that go round through rows in their order; those of `otherwise` if there are none."""
    spark = rows.sparkSession
    if otherwise is not None and rows.isEmpty():
        return cycled(otherwise, count, order)
    one, at = (fresh([*rows.columns, "place"], x) for x in ("one", "at"))
    numbered = running_sum(rows.withColumn(one, F.lit(1)), order, one, at).drop(one)
    n = max(1, rows.count())
    return spark.range(count).select(F.col("id").alias("place"), (F.col("id") % n).alias(at)).join(numbered, at).drop(at)


def tool_chats(df: DataFrame) -> DataFrame:
    return df.where(has_tool_markers(F.col("chat")))


def templated(spark: SparkSession, templates: list[str], count: int) -> DataFrame:
    """(ord, text): row i has template i modulo their number."""
    rows = spark.createDataFrame(list(enumerate(templates)), "template int, text string")
    return spark.range(count).withColumn("template", (F.col("id") % len(templates)).cast("int")).join(F.broadcast(rows), "template").select(F.col("id").alias("ord"), "text")


def prompt_file(spark: SparkSession, path: str) -> DataFrame:
    """(ord, prompt) of a JSON array of strings."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "prompt"))


def write_prompts(prompts: DataFrame, path: str, count: int, order: str = "ord", prompt: str = "prompt") -> int:
    """The first `count` prompts by order as a JSON array of strings in one file; how many there were."""
    rows = [r[0] for r in prompts.orderBy(order).limit(count).select(prompt).collect()]
    files.write_text(prompts.sparkSession, path, json.dumps(rows, indent=2))
    return len(rows)


def prompts_or(spark: SparkSession, path: str, generated: DataFrame) -> DataFrame:
    """(ord, prompt) of a prompt file, or of `generated` (ord, text) if there is no such file."""
    if files.exists(spark, path):
        return prompt_file(spark, path)
    return generated.select(F.col("ord").cast("int").alias("ord"), F.col("text").alias("prompt"))


def config(path: str) -> dict:
    """A YAML file with section maps; raises if it is missing."""
    import yaml

    if not os.path.exists(path):
        raise FileNotFoundError(path)
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def phase_shares(settings: dict, default: tuple[float, float, float]) -> tuple[float, float, float]:
    """Shares of the syntax, logic and agentic phases, as a curriculum's settings name them."""
    out = list(default)
    for phase in settings.get("curriculum", {}).get("phases", []):
        name = phase.get("name", "").lower()
        for k, words in enumerate((("syntax", "phase 1"), ("logic", "phase 2"), ("agentic", "phase 3"))):
            if any(w in name for w in words):
                out[k] = phase.get("share", 0.0)
                break
    return tuple(out)


def projected(sections: dict, known: set[str]) -> dict:
    """Section maps merged, root scalars over them, unknown keys dropped."""
    flat: dict = {}
    for value in sections.values():
        if isinstance(value, dict):
            flat |= value
    flat |= {k: v for k, v in sections.items() if not isinstance(v, dict)}
    return {k: v for k, v in flat.items() if k in known}


def connector_available(module: str = "datasets") -> bool:
    import importlib.util

    return importlib.util.find_spec(module) is not None
