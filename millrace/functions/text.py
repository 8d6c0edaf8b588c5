"""Column helpers for text whose rules are those of Unicode, not of ASCII."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body uses it, inside lambdas too."""
    return F.element_at(F.transform(F.array(value), body), 1)


SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """The text without white space at either end."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+\z", "")


def not_blank(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def words(text: Column) -> Column:
    """Runs of letters, numbers and underscores in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def symbols(text: Column) -> Column:
    """How many characters are neither letters, numbers nor white space."""
    return F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s\x1c-\x1f]", ""))


def occurrences(text: Column, tag: str) -> Column:
    """How often the tag stands in the text, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(tag), F.lit("")))) / len(tag)).cast("long")


def captured(text: Column, pattern: str) -> Column:
    """The first group of a pattern, stripped; null where the pattern does not match."""
    return F.when(text.rlike(pattern), strip(F.regexp_extract(text, pattern, 1)))
