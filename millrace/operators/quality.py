"""Document quality: heuristics, educational score, source acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let, not_blank, strip, symbols

# Phrases that raise or lower the educational score.
RAISING = ("therefore", "because", "for example", "definition", "theorem", "proof", "algorithm", "concept", "function", "explain", "step-by-step", "in summary")
LOWERING = ("cookie policy", "all rights reserved", "click here", "subscribe")


def duplicate_line_ratio(text: Column) -> Column:
    """Share of lines that repeat another or are blank; blank lines count in the denominator. 0 up to 5 lines."""
    distinct = lambda lines: F.array_distinct(F.filter(F.transform(lines, strip), lambda x: x != ""))
    ratio = lambda lines: F.when(F.size(lines) > 5, 1.0 - F.size(distinct(lines)).cast("double") / F.size(lines)).otherwise(0.0)
    return let(F.split(strip(text), "\n", -1), ratio)


def symbol_ratio(text: Column) -> Column:
    return symbols(text).cast("double") / F.greatest(F.length(text), F.lit(1))


def passes(text: Column, min_chars: int = 64, max_chars: int = 100_000, max_symbols: float = 0.35, max_repetition: float = 0.40) -> Column:
    """Length band, a word, few symbols, few repeated lines; false for null."""
    ok = F.length(text).between(min_chars, max_chars) & not_blank(text) & (symbol_ratio(text) <= max_symbols) & (duplicate_line_ratio(text) <= max_repetition)
    return F.coalesce(ok, F.lit(False))


def has_code(text: Column) -> Column:
    return text.contains("def ") | text.contains("class ")


def _says(text: Column, low: Column, phrase: str) -> Column:
    """Whether the phrase stands in the text as words, in any case; the pattern is tried only where its letters stand."""
    return low.contains(phrase) & text.rlike(rf"(?iU)\b{phrase}\b")


def educational_score(text: Column) -> Column:
    """2.5 plus and minus what its phrases, code and headings are worth, from 0 to 5."""
    # letters that a pattern takes for i, s and k in any case
    low = F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))
    code, heading = text.contains("```") | has_code(text), text.rlike(r"(?mdU)^#{1,4}\s+") | text.rlike(r"(?mdU)^\d+\.\s+")

    def score(low: Column) -> Column:
        out = F.lit(2.5)
        for phrase in RAISING:
            out = out + F.when(_says(text, low, phrase), 0.25).otherwise(0.0)
        out = out + F.when(code, 0.5).otherwise(0.0) + F.when(heading, 0.3).otherwise(0.0)
        for phrase in LOWERING:
            out = out - F.when(_says(text, low, phrase), 0.5).otherwise(0.0)
        return F.greatest(F.lit(0.0), F.least(F.lit(5.0), out))

    return let(low, score)


def accepted_source(text: Column, score: Column, threshold: float = 4.0) -> Column:
    """A scored web record: a high score of either kind, and the heuristics from 128 characters."""
    return ((F.coalesce(score, F.lit(0.0)) >= threshold) | (educational_score(text) >= 4.0)) & passes(text, min_chars=128)


def has_tool_markers(chat: Column) -> Column:
    return chat.contains("<functioncall>") & chat.contains("FUNCTION RESPONSE:")


def quality_filter(docs: DataFrame, **limits: float) -> DataFrame:
    return docs.where(passes(F.col("text"), **limits))
