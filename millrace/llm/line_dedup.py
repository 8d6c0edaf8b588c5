"""Line de-duplication by winnowing over line hashes.

A text is a sequence of lines with a word in them; blank lines belong to the line before (leading ones
to the first). A window is `run` consecutive lines; with `words` given, also any shorter run with at
least that many words (a word is a run of characters other than ASCII white space), so one long line is
a window of its own. The rule: lines covered by a window that also stands earlier, by (doc_id, line), are
deleted. Windows are judged on the input.

Winnowing. Of each window the line with the smallest hash is selected, the first of equal ones. A line is
a fingerprint once, however many windows have selected it, so there are about 2 / (run + 1) fingerprints
a line. Which line a window selects depends on the window alone, so a repeated window has the same
fingerprint at the same offset in all its places: none is missed.

Positions. Fingerprints are counted; those that stand once in the corpus end there. The positions of
the others are joined, and each match is extended both ways, over the lines before and after that the
windows around the fingerprint reach. What is joined in the end are (extended match, offset), so a line that
stands in a third of all documents in different surroundings makes no pairs, and one in the same
surroundings is pre-aggregated to its first and last place. Overlapping windows of a document make up
its maximal repeated runs, of which all but the first go.

Only SQL functions are used. A line is known by 64 bits as a fingerprint and by 128 bits in an extended match.

Defined results: null text stays null and has no lines; a text without a word has one blank line
at most and loses nothing; fewer lines than `run` lose nothing unless `words` says so; rows that repeat doc_id and text are
one document; a null doc_id comes first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.llm._rows import LEAST, checkpointed, fresh, keyed

RUN = 3
WORDS = 50

_BREAK = r"\n(?=[^\n]*[^ \t\x0B\f\r\n])"
_EDGE = " \t\x0b\x0c\r\n"


def lines(text: Column) -> Column:
    """The lines of a text; joined by a line feed they are the text again."""
    return F.split(text, _BREAK, -1)


def _selects(at: str, back: int, size: int, run: int, words: int | None) -> str:
    """SQL: whether the window of `size` lines that begins `back` lines before line `at` selects that line."""
    first = f"{at} - {back}"
    terms = [f"{first} >= 0", f"{first} + {size} <= size(h)"]
    terms += [f"get(h, {first} + {k}) > get(h, {at})" for k in range(back)]
    terms += [f"get(h, {first} + {k}) >= get(h, {at})" for k in range(back + 1, size)]
    if size < run:
        terms.append(" + ".join(f"get(c, {first} + {k})" for k in range(size)) + f" >= {words}")
    return " and ".join(terms)


def _hashed(docs: DataFrame, words: int | None) -> DataFrame:
    """(_id, _crc, h, g, c): two hashes, and the words if they are asked for, of each line of docs (_id, _crc, text)."""
    split = lines(F.col("text"))
    bare = F.transform(split, lambda x: F.btrim(x, F.lit(_EDGE)))
    each = docs.where(F.col("text").isNotNull()).select("_id", "_crc", bare.alias("b"))
    counts = [] if words is None else [F.transform("b", lambda x: F.size(F.array_remove(F.split(F.translate(x, _EDGE, " " * len(_EDGE)), " "), ""))).alias("c")]
    one, two = F.transform("b", lambda x: F.xxhash64(x)), F.transform("b", lambda x: F.xxhash64(F.lit(1), x))
    return each.select("_id", "_crc", one.alias("h"), two.alias("g"), *counts)


def _windows(run: int, words: int | None) -> list[tuple[int, int]]:
    """(back, size) of every window around a line."""
    return [(back, size) for size in ([run] if words is None else range(1, run + 1)) for back in range(size)]


def fingerprints(hashed: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(fingerprint, _id, _crc, at): the lines that windows select."""
    chosen = " or ".join(f"({_selects('p', back, size, run, words)})" for back, size in _windows(run, words))
    at = F.explode(F.expr(f"filter(sequence(0, size(h) - 1), p -> {chosen})"))
    return hashed.select("_id", "_crc", "h", at.alias("at")).select(F.get("h", F.col("at")).alias("fingerprint"), "_id", "_crc", "at")


def _extended(hashed: DataFrame, matched: DataFrame, run: int, words: int | None) -> DataFrame:
    """(key, _id, _crc, begin): the windows around matched fingerprints (_id, _crc, places), known by size, offset and 128 bits."""
    each = [f"if({_selects('p', back, size, run, words)}, struct(p - {back} as begin, {back} as back, {size} as size), null)" for back, size in _windows(run, words)]
    around = F.explode(F.expr(f"flatten(transform(places, p -> array_compact(array({', '.join(each)}))))"))
    rows = hashed.join(matched, ["_id", "_crc"]).select("_id", "_crc", "h", "g", around.alias("w")).select("_id", "_crc", "h", "g", "w.begin", "w.back", "w.size")
    hashes = [F.xxhash64(F.slice(x, F.col("begin") + 1, F.col("size"))).alias(x) for x in ("h", "g")]
    return rows.select(F.struct("size", "back", *hashes).alias("key"), "_id", "_crc", "begin")


def repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """(_id, _crc, removed): for each document with any, the indexes of lines to delete. docs has doc_id and text."""
    hashed = checkpointed(_hashed(keyed(docs), words))
    # joined by structs, which no aggregation has dealt by, so that adaptive execution may split a frequent line's rows
    rows = fingerprints(hashed, run, words).select(F.struct("fingerprint").alias("f"), "_id", "_crc", "at")
    often = rows.groupBy(F.col("f.fingerprint").alias("x")).agg(F.count("*").alias("n")).where("n > 1").select(F.struct(F.col("x").alias("fingerprint")).alias("f"))
    matched = rows.join(often, "f").groupBy("_id", "_crc").agg(F.collect_set("at").alias("places"))
    found = _extended(hashed, matched, run, words)
    place = F.struct("_id", "_crc", "begin")
    groups = found.select("key.*", place.alias("place")).groupBy("size", "back", "h", "g").agg(F.min("place").alias("first"), F.max("place").alias("last")).where("first != last")
    later = found.join(groups.select(F.struct("size", "back", "h", "g").alias("key"), "first"), "key").where(place != F.col("first"))
    covered = F.flatten(F.transform(F.collect_set(F.struct("begin", "key.size")), lambda s: F.sequence(s["begin"], s["begin"] + s["size"] - 1)))
    return later.groupBy("_id", "_crc").agg(F.array_distinct(covered).alias("removed"))


def _joined(docs: DataFrame, run: int, words: int | None) -> tuple[DataFrame, str]:
    i, c, r = (fresh(docs.columns, x) for x in ("key_id", "key_crc", "removed_lines"))
    found = repeated_lines(docs.select("doc_id", "text"), run, words).select(F.col("_id").alias(i), F.col("_crc").alias(c), F.col("removed").alias(r))
    own = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), c: F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    return own.join(found.hint("shuffle_hash"), [i, c], "left"), r


def _kept(removed: str) -> Column:
    def left(all_: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(removed))
        return F.array_join(F.transform(stay, lambda i: F.get(all_, i)), "\n")

    return F.when(F.col(removed).isNull(), F.col("text")).otherwise(let(lines(F.col("text")), left))


def dedup_lines(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, n_removed and `kept`, the text that is left."""
    joined, removed = _joined(docs.select("doc_id", "text"), run, words)
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines(F.col("text"))))
    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), n.cast("long").alias("n_lines"), F.coalesce(F.size(F.when(F.col(removed).isNotNull(), F.col(removed))), F.lit(0)).cast("long").alias("n_removed"), _kept(removed).alias("kept"))


def without_repeats(docs: DataFrame, run: int = RUN, words: int | None = None) -> DataFrame:
    """docs, its columns unchanged, with repeated runs deleted from the text; documents left without a line go."""
    joined, removed = _joined(docs, run, words)
    gone = F.col(removed).isNotNull() & (F.size(removed) >= F.size(lines(F.col("text"))))
    return joined.where(~F.coalesce(gone, F.lit(False))).select(*[_kept(removed).alias(x) if x == "text" else F.col(f"`{x}`") for x in docs.columns])
