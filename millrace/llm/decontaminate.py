"""Benchmark decontamination with a broadcast hash set of normalised test n-grams, in SQL functions only.

Texts are normalised alike: A-Z to lower case, words are runs of ASCII letters, digits and anything
outside ASCII. A benchmark item gives a window for every `n` consecutive words; an item of fewer
words is one window. The hashes of the distinct windows are the hash set. The scan hashes a document's words
once, takes the hash of the n-gram at each place from them, and probes the set with it. Every hit is
verified: its words must be those of a window. The probing stays in the map stage of the one scan, and
only hits are shuffled.

The set has eight bytes a window and is broadcast while it has MOST_GRAMS of them at most, counted before
the plan is made. A larger set is joined by a shuffle of the n-gram hashes instead, still in one scan.

Defined results: null text has no words and no hits; null items and items without words give no
window; rows that repeat doc_id and text get the same result each; repeated items count by their
distinct item_id; items with a null item_id mark words but are not counted.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.llm._rows import LEAST, fresh, keyed

WORDS = 10
MOST_GRAMS = 2_000_000

_SEPARATORS = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """The normalised words of a text; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase + _SEPARATORS, string.ascii_lowercase + " " * len(_SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def _hashes(w: Column | str) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """Distinct windows: window (words), size, code (hash of their hashes) and items (ids)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = items.select("item", F.explode(F.expr(f"transform(sequence(1, greatest(size(w) - {n - 1}, 1)), i -> slice(w, i, {n}))")).alias("window"))
    return each.groupBy("window").agg(F.collect_set("item").alias("items")).select("window", F.size("window").alias("size"), F.xxhash64(_hashes("window")).alias("code"), "items")


def _probed(docs: DataFrame, sizes: list[int]) -> DataFrame:
    """(_id, _crc, w, at, size, code): the n-gram of each size at each place of docs (_id, _crc, text)."""
    each = docs.select("_id", "_crc", words(F.col("text")).alias("w")).where(F.size("w") > 0).select("_id", "_crc", "w", _hashes("w").alias("h"))
    each = each.select("_id", "_crc", "w", "h", F.explode(F.sequence(F.lit(0), F.size("h") - 1)).alias("at"))
    code = lambda n: F.xxhash64(*[F.get("h", F.col("at") + k) for k in range(n)])
    if len(sizes) == 1:
        each = each.select("_id", "_crc", "w", "at", F.lit(sizes[0]).alias("size"), code(sizes[0]).alias("code"))
    else:
        grams = F.array(*[F.struct(F.lit(n).alias("size"), code(n).alias("code")) for n in sizes])
        each = each.select("_id", "_crc", "w", "at", F.explode(grams).alias("g")).select("_id", "_crc", "w", "at", "g.size", "g.code")
    return each.where(F.col("at") + F.col("size") <= F.size("w"))


def _hits(rows: DataFrame, benchmark: DataFrame, n: int) -> DataFrame:
    """Per document of rows (_id, _crc, text) with a hit: _id, _crc, words (sorted indexes of the words hit) and items (sorted ids)."""
    grams = windows(benchmark, n)
    counts = {r["size"]: r["count"] for r in grams.groupBy("size").count().collect()}
    codes, probed = grams.select("code").distinct(), _probed(rows, sorted(counts) or [n])
    if sum(counts.values()) <= MOST_GRAMS:
        found = probed.join(F.broadcast(codes), "code")
    else:  # places only are shuffled, and a hit's words come from its document again
        places = probed.select("_id", "_crc", "at", "size", "code").join(codes, "code")
        found = rows.select("_id", "_crc", words(F.col("text")).alias("w")).join(places, ["_id", "_crc"])
    found = found.select("_id", "_crc", "at", "size", "code", F.slice("w", F.col("at") + 1, F.col("size")).alias("here"))
    exact = found.join(grams.select("code", "window", "items"), "code").where(F.col("here") == F.col("window"))
    places = F.flatten(F.transform(F.collect_set(F.struct("at", "size")), lambda x: F.sequence(x["at"], x["at"] + x["size"] - 1)))
    return exact.groupBy("_id", "_crc").agg(
        F.array_sort(F.array_distinct(places)).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """_hits of docs with the columns doc_id and text."""
    return _hits(keyed(docs), benchmark, n)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WORDS) -> DataFrame:
    """One row per row of docs: doc_id, n_words, hit_words (indexes), items (ids) of the windows found."""
    rows = keyed(docs)
    none = F.array().cast("array<string>")
    counts = rows.select("_id", "_crc", "doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return counts.join(_hits(rows, benchmark, n), ["_id", "_crc"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("words", F.array().cast("array<int>")).alias("hit_words"),
        F.coalesce("items", none).alias("items"),
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, n: int = WORDS, remove: str = "documents") -> DataFrame:
    """docs, its columns unchanged, without the contaminated documents, or without the words hit.

    remove="spans" keeps every document and takes the hit words out of its text, each with the
    separators before it; a text that loses words is otherwise unchanged.
    """
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    i, c, h = (fresh(docs.columns, x) for x in ("key_id", "key_crc", "hit_words"))
    rows = keyed(docs)
    found = _hits(rows, benchmark, n).select(F.col("_id").alias(i), F.col("_crc").alias(c), F.col("words").alias(h))
    own = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), c: F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    if remove == "documents":
        return own.join(found.select(i, c), [i, c], "left_anti").select(*[F.col(f"`{x}`") for x in docs.columns])
    # cut behind each word: a piece is a word and the separators before it, the last may have no word
    pieces = F.split(F.col("text"), f"(?<={_WORD})(?={_SEPARATOR})", -1)
    stay = lambda all_: F.array_except(F.sequence(F.lit(0), F.size(all_) - 1), F.col(h))
    left = let(pieces, lambda all_: F.array_join(F.transform(stay(all_), lambda i: F.get(all_, i)), ""))
    text = F.when(F.col(h).isNull(), F.col("text")).otherwise(left)
    return own.join(found, [i, c], "left").select(*[text.alias(x) if x == "text" else F.col(f"`{x}`") for x in docs.columns])
