"""Spelling variants: each word's near words, and the far more frequent one whose variant it is.

Two words are near if they differ by exactly one inserted, deleted or replaced character. The join is an even-partition
pigeonhole join: a word is cut into two segments of even length, and one edit leaves one of them as it is. So a word
is indexed by each segment, together with its length and the segment's place, and probed by the segments that words of
its own length or one shorter would have: at the same place for what stands before the edit, one place
further for what stands behind it. The other segment is the hole in which the edit must be.

Many words share a segment. A key whose words would make more than MOST_CANDIDATES candidates is not joined but cut
again: its hole is cut evenly in two, and one edit leaves one half of it as it is, so each word goes on under two keys
that hold more of it. A key with a hole of one character joins what is left, and there hardly a candidate is not near.
So candidates follow the words, however many share a segment, and no key's words are gathered in one place.

A pair meets under several keys if its edit can be seen at several places, as one of equal neighbours. It counts
only under the key whose hole holds the first character in which the two words differ, so each pair is made
once, without gathering pairs to tell them apart. Keys are 64-bit hashes; candidates are verified by their characters.

Words and pairs are ordinary DataFrames: partial counts before each shuffle, SQL functions throughout.

Defined results: null texts have no words; rows that repeat a document count each time; a null doc_id is written as an empty
string in the hash that decides about damage. No words give no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._rows import checkpointed, matched

LEAST_LENGTH = 7
LEAST_COUNT = 2
TIMES = 10
MOST_CANDIDATES = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def damaged(word: Column, doc_id: Column, one_in: int = 31) -> Column:
    """The word, without one character where a hash of document and word says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.char_length(word).cast("long")).cast("int")
    cut = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))
    return F.when(F.pmod(h, F.lit(one_in)) == 0, cut).otherwise(word)


def counted_words(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_in: int = 31) -> DataFrame:
    """(word, n): words of at least `least_length` characters that occur at least `least_count` times."""
    # a shorter run gives no word that is long enough
    runs = F.regexp_extract_all("text", F.lit(f"[A-Za-zÀ-ÿ]{{{least_length},}}"), F.lit(0))
    each = docs.select(F.col("doc_id").alias("doc"), F.explode(runs).alias("run"))
    words = each.select(damaged(F.translate("run", UPPER, LOWER), F.col("doc"), one_in).alias("word"))
    counts = words.where(F.char_length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least_count)


def _key(longer: Column, low: Column, high: Column) -> Column:
    """The key of a word with the hole [low, high) in the shorter word's characters; `longer` is 1 for words one longer."""
    size = F.char_length("word") - longer
    before = F.substring(F.col("word"), F.lit(1), low)
    behind = F.substring(F.col("word"), high + longer + 1, size)
    return F.xxhash64(size, low, high, before, behind)


def _holed(words: DataFrame, holes: list[tuple[Column, Column]]) -> DataFrame:
    """words (word, n, longer) with each of the holes (low, high) and its key."""
    each = words.withColumn("hole", F.explode(F.array(*[F.struct(low.cast("int").alias("low"), high.cast("int").alias("high")) for low, high in holes])))
    each = each.select("word", "n", "longer", F.col("hole.low").alias("low"), F.col("hole.high").alias("high"))
    return each.withColumn("key", _key(F.col("longer"), F.col("low"), F.col("high")))


def _near(keyed: DataFrame) -> DataFrame:
    """(word, n, other, other_n) of near words among those that share a key, each pair once."""
    short = keyed.where("longer = 0").select("key", "low", "high", "word", "n")
    other = keyed.select("key", F.col("low").alias("other_low"), F.col("high").alias("other_high"), "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
    both = matched(short, other, "key").where("low = other_low and high = other_high and char_length(other) = char_length(word) + longer and (longer = 1 or word < other)")
    part = lambda word, at, size: F.substring(F.col(word), at, size)
    same = (part("word", F.lit(1), F.col("low")) == part("other", F.lit(1), F.col("low"))) & (
        part("word", F.col("high") + 1, F.char_length("word")) == part("other", F.col("high") + F.col("longer") + 1, F.char_length("other"))
    )
    # of the places at which a character may have come in, the first counts: in the hole, or at the end of all
    first = (F.col("longer") == 0) | (F.col("high") == F.char_length("word")) | (part("word", F.lit(1), F.col("high")) != part("other", F.lit(1), F.col("high")))
    return both.where(same & first & (F.levenshtein("word", "other", 1) == 1)).select("word", "n", "other", "other_n")


def near_pairs(words: DataFrame, most: int = MOST_CANDIDATES, least_length: int = LEAST_LENGTH) -> DataFrame:
    """(word, n, other, other_n): pairs of words (word, n) that differ by one edit, each once; words are distinct and not null."""
    kinds = words.select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("longer")).where(F.char_length("word") - F.col("longer") >= least_length)
    size = F.char_length("word") - F.col("longer")
    half = F.floor(size / 2)
    keyed = _holed(kinds, [(half, size), (F.lit(0), half)])
    out = None
    while True:
        own, ones = F.count_if(F.col("longer") == 0), F.count_if(F.col("longer") == 1)
        cost = own * (own - 1) / 2 + own * ones
        keys = keyed.groupBy("key").agg(cost.alias("cost"), F.max(F.col("high") - F.col("low")).alias("wide")).where("cost > 0")
        told = matched(keyed, keys.select("key", ((F.col("cost") > most) & (F.col("wide") > 1)).alias("again")), "key")
        told = checkpointed(told)
        pairs = _near(told.where("not again").drop("again"))
        out = pairs if out is None else out.unionByName(pairs)
        again = told.where("again").select("word", "n", "longer", "low", "high")
        if again.isEmpty():
            return out
        middle = F.floor((F.col("low") + F.col("high")) / 2)
        # a hash that two holes share may bring one of a single character here; it stays as it is
        whole = F.col("high") - F.col("low") <= 1
        halves = _holed(again.where(~whole), [(middle, F.col("high")), (F.col("low"), middle)])
        keyed = halves.unionByName(_holed(again.where(whole), [(F.col("low"), F.col("high"))]))


def forms(words: DataFrame, pairs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, n, n_near, form, form_n): of a word's near words the most frequent one, the first of equal ones, if it is `times` as frequent."""
    ends = F.array(F.struct("word", F.col("other"), F.col("other_n")), F.struct(F.col("other").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    each = pairs.select(F.explode(ends).alias("e")).select("e.*")
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    found = words.join(best, "word", "left")
    is_form = -F.col("best.less") >= times * F.col("n")
    return found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))


def rooted(found: DataFrame, times: int = TIMES) -> DataFrame:
    """forms' rows with `root`, the last word that the forms lead to; found must not change when it is read again.

    Each form is `times` as frequent as its word, so a way is not longer than a logarithm of the largest count, and each
    round doubles what is known of it.
    """
    up = found.where("form is not null").select("word", F.col("form").alias("root"))
    (most,) = found.agg(F.max("n")).first()
    steps = int(math.log(max(most or 1, 1), times)) + 1
    while steps > 1:
        further = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = checkpointed(_left(up, further).select("word", F.coalesce("further", "root").alias("root")))
        steps = -(-steps // 2)
    return found.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))


def _left(up: DataFrame, further: DataFrame) -> DataFrame:
    return matched(up, further, "root", "left")


def variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, times: int = TIMES, one_in: int = 31, most: int = MOST_CANDIDATES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of all words of docs."""
    words = checkpointed(counted_words(docs, least_length, least_count, one_in))
    found = checkpointed(forms(words, near_pairs(words, most, least_length), times))
    return rooted(found, times)
