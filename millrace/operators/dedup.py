"""Near-duplicate removal: shingles, MinHash signatures, bands, greedy removal."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import files
from millrace.functions.checkpoints import checkpointed, stored
from millrace.functions.components import components
from millrace.functions.joins import matched
from millrace.functions.text import let, words

try:  # twice as fast for a shingle's few bytes, where Python has it
    from _md5 import md5
except ImportError:
    from hashlib import md5

PRIME = (1 << 61) - 1
PERMUTATIONS, BANDS, SHINGLE = 128, 16, 5
SLICE = 256  # documents whose hashes are in a task's memory at once


def coefficients(n: int = PERMUTATIONS, seed: int = 42) -> list[tuple[int, int]]:
    """(a, b) of each permutation, from a linear congruential generator of 31 bits."""
    draws, x = [], seed
    for _ in range(2 * n):
        x = (1103515245 * x + 12345) % (1 << 31)
        draws.append(x)
    return [(a | 1, b) for a, b in zip(draws[::2], draws[1::2], strict=True)]


def shingles(text: Column, n: int = SHINGLE) -> Column:
    """Distinct 32-bit hashes of each n words; of the whole text in lower case if it has fewer."""
    first32 = lambda s: F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("long")
    each = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: first32(F.array_join(F.slice(w, i, n), " ")))
    return F.array_distinct(let(words(text), lambda w: F.when(F.size(w) >= n, each(w)).otherwise(F.array(first32(F.lower(text))))))


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Signatures of the stretches of values that begin at starts. Products stay below 2 ** 63, so 64-bit integers are exact."""
    out = np.empty((len(starts), PERMUTATIONS), np.int64)
    x, high = np.empty_like(values), np.empty_like(values)
    for k, (a, b) in enumerate(coefficients()):
        np.multiply(values, a, out=x)
        x += b
        np.right_shift(x, 61, out=high)
        x &= PRIME
        x += high  # the remainder, or more than it by PRIME
        if x.max() >= PRIME:
            x[x >= PRIME] -= PRIME
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def _arrays(column: pa.Array, sets: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(counts)
    sig = np.zeros((len(sets), PERMUTATIONS), np.int64)
    if len(full):
        sig[full] = _minima(np.concatenate(sets), (np.cumsum(counts) - counts)[full])
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * PERMUTATIONS, pa.int32()), pa.array(sig.ravel()))
    return pa.RecordBatch.from_arrays([column, lists], names=names)


def signatures(sets: DataFrame, order: str = "ord", shingle_set: str = "s") -> DataFrame:
    """(order, sig): MinHash signatures of sets of hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                values = [np.array(x.values if x.is_valid else [], np.int64) for x in part.column(shingle_set)]
                yield _arrays(part.column(order), values, [order, "sig"])

    return sets.select(F.col(order).cast("long"), shingle_set).mapInArrow(run, f"{order} long, sig array<long>")


def text_signatures(docs: DataFrame, order: str, text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(ord, sig): signatures(shingles(text)) in one pass over the texts, in which no set leaves its task."""
    plain = re.compile(rb"[A-Za-z0-9_]+").findall

    def hashes(low: str, find) -> np.ndarray:
        raw = low.encode()
        words = plain(raw) if low.isascii() else [w.encode() for w in find(low)]
        if len(words) < n:
            each = [md5(raw).digest()[:4]]
        else:
            joined = b" ".join(words)  # a shingle is a stretch of it
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1).tolist()
            each = [md5(joined[s : e - 1]).digest()[:4] for s, e in zip([0, *ends], ends[n - 1 :], strict=False)]
        return np.unique(np.frombuffer(b"".join(each), ">u4")).astype(np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(r"[\p{L}\p{N}_]+").findall
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                yield _arrays(part.column("ord"), [hashes(t, find) if t is not None else np.empty(0, np.int64) for t in part.column("low").to_pylist()], ["ord", "sig"])

    return docs.select(F.col(order).cast("long").alias("ord"), F.lower(text).alias("low")).mapInArrow(run, "ord long, sig array<long>")


def bands(sig: Column, n: int = BANDS, rows: int = PERMUTATIONS // BANDS) -> Column:
    """The signature cut into bands; a band's values are its key."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.slice(sig, i * rows + 1, rows))


def band_rows(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """(ord, band, key): one row for each document and band."""
    sig = text_signatures(docs, order)
    return sig.select("ord", F.posexplode(bands(F.col("sig"))).alias("band", "key")).select("ord", "band", F.xxhash64("key").alias("key"))


ROUNDS = 6  # of the fixpoint before what is open is cut into components
COMPONENT = 1_000_000  # rows of a component that one task decides


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ord, keep) of rows sorted by (root, ord): each component's documents in order, one component after another."""
    root = doc = None
    taken: set[tuple[int, int]] = set()
    own: list[tuple[int, int]] = []
    out: list[tuple[int, bool]] = []

    def decide() -> None:
        keep = taken.isdisjoint(own)
        if keep:
            taken.update(own)
        out.append((doc, keep))
        own.clear()

    for batch in batches:
        for r, d, band, key in zip(*(batch.column(c).to_pylist() for c in ("root", "ord", "band", "key")), strict=True):
            if (r, d) != (root, doc):
                if own:
                    decide()
                if r != root:
                    taken.clear()
                root, doc = r, d
            own.append((band, key))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], names=["ord", "keep"])
        out.clear()
    if own:
        decide()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.bool_())], names=["ord", "keep"])


def _by_component(open_: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Open rows (ord, band, key): (ord, keep) of those in components of up to `most` rows, and the rows of larger ones."""
    first = open_.groupBy("band", "key").agg(F.min("ord").alias("first"))
    edges = matched(open_.withColumn("bucket", F.struct("band", "key")), first.select(F.struct("band", "key").alias("bucket"), "first"), "bucket")
    roots = components(edges.select(F.col("ord").alias("a"), F.col("first").alias("b")))
    rows = open_.join(roots.withColumnRenamed("node", "ord"), "ord", "left").withColumn("root", F.coalesce("root", "ord"))
    sizes = rows.groupBy("root").agg((F.count("*") > most).alias("large"))
    told = checkpointed(matched(rows, sizes, "root"))
    small = told.where("not large").select("root", "ord", "band", "key").repartition("root").sortWithinPartitions("root", "ord")
    return small.mapInArrow(_in_order, "ord long, keep boolean"), told.where("large").select("ord", "band", "key")


def greedy_kept(rows: DataFrame, rounds: int = ROUNDS, component: int = COMPONENT) -> DataFrame:
    """(ord) kept when documents are taken in order and one that shares a band with a kept one is dropped.

    Each round keeps every undecided document that comes first in all of its bands, then drops those that
    share a band with a kept one. Rounds are linear in the rows; no pairs are made. Buckets of one
    document can decide nothing and are left out at once.

    A round decides one link of a chain of documents. So after `rounds` rounds what is open is cut into its connected
    components, which decide nothing about each other; those of up to `component` rows are each decided
    in order by one task, and only larger ones go on in rounds.
    """
    rows = checkpointed(rows)
    everyone = rows.select("ord").distinct()
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key")
    open_ = checkpointed(rows.join(shared, ["band", "key"]).select("ord", "band", "key"))
    dropped, done, path = None, 0, None
    while not open_.isEmpty():
        if done and done % rounds == 0:
            decided, open_ = _by_component(open_, component)
            gone = checkpointed(decided.where("not keep").select("ord"))
            dropped = gone if dropped is None else dropped.unionByName(gone)
            if open_.isEmpty():
                break
        done += 1
        first = open_.groupBy("band", "key").agg(F.min("ord").alias("first"))
        marked = open_.join(first, ["band", "key"])
        keep = marked.groupBy("ord").agg(F.min((F.col("ord") == F.col("first")).cast("int")).alias("all_first")).where("all_first = 1").select("ord")
        taken = open_.join(keep, "ord", "left_semi").select("band", "key").distinct()
        drop = open_.join(taken, ["band", "key"], "left_semi").join(keep, "ord", "left_anti").select("ord").distinct()
        # one table a round: rows that stay open, and documents that are dropped
        decided = keep.withColumn("dropped", F.lit(False)).unionByName(drop.withColumn("dropped", F.lit(True)))
        before = path
        told, path = stored(open_.join(decided, "ord", "left").where("dropped is null or dropped"), "greedy")
        if before:
            files.delete(rows.sparkSession, before)
        gone = checkpointed(told.where("dropped").select("ord").distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        open_ = told.where("dropped is null").drop("dropped")
    if path:
        files.delete(rows.sparkSession, path)
    return everyone if dropped is None else everyone.join(dropped, "ord", "left_anti")


def deduplicate(docs: DataFrame, order: str = "doc_id") -> DataFrame:
    """docs without near-duplicates of an earlier kept document."""
    kept = greedy_kept(band_rows(docs, order)).withColumnRenamed("ord", order)
    return docs.join(kept, order, "left_semi")
