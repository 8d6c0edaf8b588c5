"""Removal of byte strings that stand more than once, by enhanced suffix arrays.

Transport. A string of `length` bytes has an anchor, the GRAM consecutive bytes in it with the smallest
hash. Consecutive strings whose anchor stands at the same place form one segment of text, which
travels to its anchor's bucket (about three bytes for each byte of text, compressed). Equal strings
have equal anchors, so all occurrences of a string meet in one bucket, each in its context. Equal
segments of a block of documents are reduced to one, marked as repeated, before the shuffle. A task takes
its buckets one after another. Strings that are frequent in the corpus become anchors only where there
is no other (see `_frequent`), so a stock phrase does not draw its surroundings into one bucket.

Repeats. In a bucket, the distinct segments that share an anchor with another are concatenated and
an enhanced suffix array is built over them: suffixes in order (prefix doubling; a segment's
end sorts first) and the longest common prefixes of neighbours. A stack scan over the prefix lengths
visits the intervals of the common-prefix tree. An interval at depth `length` or more whose suffixes
have different bytes before them (or start a segment) cannot be extended to the left: it is a maximal
repeat, and it is reported with all its occurrences. Repeats whose suffixes all have the same byte
before them are part of a longer one, and are skipped.

Every byte of every occurrence is removed, first ones included; what is repeated is judged on
the input. Strings never cross documents. Texts are UTF-8 bytes; a cut may fall inside a character,
so what is kept is binary.

Defined results: null or empty text, or text shorter than `length`, loses nothing; rows that repeat
doc_id and text are one document, whose strings do not count as standing elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _frequent
from millrace.llm import _kernel as K
from millrace.llm._rows import block_bytes, buckets, checkpointed, dealt, keyed

LENGTH = 200
GRAM = 16
BLOCK_BYTES = 8 << 20
ARRAY_BYTES = 1 << 20

PACKED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
SPANS = pa.schema([("_id", pa.int64()), ("_crc", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
REPEATS = pa.schema([("repeat", pa.int64()), ("length", pa.int32()), ("_id", pa.int64()), ("_crc", pa.int64()), ("start", pa.int32())])


def _grams(buf: np.ndarray) -> np.ndarray:
    at = np.arange(max(0, len(buf) - GRAM + 1))
    return K.byte_spans(buf, at, at + GRAM)


def _segments(texts: list[bytes], length: int, frequent: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The chunk's bytes, and by segment: document, first byte in it, first and past byte in the chunk, anchor hash."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    blob = b"".join(texts)
    none = np.empty(0, np.int64)
    if len(blob) < length:
        return blob, none, none, none, none, np.empty(0, K.U64)
    buf = np.frombuffer(blob, np.uint8)
    grams = _grams(buf)
    low = K.leftmost_min(_frequent.ordered(grams, frequent), length - GRAM + 1)
    first = np.cumsum(sizes) - sizes
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = np.flatnonzero(doc[: len(low)] == doc[length - 1 :])
    if not len(inside):
        return blob, none, none, none, none, np.empty(0, K.U64)
    s, e = K.runs(low[inside], doc[inside])
    left, right = inside[s], inside[e - 1] + length
    return blob, doc[left], left - first[doc[left]], left, right, grams[low[left]]


def _packer(length: int, n_buckets: int, frequent: bytes):
    most = block_bytes(n_buckets, BLOCK_BYTES)

    def flush(rows: list[tuple[int, int, bytes]], ranked: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = list(dict.fromkeys(rows))
        table: dict[bytes, int] = {}
        anchors, which, ids, crcs, starts = [], [], [], [], []
        at = 0
        while at < len(rows):
            part, size = [], 0
            while at < len(rows) and (not part or size + len(rows[at][2]) <= K.CHUNK_BYTES):
                part.append(rows[at])
                size += len(rows[at][2])
                at += 1
            blob, doc, start, left, right, anchor = _segments([t for _, _, t in part], length, ranked)
            before = len(table)
            own = [table.setdefault(blob[a:b], len(table)) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
            own = np.array(own, np.int64)
            new, first = np.unique(own, return_index=True)
            anchors.append(anchor[first[new >= before]])
            which.append(own)
            ids.append(np.array([r[0] for r in part], np.int64)[doc])
            crcs.append(np.array([r[1] for r in part], np.int64)[doc])
            starts.append(start.astype(np.int32))
        if not table:
            return
        anchor, own, id_, crc, start = (np.concatenate(x) for x in (anchors, which, ids, crcs, starts))
        strings = list(table)
        bucket = (anchor % K.U64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        holders = np.argsort(rank[own], kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        held = np.searchsorted(rank[own][holders], edges)
        numbers, payloads = [], []
        for b in range(n_buckets):
            if edges[b] == edges[b + 1]:
                continue
            these, h = order[edges[b] : edges[b + 1]], holders[held[b] : held[b + 1]]
            texts = [strings[i] for i in these.tolist()]
            numbers.append(b)
            payloads.append(K.pack(b"".join(texts), np.fromiter(map(len, texts), np.int32, len(texts)), anchor[these], (rank[own[h]] - edges[b]).astype(np.int32), id_[h], crc[h].astype(np.uint32), start[h]))
        yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(payloads, pa.binary())], schema=PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        ranked = _frequent.unpacked(frequent)
        size = 0
        for batch in K.sliced(batches, "text"):
            texts = K.texts_of(batch.column("text"))
            rows += zip(batch.column("_id").to_pylist(), batch.column("_crc").to_pylist(), texts, strict=True)
            size += sum(map(len, texts))
            if size >= most:
                yield from flush(rows, ranked)
                rows, size = [], 0
        yield from flush(rows, ranked)

    return run


class SuffixArray:
    """Suffixes of several strings in order, and common prefixes of neighbours; strings never join up."""

    STEP = 7  # bytes in a first key, nine bits each, none sorting before all

    def __init__(self, blob: bytes, lengths: np.ndarray):
        depth = int(lengths.max())
        self.buf = buf = np.frombuffer(blob, np.uint8)
        n = len(buf)
        ends = np.repeat(np.cumsum(lengths), lengths)
        self.rest = ends - np.arange(n)
        self.start = self.rest == np.repeat(lengths, lengths)
        key = np.zeros(n, np.int64)
        padded = np.concatenate([buf.astype(np.int64) + 1, np.zeros(self.STEP, np.int64)])
        for k in range(self.STEP):
            key = (key << 9) | np.where(self.rest > k, padded[k : k + n], 0)
        self.levels: list[tuple[int, np.ndarray]] = []
        reach = self.STEP
        while True:
            self.order = np.argsort(key)
            ordered = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.concatenate([[0], ordered[1:] != ordered[:-1]]))
            self.levels.append((reach, rank.astype(np.int32)))
            if reach >= depth or rank[self.order[-1]] == n - 1:
                break
            later = np.minimum(np.arange(n) + reach, n - 1)
            key = rank * (n + 1) + np.where(self.rest > reach, rank[later] + 1, 0)
            reach *= 2

    def common(self, at_least: int) -> np.ndarray:
        """Common prefix of each suffix with the one before it in order; 0 if below `at_least`."""
        out = np.zeros(len(self.order), np.int32)
        able = self.rest[self.order] >= at_least
        pairs = 1 + np.flatnonzero(able[1:] & able[:-1])
        reach, rank = max((x for x in self.levels if x[0] <= at_least), key=lambda x: x[0])
        p, q = self.order[pairs - 1], self.order[pairs]
        same = rank[p] == rank[q]
        pairs, p, q = pairs[same], p[same], q[same]
        most = np.minimum(self.rest[p], self.rest[q])
        size = np.zeros(len(pairs), np.int64)
        last = len(self.buf) - 1
        for reach, rank in [self.levels[-1], *reversed(self.levels)]:
            go = (size < most) & (rank[np.minimum(p + size, last)] == rank[np.minimum(q + size, last)])
            size = np.minimum(size + reach * go, most)
        for _ in range(self.STEP - 1):
            go = (size < most) & (self.buf[np.minimum(p + size, last)] == self.buf[np.minimum(q + size, last)])
            size += go
        out[pairs] = np.where(size >= at_least, size, 0)
        return out


def maximal_repeats(array: SuffixArray, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(common length, places) of each interval of the common-prefix tree that is maximal and deep enough."""
    common = array.common(length)
    order = array.order
    before = np.where(array.start[order], -1 - np.arange(len(order)), array.buf[order - 1].astype(np.int64))
    turns = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    deep = common > 0
    edge = np.diff(np.concatenate([[False], deep, [False]]).astype(np.int8))
    for lo, hi in zip((np.flatnonzero(edge == 1) - 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
        if turns[hi - 1] == turns[lo]:
            continue  # every part of the interval extends to the left
        values = common[lo + 1 : hi].tolist()
        stack: list[tuple[int, int]] = []  # (depth, leftmost suffix)
        for i, depth in enumerate([*values, 0], lo):
            left = i
            while stack and stack[-1][0] > depth:
                had, left = stack.pop()
                if turns[i] != turns[left]:
                    yield had, order[left : i + 1]
            if depth and (not stack or stack[-1][0] < depth):
                stack.append((depth, left))


def merged(ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """One row per document: the union of its spans."""
    order = np.lexsort((starts, crcs, ids))
    ids, crcs, starts, ends = ids[order], crcs[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    s, e = K.runs(ids, crcs)
    shift = np.repeat(np.arange(len(s)), e - s) << 33
    reach = np.maximum.accumulate(ends + shift)
    new = np.ones(len(ids), bool)
    new[1:] = starts[1:] + shift[1:] > reach[:-1]
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(ids)) - 1
    d, _ = K.runs(ids[a], crcs[a])
    offsets = pa.array(np.append(d, len(a)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (starts[a], reach[b] - shift[b])]
    return pa.RecordBatch.from_arrays([pa.array(ids[a][d]), pa.array(crcs[a][d]), *lists], schema=SPANS)


class _Bucket:
    """The distinct segments of a bucket, and who holds them."""

    def __init__(self, payloads: Iterable[pa.Buffer]):
        table: dict[bytes, int] = {}
        anchors, owns, ids, crcs, starts = [], [], [], [], []
        for payload in payloads:
            blob, lengths, anchor, own, id_, crc, start = K.unpack(payload)
            ends = np.cumsum(lengths)
            before = len(table)
            index = np.array([table.setdefault(blob[a:b], len(table)) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)], np.int64)
            anchors.append(anchor[index >= before])
            owns.append(index[own])
            ids.append(id_)
            crcs.append(crc.astype(np.int64))
            starts.append(start)
        self.strings = list(table)
        if not self.strings:
            return
        self.anchor, own, id_, crc, start = (np.concatenate(x) for x in (anchors, owns, ids, crcs, starts))
        order = np.lexsort((start, crc, id_, own))
        s, _ = K.runs(own[order], id_[order], crc[order], start[order])  # a place read twice is one place
        order = order[s]
        self.own, self.id, self.crc, self.start = own[order], id_[order], crc[order], start[order].astype(np.int64)
        self.first = np.searchsorted(self.own, np.arange(len(self.strings) + 1))
        self.lengths = np.fromiter(map(len, self.strings), np.int64, len(self.strings))
        self.multi = np.diff(self.first) > 1

    def batches(self) -> Iterator[np.ndarray]:
        """Segments that share an anchor with a different one, by whole anchors, in batches of bounded bytes."""
        order = np.argsort(self.anchor, kind="stable")
        s, e = K.runs(self.anchor[order])
        some, size = [], 0
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            if b - a > 1:
                some.append(order[a:b])
                size += int(self.lengths[order[a:b]].sum())
                if size >= ARRAY_BYTES:
                    yield np.concatenate(some)
                    some, size = [], 0
        if some:
            yield np.concatenate(some)

    def repeats(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(common length, segments, places in them) of each maximal repeat; a segment held twice is one itself."""
        for batch in self.batches():
            array = SuffixArray(b"".join([self.strings[i] for i in batch.tolist()]), self.lengths[batch])
            ends = np.cumsum(self.lengths[batch])
            for depth, places in maximal_repeats(array, length):
                which = np.searchsorted(ends, places, side="right")
                yield depth, batch[which], places - (ends - self.lengths[batch])[which]
        for i in np.flatnonzero(self.multi).tolist():
            yield int(self.lengths[i]), np.array([i]), np.array([0])

    def covered(self, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(segments, starts, ends): the stretches of segments that maximal repeats cover, a batch at a time."""
        for batch in self.batches():
            sizes = self.lengths[batch]
            base = np.cumsum(sizes) - sizes
            array = SuffixArray(b"".join([self.strings[i] for i in batch.tolist()]), sizes)
            depth = np.zeros(int(sizes.sum()) + 1, np.int32)
            for common, places in maximal_repeats(array, length):
                np.add.at(depth, places, 1)
                np.add.at(depth, places + common, -1)
            del array
            inside = np.concatenate([[False], np.cumsum(depth[:-1], dtype=np.int32) > 0, [False]])
            cut = np.zeros(len(depth), bool)
            cut[base] = True
            now, was = inside[1:], inside[:-1]
            s, e = np.flatnonzero(now & (~was | cut)), np.flatnonzero(was & (~now | cut))
            if len(s):
                which = np.searchsorted(base, s, side="right") - 1
                yield batch[which], s - base[which], e - base[which]
        whole = np.flatnonzero(self.multi)
        if len(whole):
            yield whole, np.zeros(len(whole), np.int64), self.lengths[whole]

    def held(self, segments: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The documents, and places in them, that hold these places of segments."""
        n = self.first[segments + 1] - self.first[segments]
        at = K.ranges(self.first[segments], n)
        return self.id[at], self.crc[at], self.start[at] + np.repeat(places, n)


def _finder(length: int, groups: bool):
    def found(bucket: _Bucket) -> Iterator[pa.RecordBatch]:
        if groups:
            for depth, segments, places in bucket.repeats(length):
                ids, crcs, starts = bucket.held(segments, places)
                text = bucket.strings[segments[0]][places[0] : places[0] + depth]
                name = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "big") >> 1
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), pa.array([depth] * len(ids), pa.int32()), pa.array(ids), pa.array(crcs), pa.array(starts.astype(np.int32))], schema=REPEATS)
            return
        for segments, starts, ends in bucket.covered(length):
            n = bucket.first[segments + 1] - bucket.first[segments]
            at = K.ranges(bucket.first[segments], n)
            yield merged(bucket.id[at], bucket.crc[at], bucket.start[at] + np.repeat(starts, n), bucket.start[at] + np.repeat(ends, n))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payloads in K.buckets_of(batches):
            yield from found(_Bucket(payloads))

    return run


def _found(docs: DataFrame, length: int, groups: bool, ddl: str) -> DataFrame:
    rows = keyed(docs).select("_id", "_crc", "text")
    frequent = _frequent.frequent(rows.select("_id", "text"), lambda t: _grams(np.frombuffer(t, np.uint8)))
    packed = rows.mapInArrow(_packer(length, buckets(docs.sparkSession), frequent), "bucket int, payload binary")
    return dealt(packed).mapInArrow(_finder(length, groups), ddl)


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(repeat, length, _id, _crc, start): every occurrence in the corpus of every maximal repeat.

    A segment shows a long repeat in part. Repeats of neighbouring segments overlap and have the same
    occurrences, moved by as many bytes in all of them; such repeats are known by their first occurrence's document,
    their number and the sum of their occurrences' hashes relative to the first, and are joined to one. A repeat
    that goes on, at one end, in a repeat with more occurrences is given as far as the segment in which they part.
    """
    found = checkpointed(_found(docs, length, True, "repeat long, length int, _id long, _crc long, start int").distinct())
    key = ["repeat", "length"]
    first = found.groupBy(*key).agg(F.min(F.struct("_id", "_crc", "start")).alias("d"))
    moved = F.xxhash64("_id", "_crc", F.col("start") - F.col("d.start")).cast("decimal(38,0)")
    groups = found.join(first, key).groupBy(*key).agg(F.min("d").alias("d"), F.count("*").alias("n"), F.sum(moved).alias("shape"))
    groups = groups.select(*key, F.col("d._id").alias("i"), F.col("d._crc").alias("c"), F.col("d.start").alias("low"), (F.col("d.start") + F.col("length")).alias("high"), "n", "shape")
    same = ["i", "c", "n", "shape"]
    w = Window.partitionBy(*same).orderBy("low", "length", "repeat")
    before = F.max("high").over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = groups.withColumn("new", F.when(F.col("low") <= before, 0).otherwise(1)).withColumn("chain", F.sum("new").over(w))
    chains = cut.groupBy(*same, "chain").agg(F.min(F.struct("low", "length", "repeat")).alias("k"), F.max("high").alias("high"))
    names = chains.select("k.repeat", "k.length", F.xxhash64(*same, "chain").alias("name"), (F.col("high") - F.col("k.low")).cast("int").alias("whole"))
    return found.join(names, key).select(F.col("name").alias("repeat"), F.col("whole").alias("length"), "_id", "_crc", "start")


def repeated_bytes(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(_id, _crc, starts, ends): spans of bytes that repeated strings cover; lists may overlap."""
    found = _found(docs, length, False, "_id long, _crc long, starts array<int>, ends array<int>")
    return found.groupBy("_id", "_crc").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in K.sliced(batches, "text"):
        rows = []
        for text, starts, ends in zip(K.texts_of(batch.column("text")), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            spans: list[list[int]] = []
            for s, e in sorted(zip(starts, ends, strict=True)) if starts else ():
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], e)
                else:
                    spans.append([s, e])
            edges = [0, *(x for span in spans for x in span), len(text)]
            kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            rows.append((len(text), len(text) - len(kept), len(spans), kept))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(_KEPT)[1:], strict=True))], schema=_KEPT)


def dedup_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary)."""
    spans = repeated_bytes(docs, length)
    both = keyed(docs).join(spans.hint("shuffle_hash"), ["_id", "_crc"], "left").select("doc_id", "text", "starts", "ends")
    return both.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
