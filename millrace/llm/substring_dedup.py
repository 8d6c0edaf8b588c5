"""Substring de-duplication by super-k-mer partitioning.

A window is `window` consecutive words of one document. Every window has a minimiser, the `gram`
consecutive words in it with the smallest hash. Consecutive windows whose minimiser stands at the
same place form a super-k-mer; it travels as one packed string of words to the bucket of its
minimiser, so each word is shipped about three times instead of `window` times. Equal windows have
equal minimisers and meet in one bucket, where sorting their 128-bit fingerprints finds each
window's first place exactly; all later places are marked.

Before anything is shuffled, equal super-k-mers of one block of documents are reduced to the first
of them (the others are later repeats whatever the rest of the corpus holds), so a passage that
stands in a third of all documents costs its bucket one string per block. A task takes its buckets one
after another, keeps one row per distinct window of one and compacts as it reads; copies never pile up
in it. Grams that are frequent in the corpus become minimisers only where a window has no other (see
`_frequent`), so a stock phrase does not draw its surroundings in all documents into one bucket.

Defined results: null or empty text has no words and loses nothing; fewer words than `window` lose
nothing; rows that repeat doc_id and text are one document; a null doc_id comes first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _frequent
from millrace.llm import _kernel as K
from millrace.llm._rows import block_bytes, buckets, dealt, keyed

WINDOW = 20
GRAM = 3
BLOCK_BYTES = 16 << 20
COMPACT = 2_000_000

PACKED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
SPANS = pa.schema([("_id", pa.int64()), ("_crc", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


class _Block:
    """Super-k-mers of a block of documents by bucket, and the repeats that the block itself shows."""

    def __init__(self, window: int, gram: int, n_buckets: int, frequent: bytes):
        self.window, self.gram, self.n_buckets = window, gram, n_buckets
        self.frequent = _frequent.unpacked(frequent)
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple[int, int, bytes]] = []
        self.bytes = 0

    def add(self, rows: Iterable[tuple[int, int, bytes]], n: int) -> None:
        self.rows.extend(rows)
        self.bytes += n

    def flush(self) -> Iterator[pa.RecordBatch]:
        """The block's documents are taken in key order, so the first of equal strings is the earliest."""
        docs = sorted(set(self.rows), key=lambda r: r[:2])
        self.clear()
        seen: dict[bytes, tuple[int, int]] = {}
        by: dict[int, list] = {}
        at = 0
        while at < len(docs):
            part, size = [], 0
            while at < len(docs) and (not part or size + len(docs[at][2]) <= K.CHUNK_BYTES):
                part.append(docs[at])
                size += len(docs[at][2])
                at += 1
            self._cut(part, seen, by)
        buckets_, payloads = [], []
        for b, (ids, crcs, starts, strings, known) in by.items():
            buckets_.append(b)
            payloads.append(K.pack(np.array(ids, np.int64), np.array(crcs, np.int64), np.array(starts, np.int32), b"\n".join(strings), np.array(known, bool)))
        if buckets_:
            yield pa.RecordBatch.from_arrays([pa.array(buckets_, pa.int32()), pa.array(payloads, pa.binary())], schema=PACKED)

    def _cut(self, part: list[tuple[int, int, bytes]], seen: dict, by: dict) -> None:
        words = K.Words([t.split() for _, _, t in part])
        n = len(words) - self.window + 1
        if n <= 0:
            return
        doc = words.doc()
        mins = K.grams(words.hashes(), self.gram)
        low = K.leftmost_min(_frequent.ordered(mins, self.frequent), self.window - self.gram + 1)
        inside = doc[:n] == doc[self.window - 1 :]
        at = np.flatnonzero(inside)
        if not len(at):
            return
        s, e = K.runs(low[at], doc[at])
        first, last = at[s], at[e - 1]
        bucket = (mins[low[first]] % np.uint64(self.n_buckets)).astype(np.int64).tolist()
        left, right = words.starts[first].tolist(), words.ends[last + self.window - 1].tolist()
        owner, start, blob = doc[first].tolist(), (first - words.first[doc[first]]).tolist(), words.blob
        for b, lo, hi, d, at_word in zip(bucket, left, right, owner, start, strict=True):
            text = blob[lo:hi]
            ids, crcs, starts, strings, known = by.setdefault(b, ([], [], [], [], []))
            ids.append(part[d][0])
            crcs.append(part[d][1])
            starts.append(at_word)
            if text in seen:
                strings.append(b"%d" % (text.count(b" ") + 2 - self.window))
                known.append(True)
            else:
                seen[text] = part[d][:2]
                strings.append(text)
                known.append(False)


def _packer(window: int, gram: int, n_buckets: int, frequent: bytes):
    most = block_bytes(n_buckets, BLOCK_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(window, gram, n_buckets, frequent)
        for batch in K.sliced(batches, "text"):
            texts = K.texts_of(batch.column("text"))
            block.add(zip(batch.column("_id").to_pylist(), batch.column("_crc").to_pylist(), texts, strict=True), sum(map(len, texts)))
            if block.bytes >= most:
                yield from block.flush()
        yield from block.flush()

    return run


def _spans(ids: np.ndarray, crcs: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    """One row per document: its marked runs of windows [start, start + length)."""
    order = np.lexsort((starts, crcs, ids))
    ids, crcs, starts, lengths = ids[order], crcs[order], starts[order], lengths[order]
    ends = starts + lengths
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (crcs[1:] != crcs[:-1]) | (starts[1:] > ends[:-1])
    s = np.flatnonzero(new)
    e = np.append(s[1:], len(ids)) - 1
    d, _ = K.runs(ids[s], crcs[s])
    offsets = pa.array(np.append(d, len(s)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (starts[s], ends[e])]
    return pa.RecordBatch.from_arrays([pa.array(ids[s][d]), pa.array(crcs[s][d]), *lists], schema=SPANS)


def _counter(window: int):
    """Reads each bucket's packed strings, keeps the first place of each window and yields the others."""

    def windows(payload: pa.Buffer) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids, crcs, starts, blob, known = K.unpack(payload)
        strings = blob.split(b"\n")
        kept = [x for x, k in zip(strings, known.tolist(), strict=True) if not k]
        repeat = np.flatnonzero(known)
        lengths = np.array([int(strings[i]) for i in repeat], np.int64)
        marked = [ids[repeat], crcs[repeat], starts[repeat].astype(np.int64), lengths]
        if not kept:
            return marked, []
        fresh = np.flatnonzero(~known)
        words = K.Words([[x] for x in kept])
        counts = np.fromiter((x.count(b" ") + 1 for x in kept), np.int64, len(kept))
        first = np.cumsum(counts) - counts
        n = counts - window + 1
        at = K.ranges(first, n)
        hashes = words.hashes()
        one = K.span(K.prefix(hashes), at, at + window)
        two = K.span(K.prefix(K.mix(hashes + K.U64(0x632BE59BD9B4E019))), at, at + window)
        own = np.repeat(fresh, n)
        return marked, [one, two, ids[own], crcs[own], starts[own] + K.ranges(np.zeros(len(n), np.int64), n)]

    def compact(state: list[np.ndarray]) -> tuple[list[np.ndarray], pa.RecordBatch | None]:
        order = np.argsort(state[0], kind="stable")
        one = state[0][order]
        same = np.zeros(len(one), bool)
        same[1:] = one[1:] == one[:-1]
        group = same.copy()
        group[:-1] |= same[1:]
        many = order[group]
        single = order[~group]
        if not len(many):
            return state, None
        many = many[np.lexsort((state[4][many], state[3][many], state[2][many], state[1][many], state[0][many]))]
        first = np.ones(len(many), bool)
        first[1:] = (state[0][many][1:] != state[0][many][:-1]) | (state[1][many][1:] != state[1][many][:-1])
        rest = many[~first]
        keep = np.concatenate([single, many[first]])
        # a place read twice (rows that repeat doc_id and text) is one place
        head = many[np.maximum.accumulate(np.where(first, np.arange(len(many)), 0))][~first]
        rest = rest[(state[2][rest] != state[2][head]) | (state[3][rest] != state[3][head]) | (state[4][rest] != state[4][head])]
        out = _spans(state[2][rest], state[3][rest], state[4][rest], np.ones(len(rest), np.int64)) if len(rest) else None
        return [x[keep] for x in state], out

    def counted(payloads: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        state: list[np.ndarray] = []
        pending: list[list[np.ndarray]] = []
        waiting = kept = 0
        for payload in payloads:
            marked, fresh = windows(payload)
            if len(marked[0]):
                yield _spans(*marked)
            if fresh:
                pending.append(fresh)
                waiting += len(fresh[0])
            if waiting > max(COMPACT, kept // 2):
                state, out = compact([np.concatenate(x) for x in zip(*([state] if state else []), *pending, strict=True)])
                pending, waiting, kept = [], 0, len(state[0])
                if out is not None:
                    yield out
        if pending:
            state, out = compact([np.concatenate(x) for x in zip(*([state] if state else []), *pending, strict=True)])
            if out is not None:
                yield out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payloads in K.buckets_of(batches):
            yield from counted(payloads)

    return run


def _grams(gram: int):
    def hashes(text: bytes) -> np.ndarray:
        return K.grams(K.Words([text.split()]).hashes(), gram)

    return hashes


def repeated_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(_id, _crc, starts, ends): for each document, runs of windows that stand earlier elsewhere.

    A run [start, end) are window starts; lists of one document may overlap each other.
    """
    rows = keyed(docs).select("_id", "_crc", "text")
    frequent = _frequent.frequent(rows.select("_id", "text"), _grams(gram))
    packed = rows.mapInArrow(_packer(window, gram, buckets(docs.sparkSession), frequent), "bucket int, payload binary")
    found = dealt(packed).mapInArrow(_counter(window), "_id long, _crc long, starts array<int>, ends array<int>")
    return found.groupBy("_id", "_crc").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))


def _keeper(window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.sliced(batches, "text"):
            total, removed, kept = [], [], []
            for text, starts, ends in zip(K.texts_of(batch.column("text")), batch.column("starts").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                words = text.split()
                total.append(len(words))
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, np.array(ends) - 1 + window, -1)
                    words = [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist(), strict=True) if not c]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], schema=schema)

    return run


def dedup_substrings(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed and `kept`, the kept words joined by one space.

    A word goes if it is covered by a window whose words also start earlier: in a smaller doc_id, or
    in the same document before. Windows are judged on the input, not on what is left.
    """
    spans = repeated_windows(docs, window, gram)
    both = keyed(docs).join(spans.hint("shuffle_hash"), ["_id", "_crc"], "left").select("doc_id", "text", "starts", "ends")
    return both.mapInArrow(_keeper(window), "doc_id long, n_words long, n_removed long, kept string")
