"""Packing documents into sequences of one length, first-fit decreasing in randomised groups.

A document's ids are cut into whole sequences and a remainder. Whole sequences need no partner. Remainders
are dealt into groups of about GROUP_DOCS documents by a hash, so a group is a random sample of lengths and of
one size whatever the corpus. In a group they are taken from the longest to the shortest, and each goes into
the first sequence with room for it; a tournament tree over the sequences' room finds that one in logarithmic time.

What room is left after that is filled by cutting the pieces of the emptiest sequences. In the end a group has one
sequence that is not full; it is cut into sequences whose lengths are powers of two, which need no
padding. So there is no padding at all, at the price of at most one cut for each sequence and a dozen
short sequences a group.

Ids travel as 16-bit numbers (32-bit for larger vocabularies), compressed. Whole sequences of a long document travel in
rows of STRETCH sequences, each dealt by itself, so no document fills a group. Copies of a document
that stand in one partition are counted, and the count is part of the hash, so many copies spread, too. The hash depends on
what a partition holds and not on its order: a task that runs again deals its rows alike.

Defined results: null text is empty, and an empty document has one id, the end; each row of docs is packed, also one
that repeats another. A null doc_id stays null. No rows give no pieces. Other columns of docs are left out.
"""

from __future__ import annotations

import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _kernel as K
from millrace.llm._rows import dealt, keyed

LENGTH = 4096
END = 2
GROUP_DOCS = 2048
STRETCH = 32  # whole sequences in a row
SLICE_BYTES = 1 << 20  # of text that is encoded at once
KNOWN_WORDS = 800_000  # a worker's memory of encoded words; it is forgotten beyond that
SPACES = b" \t\n\r\x0b\x0c"

PARTS = pa.schema([("bucket", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("size", pa.int64()), ("ids", pa.binary())])
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
PIECES_DDL = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Words:
    """The tokenizer, applied to each distinct word between ASCII white space once.

    It must be one that drops white space and splits at it, so that a text's ids are its words' ids one after
    another. Where it also lower-cases ASCII letters, they are so before words are told apart, unless a special string may
    stand in the text; where it splits before a full stop or comma, a word with one takes over the ids of the word without.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        plain = lambda *words: [i for w in words for i in self.tokenizer.encode(w, add_special_tokens=False).ids]
        if plain("a b\n c") != plain("a", "b", "c"):
            raise ValueError(f"{path} does not drop the white space between words")
        self.lowers = plain("ABCXYZ q") == plain("abcxyz Q")
        self.cuts = [p for p in (b".", b",") if all(plain(f"{w}{p.decode()} x") == plain(w, p.decode(), "x") for w in ("ab", "b9"))]
        # words of small letters only, which nothing but merges changes: the model gives their ids directly
        self.direct = all(self._merged(w) == plain(w) for w in ("a", "the", "thinert", "ndnting", "zzqxjv"))
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.forget()

    def _merged(self, word: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(word)]

    def forget(self) -> None:
        self.known = _Index()
        self.flat, self.start, self.count = np.empty(0, "<u4"), np.empty(0, np.int64), np.empty(0, np.int64)

    def codes(self, text: bytes) -> np.ndarray:
        """The numbers of the text's words; new words get the next ones."""
        low = text.lower() if self.lowers else text
        words = (text if self.lowers and any(s in low for s in self.special) else low).split()
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        """Finds the ids of words that have got numbers; a full stop or comma behind a letter or digit has ids of its own."""
        new, known = self.known.new, self.known
        whole, stems, letters, found = [], [], [], []
        at = len(self.start)
        for w in new:  # stems that are new are added behind and come up later
            if w[-1:] in self.cuts and w[-2:-1].isalnum():
                stems.append((at, known[w[:-1]], known[w[-1:]]))
            elif self.direct and w.isascii() and w.isalpha() and w.islower():
                letters.append(at)
                found.append(self._merged(w.decode()))
            else:
                whole.append((at, w))
            at += 1
        self.start, self.count = (np.concatenate([x, np.zeros(at - len(x), np.int64)]) for x in (self.start, self.count))
        if letters:
            counts = np.fromiter(map(len, found), np.int64, len(found))
            self._add(np.array(letters), counts, np.fromiter(chain.from_iterable(found), "<u4", int(counts.sum())))
        for k in range(0, len(whole), 10_000):
            numbers, part = zip(*whole[k : k + 10_000], strict=True)
            # given as one text of many words, each is encoded by itself
            found = self.tokenizer.encode([w.decode("utf-8", "replace") for w in part], is_pretokenized=True, add_special_tokens=False)
            counts = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part))
            self._add(np.array(numbers), counts, np.array(found.ids, "<u4"))
        if stems:
            numbers, stem, tail = np.array(stems, np.int64).T
            first, more = self.count[stem], self.count[tail]
            ids, place = np.empty(int((first + more).sum()), "<u4"), np.cumsum(first + more) - first - more
            ids[K.ranges(place, first)] = self.flat[K.ranges(self.start[stem], first)]
            ids[K.ranges(place + first, more)] = self.flat[K.ranges(self.start[tail], more)]
            self._add(numbers, first + more, ids)
        new.clear()

    def _add(self, numbers: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.start[numbers] = len(self.flat) + np.cumsum(counts) - counts
        self.count[numbers] = counts
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[list[np.ndarray]] = [[] for _ in texts]
        parts = [(k, part) for k, text in enumerate(texts) for part in _slices(text)]
        at = 0
        while at < len(parts):
            if len(self.known) > KNOWN_WORDS:
                self.forget()
            size, codes, owners = 0, [], []
            while at < len(parts) and (not codes or size + len(parts[at][1]) <= SLICE_BYTES):
                codes.append(self.codes(parts[at][1]))
                owners.append(parts[at][0])
                size += len(parts[at][1])
                at += 1
            self.learn()
            every = np.concatenate(codes)
            n = self.count[every]
            ids = self.flat[K.ranges(self.start[every], n)]
            ends = np.concatenate([[0], np.cumsum(n)])[np.cumsum([len(c) for c in codes])]
            for k, found in zip(owners, np.split(ids, ends[:-1]), strict=True):
                out[k].append(found)
        return [np.concatenate(x) if x else np.empty(0, "<u4") for x in out]


class _Index(dict):
    """Words by number; a word that is asked for the first time gets the next one."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


def _slices(text: bytes) -> Iterator[bytes]:
    """The text in slices of about SLICE_BYTES that end at white space; a longer word stays whole."""
    at = 0
    while at < len(text):
        stop = at + SLICE_BYTES
        if stop < len(text):
            stop = max((text.rfind(bytes([c]), at, stop) for c in SPACES), default=-1)
            if stop <= at:
                stop = min((x for x in (text.find(bytes([c]), at + SLICE_BYTES) for c in SPACES) if x >= 0), default=len(text))
        yield text[at:stop]
        at = max(stop, at + 1)


def _encoded(path: str, length: int, end: int, n_groups: int):
    """Rows of (group, document, start, ids): the remainder of each document, and its whole sequences in stretches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, pack = Words(path), zstandard.ZstdCompressor(level=1)
        kind = np.uint16 if words.tokenizer.get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        salt, copies = TaskContext.get().partitionId(), Counter()
        last = np.array([end], "<u4")
        for batch in K.sliced(batches, "text"):
            out = []
            encoded = words.ids(K.texts_of(batch.column("text")))
            for doc_id, key, crc, raw in zip(batch.column("doc_id").to_pylist(), batch.column("_id").to_pylist(), batch.column("_crc").to_pylist(), encoded, strict=True):
                ids = np.concatenate([raw, last]).astype(kind)
                n = len(ids)
                copies[key, crc] += 1
                name = f"{key}:{crc}:{copies[key, crc]}:{salt}"
                whole = n // length * length
                starts = [*range(0, whole, STRETCH * length), *([whole] if whole < n else [])]
                for s, e in zip(starts, [*starts[1:], n], strict=True):
                    group = int(K.mix(np.array([zlib.crc32(f"{name}:{s}".encode())], K.U64))[0]) % n_groups
                    out.append((group, doc_id, crc, s, n, e - s, pack.compress(ids[s:e].tobytes())))
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PARTS, strict=True)], schema=PARTS)

    return run


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size; sizes fall. A tournament tree holds the largest room below each node."""
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins = []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins.append(at - leaves)
        room[at] -= size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
    return bins


def filled(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start in it, length) without padding: each is full or as long as a power of two."""
    bins: dict[int, list[tuple[int, int, int]]] = {}
    for item, b in enumerate(first_fit_decreasing(sizes, capacity)):
        bins.setdefault(b, []).append((item, 0, sizes[item]))
    by_room = sorted(bins.values(), key=lambda pieces: -sum(p[2] for p in pieces))
    full, low, high = [], 0, len(by_room) - 1
    while low <= high:
        taker = by_room[low]
        missing = capacity - sum(p[2] for p in taker)
        while missing and low < high:
            giver = by_room[high]
            item, start, size = giver.pop()
            if size > missing:
                giver.append((item, start + missing, size - missing))
                size = missing
            taker.append((item, start, size))
            missing -= size
            if not giver:
                high -= 1
        if missing:
            full += _powers_of_two(taker, capacity - missing)
        else:
            full.append(taker)
        low += 1
    return full


def _powers_of_two(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """The pieces of one sequence in sequences whose lengths are the powers of two that add up to its length."""
    left, out = pieces[::-1], []
    for power in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        now, missing = [], power
        while missing:
            item, start, size = left.pop()
            if size > missing:
                left.append((item, start + missing, size - missing))
                size = missing
            now.append((item, start, size))
            missing -= size
        out.append(now)
    return out


def _packed(path: str, length: int, end: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        kind = np.uint16 if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 and end < 1 << 16 else np.uint32
        unpack = zstandard.ZstdDecompressor()
        ids_of = lambda blob: np.frombuffer(unpack.decompress(blob), kind).astype("<u4")
        pieces: list[tuple] = []
        now, sequence, rest = None, 0, []

        def batch() -> pa.RecordBatch:
            columns = zip(*pieces, strict=True)
            made = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, PIECES, strict=True)], schema=PIECES)
            pieces.clear()
            return made

        def group() -> Iterator[pa.RecordBatch]:
            """The remainders of the group that has ended."""
            nonlocal sequence
            rest.sort(key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[1], r[2]))
            for made in filled([r[4] for r in rest], length):
                offset = 0
                for item, start, size in made:
                    doc_id, _, first, n, _, blob = rest[item]
                    pieces.append((doc_id, first + start, size, n, sequence, offset, ids_of(blob)[start : start + size].tobytes()))
                    offset += size
                sequence += 1
                if len(pieces) >= 1024:
                    yield batch()
            rest.clear()

        for part in batches:
            columns = [part.column(c).to_pylist() for c in PARTS.names]
            for bucket, doc_id, crc, start, n, size, blob in zip(*columns, strict=True):
                if bucket != now:
                    yield from group()
                    now, sequence = bucket, bucket << 32
                if size < length:
                    rest.append((doc_id, crc, start, n, size, blob))
                    continue
                ids = ids_of(blob)
                for s in range(0, size, length):
                    pieces.append((doc_id, start + s, length, n, sequence, 0, ids[s : s + length].tobytes()))
                    sequence += 1
                if len(pieces) >= 256:
                    yield batch()
        yield from group()
        if pieces:
            yield batch()

    return run


def packed(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, ids): one row for each piece of a document.

    `start` is the piece's place in its document's ids, `offset` that in its sequence; `ids` are little-endian unsigned
    32-bit numbers. Sequences are numbered by group: the group's number times 2 ** 32 and a number from 0.
    `path` is a vocabulary file of the tokenizers library, present on every worker, whose tokens never hold white space.
    `length` is a power of two.
    """
    if length & (length - 1):
        raise ValueError("length is not a power of two")
    n_groups = max(1, -(-docs.count() // group_docs))
    ddl = "bucket int, doc_id long, crc long, start long, doc_tokens long, size long, ids binary"
    parts = keyed(docs).select("doc_id", "_id", "_crc", "text").mapInArrow(_encoded(path, length, end, n_groups), ddl)
    return dealt(parts).mapInArrow(_packed(path, length, end), PIECES_DDL)


def digests(pieces: DataFrame) -> DataFrame:
    """pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
