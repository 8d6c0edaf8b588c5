"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

A vocabulary is read from a .model file: pieces, their kinds and scores. If the file's own scores are
ranks (a BPE file), pieces get log scores by Zipf's law on the rank, -ln(rank) less the log of the sum;
a unigram file's scores are taken as they are. User-defined pieces score a little less than their
characters would with the best score each, so that they are taken wherever they stand. A file that rewrites
texts (a normaliser other than the identity, removal of white space, markers behind words) is refused.

Encoding. The text gets a leading space, spaces become the marker U+2581, and the path of pieces with the
largest sum of log scores is taken; among equal ones, the last piece is the longest. A character
that no piece matches costs the smallest score less UNKNOWN_PENALTY and becomes its UTF-8 bytes.
Where no piece has a marker after another character, a text falls into units at its markers which
are encoded apart: each distinct unit once in a worker's memory, many at a time; otherwise a text is one unit. The trie is walked for
all places of a batch of units together, and the best paths are found level by level of byte length.

Decoding. Bytes and pieces are concatenated, markers become spaces and the leading one goes. Bytes
that are not UTF-8 become U+FFFD. A literal U+2581 in a text comes back as a space.

Defined results: null and empty text have no ids, and no ids decode to the empty text; unknown ids and
control pieces decode to nothing; rows are encoded one by one, so repeated rows get the same ids each.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm import _kernel as K
from millrace.llm._rows import fresh

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
KNOWN_UNITS = 200_000  # a worker's memory of encoded units
BATCH_UNITS = 20_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

_units = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+").findall


class DoubleArray:
    """A trie of byte strings: from state s, byte b leads to base[s] + b if check there is s."""

    WINDOW = 4096

    def __init__(self, keys: list[tuple[bytes, int]]):
        root: dict = {}
        for key, value in keys:
            node = root
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1 << 16
        self.base, self.check, self.value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        self.check[0] = -2
        todo, low = [(0, root)], 1
        while todo:
            state, node = todo.pop()
            if -1 in node:
                self.value[state] = node[-1]
            bytes_ = np.array(sorted(b for b in node if b >= 0), np.int64)
            if not len(bytes_):
                continue
            while not free[low]:
                low += 1
            at = max(1, low - int(bytes_[0]))
            while True:
                while at + self.WINDOW + 256 > len(free):
                    self._grow()
                    free = np.concatenate([free, np.ones(len(self.base) - len(free), bool)])
                fits = free[at + bytes_[0] : at + bytes_[0] + self.WINDOW].copy()
                for b in bytes_[1:].tolist():
                    fits &= free[at + b : at + b + self.WINDOW]
                place = int(fits.argmax())
                at += place if fits[place] else self.WINDOW
                if fits[place]:
                    break
            self.base[state] = at
            free[at + bytes_] = False
            self.check[at + bytes_] = state
            todo += [(at + b, node[b]) for b in bytes_.tolist()]

    def _grow(self) -> None:
        n = len(self.base)
        self.base = np.concatenate([self.base, np.zeros(n, np.int32)])
        self.check = np.concatenate([self.check, np.full(n, -1, np.int32)])
        self.value = np.concatenate([self.value, np.full(n, -1, np.int32)])

    def matches(self, buf: np.ndarray, places: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, value) of every key that stands at one of the places and ends by that place's end."""
        out = []
        at, state, start = places, np.zeros(len(places), np.int64), places
        while len(at):
            step = self.base[state] + buf[at].astype(np.int64)
            ok = (self.check[step] == state) & (self.base[state] > 0)
            state, at, start, ends = step[ok], at[ok] + 1, start[ok], ends[ok]
            hit = self.value[state] >= 0
            out.append((start[hit], at[hit], self.value[state[hit]].astype(np.int64)))
            go = at < ends
            state, at, start, ends = state[go], at[go], start[go], ends[go]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


@dataclass
class Vocabulary:
    pieces: list[bytes]
    kinds: list[int]
    scores: np.ndarray

    def __post_init__(self) -> None:
        self.cuts = not any(MARKER in p.decode("utf-8", "replace").lstrip(MARKER) for p, k in zip(self.pieces, self.kinds, strict=True) if k in (NORMAL, USER))
        best = max((self.scores[i] for i, k in enumerate(self.kinds) if k == NORMAL), default=0.0)
        self.scores = np.array([len(p.decode("utf-8", "replace")) * best - 0.1 if k == USER else x for p, k, x in zip(self.pieces, self.kinds, self.scores, strict=True)])
        matched = [i for i, k in enumerate(self.kinds) if k in (NORMAL, USER)]
        self.trie = DoubleArray([(self.pieces[i], i) for i in matched])
        self.unknown = float(min((self.scores[i] for i in matched if self.kinds[i] == NORMAL), default=0.0)) - UNKNOWN_PENALTY
        self.byte = np.full(256, -1, np.int64)
        self.unk = next((i for i, k in enumerate(self.kinds) if k == UNKNOWN), 0)
        plain = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)):
            if k == BYTE:
                self.byte[int(p[3:5], 16)] = i
                plain.append(bytes([int(p[3:5], 16)]))
            else:
                plain.append(p if k in (NORMAL, USER) else b"")
        self.byte[self.byte < 0] = self.unk
        self.sizes = np.fromiter(map(len, plain), np.int64, len(plain))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.plain = np.frombuffer(b"".join(plain), np.uint8)

    @classmethod
    @functools.cache
    def load(cls, path: str) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.add_dummy_prefix or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path} rewrites texts before it cuts them, which is not supported")
        kinds = [p.type for p in model.pieces]
        scores = np.array([p.score for p in model.pieces], np.float64)
        if model.trainer_spec.model_type != pb.TrainerSpec.UNIGRAM:
            normal = [i for i, k in enumerate(kinds) if k == NORMAL]
            order = sorted(normal, key=lambda i: (-scores[i], i))
            total = np.log(np.sum(1 / np.arange(1, len(order) + 1)))
            scores = np.zeros(len(kinds))
            scores[order] = -np.log(np.arange(1, len(order) + 1)) - total
        return cls([p.piece.encode() for p in model.pieces], kinds, scores)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the units, one after another, and how many each has."""
        texts = [u.encode("utf-8", "replace") for u in units]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        buf = np.frombuffer(b"".join(texts), np.uint8)
        last = np.cumsum(sizes)
        first = last - sizes
        head = (buf & 0xC0) != 0x80
        places = np.flatnonzero(head)
        ends = np.repeat(last, sizes)[places]
        chars = np.diff(np.append(places, len(buf)))  # bytes of the character at each place
        start, end, piece = self.trie.matches(buf, places, ends)
        width = np.zeros(len(buf) + 1, np.int64)
        width[places] = chars
        single = np.zeros(len(buf) + 1, bool)
        single[start[end - start == width[start]]] = True
        alone = places[~single[places]]
        start = np.concatenate([start, alone])
        end = np.concatenate([end, alone + width[alone]])
        score = np.concatenate([self.scores[piece], np.full(len(alone), self.unknown)])
        piece = np.concatenate([piece, np.full(len(alone), -1)])
        level = end - np.repeat(first, sizes)[start]
        order = np.lexsort((start, end, level))
        start, end, score, piece, level = start[order], end[order], score[order], piece[order], level[order]
        best = np.full(len(buf) + 1, -np.inf)
        into = np.zeros(len(buf) + 1, np.int64)  # the edge by which the best path comes to a place; by unit, see below
        # a place may end one unit and start the next: paths begin at 0 there, and ends are read before
        begins = np.zeros(len(buf) + 1, bool)
        begins[first] = True
        edges = np.searchsorted(level, np.arange(1, (level[-1] if len(level) else 0) + 2))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if lo == hi:
                continue
            s, e = start[lo:hi], end[lo:hi]
            sums = np.where(begins[s], 0.0, best[s]) + score[lo:hi]
            g = np.flatnonzero(np.concatenate([[True], e[1:] != e[:-1]]))
            top = np.maximum.reduceat(sums, g)
            is_top = sums == np.repeat(top, np.diff(np.append(g, hi - lo)))
            at = np.flatnonzero(is_top)
            _, pick = np.unique(e[at], return_index=True)
            best[e[g]] = top
            into[e[g]] = lo + at[pick]
        here, unit, path = last.copy(), np.arange(len(units)), []
        while len(here):
            edge = into[here]
            path.append((edge, unit))
            here = start[edge]
            go = here > first[unit]
            here, unit = here[go], unit[go]
        if not path:
            return np.empty(0, np.int64), np.zeros(len(units), np.int64)
        edge, unit = (np.concatenate(x) for x in zip(*path, strict=True))
        order = np.argsort(start[edge], kind="stable")
        edge, unit = edge[order], unit[order]
        n = np.where(piece[edge] < 0, end[edge] - start[edge], 1)
        ids = np.repeat(piece[edge], n)
        spelled = ids < 0
        ids[spelled] = self.byte[buf[K.ranges(start[edge], n)[spelled]]]
        return ids, np.bincount(unit, n, len(units)).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = ids[(ids >= 0) & (ids < len(self.sizes))]
        return self.plain[K.ranges(self.starts[ids], self.sizes[ids])].tobytes()


class _Known(dict):
    def __missing__(self, unit: str) -> int:
        self[unit] = at = len(self)
        return at


class Encoder:
    """Encodes texts, keeping the ids of the units it has met."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known = _Known()
        self.ids, self.first, self.count = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after another, and how many each has."""
        marked = [MARKER + t.replace(" ", MARKER) if t else "" for t in texts]
        lists = [_units(t) if self.vocabulary.cuts else [t] * bool(t) for t in marked]
        before = len(self.known)
        codes = np.fromiter(map(self.known.__getitem__, chain.from_iterable(lists)), np.int64)
        new = list(self.known)[before:]
        for at in range(0, len(new), BATCH_UNITS):
            ids, count = self.vocabulary.encode_units(new[at : at + BATCH_UNITS])
            self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(count) - count])
            self.count = np.concatenate([self.count, count])
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        out = self.ids[K.ranges(self.first[codes], self.count[codes])]
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        total = np.concatenate([[0], np.cumsum(self.count[codes])])
        lengths = np.diff(total[np.concatenate([[0], ends])])
        if len(self.known) > KNOWN_UNITS:
            self.clear()
        return out, lengths


def _encode(vocabulary: Vocabulary, text: str, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in K.sliced(batches, text):
            ids, lengths = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))], names=[*batch.schema.names, name])

    return run


def encoded(docs: DataFrame, path: str, text: str = "text", name: str = "ids") -> tuple[DataFrame, str]:
    """docs with the ids of `text` appended as array<int>; the new column's name, which does not clash."""
    name = fresh(docs.columns, name)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.IntegerType()))])
    return docs.mapInArrow(_encode(Vocabulary.load(path), text, name), schema), name


def _decode(vocabulary: Vocabulary, ids: str, name: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marker = MARKER.encode()
        for batch in batches:
            out = []
            for row in batch.column(ids):
                values = row.values.to_numpy(zero_copy_only=False).astype(np.int64) if row.is_valid else np.empty(0, np.int64)
                plain = vocabulary.decode(values).replace(marker, b" ")
                out.append(plain[plain[:1] == b" " :].decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, name])

    return run


def decoded(rows: DataFrame, path: str, ids: str = "ids", name: str = "decoded") -> tuple[DataFrame, str]:
    """rows with the text of the column `ids` appended; the new column's name, which does not clash."""
    name = fresh(rows.columns, name)
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.StringType())])
    return rows.mapInArrow(_decode(Vocabulary.load(path), ids, name), schema), name


def _both(vocabulary: Vocabulary, text: str, names: tuple[str, str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, marker = Encoder(vocabulary), MARKER.encode()
        for batch in K.sliced(batches, text):
            ids, lengths = encoder.encode([t or "" for t in batch.column(text).to_pylist()])
            ends = np.concatenate([[0], np.cumsum(lengths)])
            plain = [vocabulary.decode(ids[a:b]).replace(marker, b" ") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            back = pa.array([p[p[:1] == b" " :].decode("utf-8", "replace") for p in plain], pa.string())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, back], names=[*batch.schema.names, *names])

    return run


def round_trip(docs: DataFrame, path: str, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with the ids of `text` and the text that they decode to, in one pass; the new columns' names."""
    ids = fresh(docs.columns, "ids")
    back = fresh([*docs.columns, ids], "decoded")
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(back, T.StringType())])
    return docs.mapInArrow(_both(Vocabulary.load(path), text, (ids, back)), schema), ids, back
