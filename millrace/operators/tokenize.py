"""Byte-level tokenizer: rank tables, encoding, decoding, special tokens."""

from __future__ import annotations

import codecs
import heapq
import itertools
import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import files

# Special tokens by id, the pre-token pattern, the size of the vocabulary.
SPECIAL = {
    "<|pad|>": 0, "<|bos|>": 1, "<|eos|>": 2, "<|thought start|>": 3, "<|thought end|>": 4, "<|call tool|>": 5, "<|tool response|>": 6,
    "<|reflect|>": 7, "<|fim_prefix|>": 8, "<|fim_middle|>": 9, "<|fim_suffix|>": 10, "<|unk|>": 11,
}
PATTERN = r"""(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"""
SIZE = 8192

#: Strings that get ids right after the bytes unless other seeds are given.
SEEDS = ("  ", "    ", "\n\n", "\n    ", " the", " of", " to", " and", " in", " is", "return ", "import ", "self", "None", "True", "False", " == ", " -> ")


def build_ranks(seeds: tuple[str, ...] = SEEDS, size: int = SIZE, reserved: int = len(SPECIAL)) -> dict[bytes, int]:
    """Bytes first, then the seeds in order, then byte pairs (triples, ...) in order until the vocabulary is full."""
    tokens = dict.fromkeys(bytes([b]) for b in range(256))
    tokens |= dict.fromkeys(s.encode() for s in seeds)
    room = size - reserved
    for n in itertools.count(2):
        if len(tokens) >= room:
            break
        for combination in itertools.product(range(256), repeat=n):
            if len(tokens) >= room:
                break
            tokens.setdefault(bytes(combination))
    return {t: reserved + i for i, t in enumerate(itertools.islice(tokens, room))}


@dataclass
class Tokenizer:
    """Ranks and special tokens. Equal tokenizers are interchangeable; workers keep one each."""

    ranks: dict[bytes, int] = field(default_factory=build_ranks)
    special: dict[str, int] = field(default_factory=lambda: dict(SPECIAL))
    name: str = "byte_8k"

    def __post_init__(self) -> None:
        self.bytes_of = {i: t for t, i in self.ranks.items()} | {i: s.encode() for s, i in self.special.items()}

    def __getstate__(self) -> dict:
        return {"ranks": self.ranks, "special": self.special, "name": self.name}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "vocab_size": len(self.ranks) + len(self.special), "special_tokens": self.special, "merge_ranks": {t.hex(): i for t, i in self.ranks.items()}}, indent=2)

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        data = json.loads(text)
        return cls({bytes.fromhex(t): i for t, i in data["merge_ranks"].items()}, data["special_tokens"], data["name"])

    def save(self, spark: SparkSession, path: str) -> None:
        files.write_text(spark, path, self.to_json())

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Tokenizer:
        return cls.from_json(files.read_text(spark, path))

    def _merge(self, piece: str) -> tuple[int, ...]:
        """Pairs are joined from the lowest rank, the leftmost of equal ones; each join costs the logarithm of the piece."""
        raw = piece.encode("utf-8", "replace")
        if raw in self.ranks:
            return (self.ranks[raw],)
        n = len(raw)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that begins at a place
        heap: list[tuple[int, int, int]] = []

        def offer(at: int) -> None:
            if at >= 0 and end[at] < n:
                stop = end[end[at]]
                rank = self.ranks.get(raw[at:stop])
                if rank is not None:
                    heapq.heappush(heap, (rank, at, stop))

        for at in range(n - 1):
            offer(at)
        gone = bytearray(n)
        while heap:
            _, at, stop = heapq.heappop(heap)
            if gone[at] or end[at] >= n or end[end[at]] != stop:
                continue
            gone[end[at]] = 1
            end[at] = stop
            if stop < n:
                before[stop] = at
            offer(at)
            offer(before[at])
        out, at = [], 0
        while at < n:
            out.append(self.ranks[raw[at : end[at]]])
            at = end[at]
        return tuple(out)

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of.get(int(i), b"") for i in ids).decode("utf-8", "replace")


class _Known(dict):
    """Piece -> its ids' bytes, merged when first met; forgotten when there are too many. Long pieces are not kept."""

    MOST, LONG = 100_000, 64

    def __init__(self, merge):
        self.merge = merge

    def __missing__(self, piece: str) -> bytes:
        ids = self.merge(piece)
        if len(piece) <= self.LONG:
            if len(self) >= self.MOST:
                self.clear()
            self[piece] = ids
        return ids


SLICE = 1 << 18  # bytes of texts, or tokens, that are Python objects at once


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    """column in stretches of about SLICE bytes of its texts or entries of its lists, however many rows a batch has."""
    length = pc.list_value_length(column) if pa.types.is_list(column.type) else pc.binary_length(column)
    sizes = np.cumsum(length.fill_null(0).to_numpy(zero_copy_only=False) + 1) // SLICE
    starts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist()]
    for a, b in itertools.pairwise([*starts, len(column)]):
        yield column.slice(a, b - a)


def encoder(tokenizer: Tokenizer, allow_special: bool = True) -> Callable[[pa.Array], Iterator[pa.Array]]:
    """Lists of token ids of an array of texts, a slice after another. Merges run once for each distinct piece that it
    remembers; a piece's ids are kept as bytes, so no token becomes a Python object."""
    import regex

    find = regex.compile(PATTERN).findall
    quoted = "|".join(regex.escape(s) for s in sorted(tokenizer.special, key=len, reverse=True))
    split = regex.compile(f"({quoted})").split if allow_special and quoted else lambda t: [t]
    raw = lambda ids: np.array(ids, np.int32).tobytes()
    special = {s: raw([i]) for s, i in tokenizer.special.items()} if allow_special else {}
    known = _Known(lambda piece: raw(tokenizer._merge(piece)))

    def ids(t: str) -> bytes:
        return b"".join(special[part] if part in special else b"".join(map(known.__getitem__, find(part))) for part in split(t))

    def run(texts: pa.Array) -> Iterator[pa.Array]:
        for column in _slices(texts):
            rows = [None if t is None else ids(t) for t in column.to_pylist()]
            ends = np.cumsum([0, *(len(x or b"") // 4 for x in rows)])
            values = np.frombuffer(b"".join(x or b"" for x in rows), np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values), mask=pa.array([x is None for x in rows], pa.bool_()))

    return run


def encode(text: Column, tokenizer: Tokenizer, allow_special: bool = True) -> Column:
    """Token ids."""

    @F.arrow_udf("array<int>")
    def merged(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from chain.from_iterable(map(encoder(tokenizer, allow_special), parts))

    return merged(text)


def decode(ids: Column, tokenizer: Tokenizer) -> Column:
    @F.arrow_udf("string")
    def text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in chain.from_iterable(map(_slices, parts)):
            yield pa.array([None if row is None else tokenizer.decode(row) for row in column.to_pylist()], pa.string())

    return text(ids)


def text_chunks(tokens: DataFrame, run: list[str], order: str, token: str, tokenizer: Tokenizer, name: str = "chunk") -> DataFrame:
    """(run, order, chunk): the text that each token of a run completes, as a decoder that gets them one by one gives it.

    Bytes wait until their character is whole; those that cannot become one are left out. Special tokens are given as
    they are, and bytes wait on behind them. Runs are streamed in order, with one decoder of state.
    """

    def scan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, now, decoder = {i: s for s, i in tokenizer.special.items()}, None, None
        for pdf in parts:
            out = []
            for key, t in zip(pdf[run].itertuples(index=False, name=None), pdf[token].tolist(), strict=True):
                if key != now:
                    now, decoder = key, codecs.getincrementaldecoder("utf-8")("ignore")
                out.append(names[t] if t in names else decoder.decode(tokenizer.bytes_of.get(t, b"")).replace("\ufffd", ""))
            yield pd.DataFrame({**{c: pdf[c] for c in run}, order: pdf[order], name: out})

    types = dict(tokens.dtypes)
    ddl = ", ".join(f"{c} {types[c]}" for c in [*run, order]) + f", {name} string"
    return tokens.select(*run, order, token).repartition(*run).sortWithinPartitions(*run, order).mapInPandas(scan, ddl)


def vocabulary(spark: SparkSession, tokenizer: Tokenizer) -> DataFrame:
    """(token_id, bytes, special, printable): ids whose bytes are not printable UTF-8 are to be masked."""
    rows = []
    for i, raw in sorted(tokenizer.bytes_of.items()):
        special = raw.decode("utf-8", "replace") in tokenizer.special
        try:
            ok = special or all(c.isprintable() or c in "\n\t\r " for c in raw.decode())
        except UnicodeDecodeError:
            ok = False
        rows.append((i, bytearray(raw), special, ok))
    return spark.createDataFrame(rows, "token_id int, bytes binary, special boolean, printable boolean")
