"""Vectorised text kernels shared by the operators of this subpackage.

Everything here works on one bounded chunk of documents held by a Python worker: UTF-8 bytes in
numpy arrays, word boundaries as index arrays, and 64-bit polynomial hashes of any span from one
prefix sum. No kernel keeps state between chunks.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard

U64 = np.uint64
CHUNK_BYTES = 1 << 20
#: ASCII white space, as the word rule `[^\x20\x09-\x0D]+` has it.
SPACE = b" \t\n\x0b\x0c\r"

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads a 64-bit value over all its bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64; the longest table asked for is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values weighted by position; `span` turns two of them into a span's hash."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-free hashes of the spans [start, end), their lengths included."""
    raw = (sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
    return mix(raw + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def byte_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span(prefix(_BYTE[buf]), starts, ends)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n consecutive items (across document ends too: callers mask those)."""
    if len(hashes) < n:
        return np.empty(0, U64)
    at = np.arange(len(hashes) - n + 1)
    return span(prefix(hashes), at, at + n)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every i at which the window fits, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def leftmost_min(hashes: np.ndarray, width: int) -> np.ndarray:
    """Index of the smallest hash in each window of `width`; the leftmost of equal ones."""
    if len(hashes) < width:
        return np.empty(0, np.int64)
    bits = max(1, int(len(hashes)).bit_length())
    low = U64((1 << bits) - 1)
    return (sliding_min((hashes & ~low) | np.arange(len(hashes), dtype=U64), width) & low).astype(np.int64)


def runs(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of rows that are equal in every column."""
    n = len(columns[0])
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    return starts, np.append(starts[1:], n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(start, start + length) for each pair."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.arange(total) - np.repeat(at - starts, lengths)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as UTF-8 bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"").to_pylist()


def sliced(batches: Iterable[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that each has about `most` bytes of text at most, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(text).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(sizes.buffers()[1], np.int64)[sizes.offset : sizes.offset + len(sizes) + 1]) if len(sizes) else np.empty(0)
        part = (np.cumsum(sizes) - sizes) // most
        starts, ends = runs(part)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            yield batch.slice(s, e - s)


class Words:
    """Words of a chunk in canonical form: each document's words joined by one space.

    `blob` holds all words of the chunk separated by one space, `starts` and `ends` their places in
    it, `first` the index of each document's first word (one more entry at the end).
    """

    def __init__(self, lists: list[list[bytes]]):
        counts = np.fromiter((len(x) for x in lists), np.int64, len(lists))
        self.first = np.concatenate([[0], np.cumsum(counts)])
        self.blob = b" ".join([b" ".join(x) for x in lists if x])
        self.buf = np.frombuffer(self.blob, np.uint8)
        cut = np.flatnonzero(self.buf == 32)
        self.starts = np.concatenate([[0], cut + 1]) if len(self.buf) else np.empty(0, np.int64)
        self.ends = np.append(cut, len(self.buf)) if len(self.buf) else np.empty(0, np.int64)
        self.counts = counts

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        return byte_spans(self.buf, self.starts, self.ends)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def pack(*parts: object) -> bytes:
    return zstandard.ZstdCompressor(level=2).compress(pickle.dumps(parts, protocol=5))


def unpack(blob: bytes | pa.Buffer) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))


def buckets_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[pa.Buffer]]:
    """The payloads of each bucket, of rows sorted by bucket."""
    now, have = None, []
    for batch in batches:
        payload = batch.column("payload")
        for i, bucket in enumerate(batch.column("bucket").to_pylist()):
            if bucket != now and have:
                yield have
                have = []
            now = bucket
            have.append(payload[i].as_buffer())
    if have:
        yield have
