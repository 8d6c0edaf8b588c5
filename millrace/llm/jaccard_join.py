"""Exact n-gram Jaccard self-join with PartEnum signatures, and its components.

Sets. A document's set holds its distinct word shingles as 64-bit hashes. Equal sets form a class, a
node, however many documents it has; its name is a hash of the set.

Signatures. Sizes are cut into bands whose ends differ by the threshold. A set signs in its own band and,
if it can be similar to a set there, in the next, so two similar sets share a band. Within a band two
similar sets differ in at most k elements. The hash domain is split into n1 parts; n1 exceeds
k // (k2 + 1) by `spare`, so at least `spare` parts hold k2 differences at most. Each part is split again
into n2 pieces and every subset of n2 - k2 pieces gives a signature, the hash of the set's elements in them:
similar sets share at least `spare` signatures. A subset without elements gives none, unless a set has
so many empty ones that it could agree with another in those alone. Nothing is lost by either rule.
`scheme` takes n1, n2, k2 and spare, for every band alike, from the setting that costs least: the
signatures, the candidates that signatures of few elements bring, and the sets with too many empty
subsets. A set that shares fewer signatures with all others together than a similar one would share
with it alone drops out.

Candidates. Signatures travel to buckets packed by block, once for each block and class; those with
two or more nodes leave groups there; those with the same smallest node leave one together. Then an element count over the
grouped nodes: a set of whose elements less than the threshold stand in any other grouped set is
similar to none, and drops out; the others keep only shared elements, which suffice for exact
intersections.

Verification, in two passes. In the first a node is in one group, that of the smallest node which shares a
signature with it, and these groups' links give components. Then every group, still packed, is held against
those: one whose nodes are all in one component has nothing to add; the others are verified whole in the
second pass. So a cluster of near copies that the first pass joins is rows once, and not once for each of the
smallest nodes of its groups. Sets that share signatures but are not joined still have a row for each, at most
one for each of their signatures.

Each group is a part of its smallest node's neighbourhood, and that node, the hub, is its
pivot. A neighbourhood is dealt into units of bounded rows and bytes, the hub in each; a unit's links
become a spanning forest in its task, and pairs are never emitted. Nodes connected with the hub in their
unit are connected with each other, so only the rest of a neighbourhood of several units, if there is
any, is compared with the other units. Components of both passes' links are the answer.

Defined results: null text, or text without words, has an empty set and is linked with nothing; fewer
words than a shingle make one shingle of all; rows that repeat doc_id and text are one document;
a null doc_id counts as the smallest.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm import _kernel as K
from millrace.llm._rows import LEAST, block_bytes, checkpointed, dealt, fresh, keyed, matched, partitions
from millrace.llm.components import components

SHINGLE = 5
PERCENT = 80
BLOCK_BYTES = 8 << 20  # of signatures or elements, eight bytes each
UNIT_BYTES, UNIT_ROWS = 2 << 20, 4096
SIDE, COLUMNS = 512, 1024  # of a matrix product's blocks
HOMES = 8  # partitions for each of tallies and links, which are small
LARGEST = 1 << 31  # elements of a set
NONE = (1 << 20) - 1

#: (k2, n2) that `scheme` chooses from.
SETTINGS = ((0, 1), (1, 3), (1, 4), (1, 5), (1, 6), (2, 4), (2, 5), (2, 6), (2, 7), (3, 6), (3, 7))
CANDIDATE_COST, EMPTY_COST = 8.0, 4000.0  # in signatures

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _tail(mean: float, variance: float, least: int) -> float:
    """A bound, or for large means an estimate, of the chance of `least` or more."""
    if mean <= 0:
        return 0.0
    out = min(1.0, mean / least)
    if least > mean:
        out = min(out, variance / (variance + (least - mean) ** 2))
        if mean > 8:
            out = min(out, math.erfc((least - 0.5 - mean) / math.sqrt(2 * variance)) / 2)
    return out


def scheme(high: int, percent: int, settings: tuple = SETTINGS) -> tuple[int, int, int, int]:
    """n1, n2, k2 and spare of the band up to `high`: the setting of least cost for the smallest sets that sign in it."""
    k = (100 - percent) * 2 * high // (100 + percent)
    if not k:
        return 1, 1, 0, 1
    size = -(-high * percent * percent // 10_000)
    best = None
    for k2, n2 in settings:
        subsets, spare = math.comb(n2, k2), 1
        while k2 <= k and spare <= 2 * k + 5:
            n1 = k // (k2 + 1) + spare
            bare, void = (1 - (n2 - k2) / (n1 * n2)) ** size, (1 - 1 / n1) ** size
            variance = n1 * (subsets**2 * void + subsets * max(0.0, bare - void))
            missed = _tail(n1 * subsets * bare, variance, spare)
            each = size * (n2 - k2) / (n1 * n2)
            cost = n1 * subsets * (1 + CANDIDATE_COST * 0.5**each) + EMPTY_COST * missed
            if best is None or cost < best[0]:
                best = cost, (n1, n2, k2, spare)
            spare += max(1, spare // 16)
    return best[1]


@functools.cache
def bands(percent: int) -> list[tuple[int, int, tuple[int, int, int, int]]]:
    """(smallest size, largest size, scheme) of every band. Made by the driver and sent to all tasks, which must agree."""
    out, low = [], 1
    while low <= LARGEST:
        high = max(low, low * 100 // percent)
        out.append((low, high, scheme(high, percent)))
        low = high + 1
    return out


class Signer:
    """Signatures of sets."""

    def __init__(self, bands: list, percent: int):
        self.bands, self.percent = bands, percent
        self.lows = [b[0] for b in bands]
        self.subsets: dict[tuple[int, int], np.ndarray] = {}

    def of(self, size: int) -> list[int]:
        """The bands that a set of this size signs in."""
        own = bisect.bisect_right(self.lows, size) - 1
        return [own, own + 1] if 100 * size >= self.percent * self.bands[own + 1][0] else [own]

    def sign(self, elements: np.ndarray) -> tuple[np.ndarray, int]:
        """Signatures of one set, given as its sorted hashes, the lowest bit that of the band; how many of them
        a similar set must share, for even and odd bands (`NONE` where it signs in none)."""
        out, need = [], [NONE, NONE]
        sums = np.concatenate([[K.U64(0)], np.cumsum(K.mix(elements ^ K.U64(0x5851F42D4C957F2D)))])
        for band in self.of(len(elements)):
            n1, n2, k2, spare = self.bands[band][2]
            pieces = n1 * n2
            width = ((1 << 64) - 1) // pieces
            cuts = np.searchsorted(elements, np.arange(1, pieces, dtype=K.U64) * K.U64(width))
            cuts = np.concatenate([[0], cuts, [len(elements)]])
            value, count = sums[cuts[1:]] - sums[cuts[:-1]], np.diff(cuts)
            if k2:
                if (n2, k2) not in self.subsets:
                    self.subsets[n2, k2] = np.array(list(itertools.combinations(range(n2), n2 - k2)))
                chosen = self.subsets[n2, k2]
                value = value.reshape(n1, n2)[:, chosen].sum(2, dtype=K.U64).ravel()
                count = count.reshape(n1, n2)[:, chosen].sum(2).ravel()
            place = np.arange(len(value), dtype=K.U64)
            full = count > 0
            empty = int((~full).sum())
            if empty >= spare:
                full[:] = True
                empty = 0
            need[band % 2] = min(spare - empty, NONE - 1)
            keys = K.mix(value[full] + K.mix(place[full] + K.U64(band << 32)))
            out.append(keys & ~K.U64(1) | K.U64(band % 2))
        return np.concatenate(out), need[0] + need[1] * (NONE + 1)


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = K.Words([t.translate(_LOWER).split() for t in texts])
    hashes, first = words.hashes(), words.first
    each = K.grams(hashes, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(each[a : b - n + 1]))
        else:
            out.append(K.grams(hashes[a:b], b - a) if b > a else np.empty(0, K.U64))
    return out


def set_name(elements: np.ndarray) -> int:
    """A 63-bit name for the class of documents with this set."""
    total = int(K.mix(elements).sum(dtype=K.U64)) + len(elements) * 0x9E3779B97F4A7C15
    return int(K.mix(np.array([total % (1 << 64)], K.U64))[0] >> K.U64(1))


_ROWS = pa.schema([("bucket", pa.int32()), ("payload", pa.binary()), ("_id", pa.int64()), ("_crc", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("need", pa.int64())])
_ROWS_DDL = "bucket int, payload binary, _id long, _crc long, n long, node long, need long"
_PACKED_DDL = "bucket int, payload binary"


def _packed(keys: np.ndarray, owner: np.ndarray, nodes: np.ndarray, n_buckets: int) -> Iterator[tuple[int, bytes]]:
    """(bucket, payload) with the keys of that bucket, their owners' places and the owners."""
    bucket = (keys % K.U64(n_buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
    for b in range(n_buckets):
        these = order[edges[b] : edges[b + 1]]
        if len(these):
            own, at = np.unique(owner[these], return_inverse=True)
            yield b, K.pack(keys[these], at.astype(np.uint16 if len(own) < 1 << 16 else np.uint32), nodes[own])


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "payload"])


def _read(payloads: Iterable[pa.Buffer]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, node) of a bucket's payloads, sorted by key; keys of one node alone are left out."""
    keys, nodes = [], []
    for payload in payloads:
        k, at, own = K.unpack(payload)
        keys.append(k)
        nodes.append(own[at])
    if not keys:
        return np.empty(0, K.U64), np.empty(0, np.int64)
    key = np.concatenate(keys)
    keys.clear()
    node = np.concatenate(nodes)
    nodes.clear()
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    key, order = key[many], order[many]
    node = node[order]
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    s, _ = K.runs(key, node)
    key, node = key[s], node[s]
    s, e = K.runs(key)
    many = np.repeat(e - s > 1, e - s)
    return key[many], node[many]


def _sign(shingle: int, percent: int, table: list, n_buckets: int):
    most = block_bytes(n_buckets, BLOCK_BYTES) // 8

    def flush(names: list[int], signs: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, signs), np.int64, len(signs))
        rows = list(_packed(np.concatenate(signs), np.repeat(np.arange(len(signs)), lengths), np.array(names, np.int64), n_buckets))
        if rows:
            empty = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([*_batch(rows).columns, empty, empty, empty, empty, empty], schema=_ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(table, percent)
        signs: dict[int, np.ndarray] = {}
        needs: dict[int, int] = {}
        size = 0
        for batch in K.sliced(batches, "text"):
            sets = shingle_sets(K.texts_of(batch.column("text")), shingle)
            names = [set_name(s) for s in sets]
            for name, s in zip(names, sets, strict=True):
                if len(s) and name not in signs:
                    signs[name], needs[name] = signer.sign(s)
                    size += len(signs[name])
            ids, crcs = batch.column("_id"), batch.column("_crc")
            homes = (ids.to_numpy() % n_buckets).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(homes), pa.nulls(len(sets), pa.binary()), ids, crcs, pa.array([len(s) for s in sets], pa.int64()), pa.array(names, pa.int64()), pa.array([needs.get(x, 0) for x in names], pa.int64())], schema=_ROWS)
            if size > most:
                yield from flush(list(signs), list(signs.values()))
                signs, needs, size = {}, {}, 0
        if signs:
            yield from flush(list(signs), list(signs.values()))

    return run


_FOUND = pa.schema([("_id", pa.int64()), ("_crc", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("need", pa.int64()), ("payload", pa.binary())])
_FOUND_DDL = "_id long, _crc long, n long, node long, need long, payload binary"


def _groups_of(key: np.ndarray, node: np.ndarray) -> bytes:
    """A bucket's groups of nodes, and how many signatures of either parity each node shares, packed.

    Groups with the same smallest node are one, named by that node. So a node is in as many groups as there are such
    nodes before it, and not in one for each set of nodes that some signature brings together, whose
    number grows with the square of a cluster until all of its nodes' signatures are shared.
    """
    s, e = K.runs(key)
    g = np.repeat(node[s], e - s)
    order = np.lexsort((node, g))
    first, members = g[order], node[order]
    once, _ = K.runs(first, members)
    g, members = first[once], members[once]
    each, at = np.unique(node, return_inverse=True)
    counts = np.bincount(2 * at + (key & K.U64(1)).astype(np.int64), minlength=2 * len(each)).astype(np.int32)
    return K.pack(g, members, each, counts[::2], counts[1::2])


def _group(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passes documents on, and turns each bucket's signatures into its groups and tallies."""

    def documents(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(f.name) if f.name != "payload" else pa.nulls(batch.num_rows, pa.binary()) for f in _FOUND], schema=_FOUND)

    def found(payloads: list[pa.Buffer]) -> Iterator[pa.RecordBatch]:
        key, node = _read(payloads)
        if len(key):
            empty = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays([empty] * 5 + [pa.array([_groups_of(key, node)], pa.binary())], schema=_FOUND)

    now, have = None, []
    for batch in batches:
        packed = batch.column("payload").is_valid()
        rows = batch.filter(pc.invert(packed))
        if rows.num_rows:
            yield documents(rows)
        rows = batch.filter(packed)
        payload = rows.column("payload")
        for i, bucket in enumerate(rows.column("bucket").to_pylist()):
            if bucket != now and have:
                yield from found(have)
                have = []
            now = bucket
            have.append(payload[i].as_buffer())
    if have:
        yield from found(have)


def _homed(home: np.ndarray, *columns: np.ndarray) -> pa.RecordBatch:
    """(bucket, payload): columns packed by home, so that there are not as many rows as nodes times buckets."""
    order = np.argsort(home, kind="stable")
    home, columns = home[order], [c[order] for c in columns]
    return _batch([(int(home[a]), K.pack(*[c[a:b] for c in columns])) for a, b in zip(*K.runs(home), strict=True)])


def _tallies(n_homes: int):
    """A bucket's tallies and each node's smallest group, by the home of the nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, members, node, even, odd = K.unpack(batch.column("payload")[i].as_buffer())
                order = np.lexsort((g, members))
                low = g[order][K.runs(members[order])[0]]  # every node of a bucket is in a group
                yield _homed(node % n_homes, node, even, odd, low)

    return run


def _tallied(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, even, odd, low): how many signatures of its even and odd band a node shares with any other, and the
    smallest of its groups, home by home."""
    for payloads in K.buckets_of(batches):
        node, even, odd, low = map(np.concatenate, zip(*map(K.unpack, payloads), strict=True))
        names, at = np.unique(node, return_inverse=True)
        sums = [pa.array(np.bincount(at, x).astype(np.int64)) for x in (even, odd)]
        order = np.lexsort((low, at))
        yield pa.RecordBatch.from_arrays([pa.array(names), *sums, pa.array(low[order][K.runs(at[order])[0]])], names=["node", "even", "odd", "low"])


def _members(n_homes: int):
    """A bucket's groups, by the home of their nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                g, node, *_ = K.unpack(batch.column("payload")[i].as_buffer())
                yield _homed(node % n_homes, g, node)

    return run


def _places(n_homes: int):
    """Nodes and the first documents (_id, _crc) of their components, by the home of the nodes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                node, *root = (batch.column(x).to_numpy() for x in ("node", "_id", "_crc"))
                yield _homed(node % n_homes, node, *root)

    return run


def _placed(n_homes: int):
    """Distinct (group, node, _id, _crc), for nodes that have a place, by the home of the groups."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for payloads in K.buckets_of(batches):
            members, places = [], []
            for part in map(K.unpack, payloads):
                (members if len(part) == 2 else places).append(part)
            if not members or not places:
                continue
            names, *root = map(np.concatenate, zip(*places, strict=True))
            order = np.argsort(names)
            names, root = names[order], [x[order] for x in root]
            g, node = map(np.concatenate, zip(*members, strict=True))
            at = np.minimum(np.searchsorted(names, node), len(names) - 1)
            there = names[at] == node
            g, at = g[there], at[there]
            order = np.lexsort((at, g))
            once = order[K.runs(g[order], at[order])[0]]
            g, at = g[once], at[once]
            if len(g):
                yield _homed(g % n_homes, g, names[at], *[x[at] for x in root])

    return run


def _mixed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, node): groups whose nodes are in two or more components, and their smallest nodes, home by home."""
    for payloads in K.buckets_of(batches):
        g, node, *root = map(np.concatenate, zip(*map(K.unpack, payloads), strict=True))
        order = np.lexsort((node, g))
        g, node, root = g[order], node[order], [x[order] for x in root]
        s, e = K.runs(g)
        first = np.repeat(s, e - s)
        other = np.logical_or.reduceat(np.logical_or.reduce([x != x[first] for x in root]), s)
        keep = np.repeat(other, e - s)
        yield pa.RecordBatch.from_arrays([pa.array(node[first][keep]), pa.array(node[keep])], names=["hub", "node"])


def _elements(shingle: int, n_buckets: int):
    """Packs the elements of grouped nodes by bucket."""
    most = block_bytes(n_buckets, BLOCK_BYTES) // 8

    def flush(names: list[int], sets: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        lengths = np.fromiter(map(len, sets), np.int64, len(sets))
        yield _batch(list(_packed(np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths), np.array(names, np.int64), n_buckets)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sets, size = [], [], 0
        for batch in K.sliced(batches, "text"):
            own = shingle_sets(K.texts_of(batch.column("text")), shingle)
            names += batch.column("node").to_pylist()
            sets += own
            size += sum(map(len, own))
            if size > most:
                yield from flush(names, sets)
                names, sets, size = [], [], 0
        if names:
            yield from flush(names, sets)

    return run


def _shared(n_homes: int):
    """Elements that two or more nodes have, packed by the home of their nodes, some buckets together."""
    most = block_bytes(n_homes, BLOCK_BYTES) // 8

    def flush(key: np.ndarray, node: np.ndarray) -> Iterator[pa.RecordBatch]:
        home = node % n_homes
        order = np.lexsort((node, home))
        key, node, home = key[order], node[order], home[order]
        s, e = K.runs(home)
        rows = []
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            f, g = K.runs(node[a:b])
            rows.append((int(home[a]), K.pack(node[a:b][f], (g - f).astype(np.int32), key[a:b])))
        if rows:
            yield _batch(rows)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, size = [], 0
        for payloads in K.buckets_of(batches):
            have.append(_read(payloads))
            size += len(have[-1][0])
            if size > most:
                yield from flush(*map(np.concatenate, zip(*have, strict=True)))
                have, size = [], 0
        if have:
            yield from flush(*map(np.concatenate, zip(*have, strict=True)))

    return run


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shared, elements): each node's shared elements, from all buckets, home by home."""
    for payloads in K.buckets_of(batches):
        parts: dict[int, list[bytes]] = {}
        for payload in payloads:
            nodes, counts, keys = K.unpack(payload)
            ends = np.cumsum(counts)
            for node, a, b in zip(nodes.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                parts.setdefault(node, []).append(keys[a:b].tobytes())
        names = list(parts)
        for at in range(0, len(names), 512):
            some = names[at : at + 512]
            sets = [b"".join(parts.pop(x)) for x in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([len(x) // 8 for x in sets], pa.int64()), pa.array(sets, pa.binary())], names=["node", "shared", "elements"])


class _Side:
    """One side of a unit: its rows by size, in blocks whose entries are sorted by column."""

    def __init__(self, rows: np.ndarray, sizes: np.ndarray, column: np.ndarray, first: np.ndarray):
        rows = rows[np.argsort(sizes[rows], kind="stable")]
        self.blocks = [rows[at : at + SIDE] for at in range(0, len(rows), SIDE)]
        self.low = [int(sizes[b[0]]) for b in self.blocks]
        self.high = [int(sizes[b[-1]]) for b in self.blocks]
        self.entries = []
        for block in self.blocks:
            n = first[block + 1] - first[block]
            own, col = np.repeat(np.arange(len(block)), n), column[K.ranges(first[block], n)]
            order = np.argsort(col, kind="stable")
            self.entries.append((col[order], own[order]))

    def dense(self, i: int, columns: np.ndarray) -> np.ndarray:
        """Which rows of block i have which of the columns."""
        col, own = self.entries[i]
        lo, hi = np.searchsorted(col, [columns[0], columns[-1] + 1])
        at = np.searchsorted(columns, col[lo:hi])
        hit = columns[np.minimum(at, len(columns) - 1)] == col[lo:hi]
        out = np.zeros((len(self.blocks[i]), len(columns)), np.float32)
        out[own[lo:hi][hit], at[hit]] = 1
        return out


def links_of(sizes: np.ndarray, sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of the links between the rows `left` and `right`, as pairs of rows, and each row's root.

    Blocks of SIDE rows are compared by matrix products over the columns that both have, COLUMNS at a time,
    and not at all where sizes are too far apart or all rows are connected already.
    """
    lengths = np.fromiter(map(len, sets), np.int64, len(sets))
    first = np.concatenate([[0], np.cumsum(lengths)])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, np.int64)
    out, root = [], np.arange(len(sets))
    same = left is right
    a = _Side(left, sizes, column, first)
    b = a if same else _Side(right, sizes, column, first)
    for i, rows in enumerate(a.blocks):
        for j, cols in enumerate(b.blocks):
            if same and j < i or 100 * a.high[i] < percent * b.low[j] or 100 * b.high[j] < percent * a.low[i]:
                continue
            roots = np.concatenate([root[rows], root[cols]])
            if (roots == roots[0]).all():
                continue
            both = np.intersect1d(a.entries[i][0], b.entries[j][0])
            common = np.zeros((len(rows), len(cols)), np.float32)
            for at in range(0, len(both), COLUMNS):
                some = both[at : at + COLUMNS]
                common += a.dense(i, some) @ b.dense(j, some).T
            linked = (100 + percent) * common.astype(np.int64) >= percent * (sizes[rows][:, None] + sizes[cols][None, :])
            for r in np.flatnonzero(linked.any(1)).tolist():
                mine = np.unique(root[np.append(cols[linked[r]], rows[r])])
                for other in mine[1:].tolist():
                    out.append((other, int(mine[0])))
                    root[root == other] = mine[0]
    return out, root


_LINKS_DDL = "a struct<_id:long,_crc:long>, b struct<_id:long,_crc:long>"
_FIRST_DDL = f"{_LINKS_DDL}, hub long, node long"


def _links(table: pa.Table, pairs: list[tuple[int, int]]) -> list[pa.Array]:
    at = np.array(pairs, np.int64).reshape(-1, 2)
    ids, crcs = table.column("_id").to_numpy(), table.column("_crc").to_numpy()
    return [pa.StructArray.from_arrays([pa.array(ids[at[:, k]]), pa.array(crcs[at[:, k]])], names=["_id", "_crc"]) for k in (0, 1)]


def _unit(percent: int):
    """Links of a unit; if its neighbourhood has others, also the nodes that are not connected with the hub."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, K.U64) for x in table.column("elements").to_pylist()]
        rows = np.arange(len(sets))
        pairs, root = links_of(table.column("n").to_numpy(), sets, rows, rows, percent)
        a, b = _links(table, pairs)
        node, hub = table.column("node").to_numpy(), table.column("hub").to_numpy()
        rest = rows[:0]
        if table.column("parts")[0].as_py() > 1:
            rest = np.flatnonzero(root != root[np.flatnonzero(node == hub)[0]])
        none = pa.nulls(len(rest), a.type)
        columns = [pa.chunked_array([x, none]) for x in (a, b)]
        columns += [pa.chunked_array([pa.nulls(len(a), pa.int64()), pa.array(x[rest])]) for x in (hub, node)]
        return pa.table(columns, names=["a", "b", "hub", "node"])

    return run


def _across(percent: int):
    """Links between the rest of a neighbourhood (left) and one of its units (right)."""

    def run(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, K.U64) for x in table.column("elements").to_pylist()]
        left = table.column("left").to_numpy(zero_copy_only=False)
        pairs, _ = links_of(table.column("n").to_numpy(), sets, np.flatnonzero(left), np.flatnonzero(~left), percent)
        return pa.table(_links(table, pairs), names=["a", "b"])

    return run


def _parts(near: DataFrame) -> DataFrame:
    """(hub, parts): in how many units a neighbourhood is dealt."""
    size = F.greatest(F.sum(F.col("shared") * 8) / UNIT_BYTES, F.count("*") / UNIT_ROWS)
    return near.groupBy("hub").agg(F.ceil(size).cast("int").alias("parts"))


def _verified(near: DataFrame, alive: DataFrame, percent: int) -> DataFrame:
    """(a, b): links of all neighbourhoods. near (hub, node, shared); alive (node, n, _id, _crc, elements)."""
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    every = F.sequence(F.lit(0), F.col("parts") - 1)
    placed = matched(near, _parts(near), "hub")
    units = placed.select("hub", "node", "parts", F.explode(F.when(F.col("hub") == F.col("node"), every).otherwise(F.array(own))).alias("unit"))
    first = units.join(alive, "node").groupBy("hub", "unit").applyInArrow(_unit(percent), _FIRST_DDL)
    first = checkpointed(first.repartition(max(1, partitions(near.sparkSession) // HOMES)))  # few and small rows
    links = first.where("a is not null").select("a", "b")
    rest = first.where("hub is not null").select("hub", "node")
    if rest.isEmpty():
        return links
    rest = rest.join(near, ["hub", "node"])
    blocks = rest.join(_parts(rest).withColumnRenamed("parts", "blocks"), "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "blocks")
    counts = placed.select("hub", "parts").distinct().join(blocks.select("hub", "blocks").distinct(), "hub")
    left = blocks.join(counts.select("hub", "parts"), "hub").select("hub", "node", "block", F.explode(every).alias("unit"), F.lit(True).alias("left"))
    right = placed.join(counts.select("hub", "blocks"), "hub").select("hub", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), own.alias("unit"), F.lit(False).alias("left"))
    both = left.unionByName(right).join(alive, "node")
    return links.unionByName(both.groupBy("hub", "block", "unit").applyInArrow(_across(percent), _LINKS_DDL))


def classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(_id, _crc, n, root): every document's set size, and the first document (_id, _crc) of its component."""
    spark = docs.sparkSession
    n = partitions(spark)  # a class is named once in each payload, so a bucket is a whole partition
    rows = keyed(docs).select("_id", "_crc", "text")
    found = checkpointed(dealt(rows.mapInArrow(_sign(shingle, percent, bands(percent), n), _ROWS_DDL)).mapInArrow(_group, _FOUND_DDL))
    members = found.where("payload is null").select("_id", "_crc", "n", "node", "need")
    packed = found.where("payload is not null").select("payload")
    homes = max(1, n // HOMES)
    tallies = dealt(packed.mapInArrow(_tallies(homes), _PACKED_DDL)).mapInArrow(_tallied, "node long, even long, odd long, low long")

    own = F.struct("_id", "_crc")
    one = members.where("n > 0").groupBy("node").agg(F.min(own).alias("d"), F.max(own).alias("last"), F.first("n").alias("n"), F.first("need").alias("need"))
    enough = (F.col("even") >= F.col("need") % (NONE + 1)) | (F.col("odd") >= F.floor(F.col("need") / (NONE + 1)))
    grouped = one.join(tallies, "node").where(enough).select("node", "n", "low", "d._id", "d._crc")
    texts = rows.join(grouped.select("node", "_id", "_crc").hint("shuffle_hash"), ["_id", "_crc"]).select("node", "text")
    elements = dealt(texts.mapInArrow(_elements(shingle, n), _PACKED_DDL))
    shared = dealt(elements.mapInArrow(_shared(n), _PACKED_DDL)).mapInArrow(_gathered, "node long, shared long, elements binary")
    alive = checkpointed(grouped.join(shared, "node").where(F.col("shared") * 100 >= F.col("n") * percent))

    sets = alive.select("node", "n", "_id", "_crc", "elements")
    kept = alive.select(F.col("low").alias("g"), "node", "shared").unionByName(alive.where("low != node").select(F.col("node").alias("g"), "node", "shared"))
    hubs = kept.groupBy("g").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1")
    near = matched(kept, hubs.select("g", "hub"), "g").select("hub", "node", "shared").distinct()
    roots = components(_verified(near, sets, percent))

    firsts = alive.select("node", own.alias("d"))
    places = firsts.join(roots.withColumnRenamed("node", "d"), "d", "left").select("node", F.coalesce("root", "d").alias("root"))
    held = packed.mapInArrow(_members(homes), _PACKED_DDL).unionByName(places.select("node", "root.*").mapInArrow(_places(homes), _PACKED_DDL))
    mixed = dealt(dealt(held).mapInArrow(_placed(homes), _PACKED_DDL)).mapInArrow(_mixed, "hub long, node long")
    near = checkpointed(mixed.distinct().join(alive.select("node", "shared"), "node"))
    if not near.isEmpty():
        more = _verified(near, sets, percent)
        roots = components(more.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    linked = firsts.join(roots.withColumnRenamed("node", "d"), "d").select("node", "root")
    named = one.join(linked, "node", "left").where("root is not null or d != last").select("node", F.coalesce("root", "d").alias("root"))
    return matched(members, named, "node", "left").select("_id", "_crc", "n", F.coalesce("root", own).alias("root"))


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles and component_id, the smallest doc_id reachable by links."""
    low = F.when(F.col("n") > 0, F.col("root._id")).otherwise(F.col("_id"))
    null = F.lit(LEAST)
    return classes(docs, shingle, percent).select(F.nullif("_id", null).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(low, null).alias("component_id"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, its columns unchanged, with one document of each component: the first by doc_id.

    Documents with an empty set stay; of rows that repeat doc_id and text one stays.
    """
    first = (F.col("n") == 0) | ((F.col("root._id") == F.col("_id")) & (F.col("root._crc") == F.col("_crc")))
    stay = classes(docs, shingle, percent).where(first).select("_id", "_crc").distinct()
    i, c, r = (fresh(docs.columns, x) for x in ("key_id", "key_crc", "key_row"))
    own = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)), c: F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))})
    left = own.join(stay.select(F.col("_id").alias(i), F.col("_crc").alias(c)).hint("shuffle_hash"), [i, c], "left_semi")
    once = left.withColumn(r, F.row_number().over(Window.partitionBy(i, c).orderBy(F.lit(0))))
    return once.where(F.col(r) == 1).select(*[F.col(f"`{x}`") for x in docs.columns])
