"""Token counts of whole texts by distinct pre-tokens.

A block of documents is cut into pre-tokens and reduced to per-document frequencies. What travels is,
for each bucket of pre-tokens and block, the distinct pre-tokens with packed (document, frequency)
pairs. In its bucket a pre-token's pieces are counted once, the count is joined to the frequencies
of all blocks, and the products, one packed row for each block and bucket, are summed by document. No
list of ids is kept anywhere. A very common pre-token costs one entry for each block, however many
documents hold it.

A block is named by its documents and holds them in order, so a task that runs again makes the same parts if
its blocks have the same documents. Those of files do; documents that come out of a shuffle in no fixed
order, and in several blocks a task, should be checkpointed before. An unfit part is an error, never a wrong count.

A special string of the vocabulary file inside a text is one token, as the library's default has it.

Defined results: null or empty text has 0 bytes and 0 tokens; rows that repeat doc_id and text are
one document and get the same count each.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _kernel as K
from millrace.llm._rows import block_bytes, dealt, keyed, partitions

BLOCK_BYTES = 16 << 20
MAX_TOKENS = 1024
KNOWN_PIECES = 1_000_000  # a worker's memory of counted pre-tokens; counting again after that is only slower

# Fixed value: the pre-token pattern of byte-level vocabularies of this kind.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

PACKED = pa.schema([("bucket", pa.int32()), ("payload", pa.binary())])
PARTS = pa.schema([("block", pa.int64()), ("payload", pa.binary())])
COUNTS = pa.schema([("_id", pa.int64()), ("_crc", pa.int64()), ("n_tokens", pa.int64())])


def specials(path: str) -> list[str]:
    """Strings that the file marks as special tokens, the longest first."""
    with open(path, encoding="utf-8") as f:
        return sorted((x["content"] for x in json.load(f).get("added_tokens", ()) if x.get("special")), key=len, reverse=True)


def _frequencies(path: str, n_buckets: int):
    def pack(rows: list[tuple[int, int, str]], split, find, special: set[str]) -> pa.RecordBatch:
        rows = sorted(dict.fromkeys(rows), key=lambda r: r[:2])  # in whatever order they came
        table: dict[str, int] = {}
        code, freq, counts = [], [], []
        for _, _, text in rows:
            if split is None:
                count = Counter(find(text))
            else:
                count = Counter()
                for part in split(text):
                    count.update((part,) if part in special else find(part))
            code.extend([table.setdefault(t, len(table)) for t in count])
            freq.extend(count.values())
            counts.append(len(count))
        tokens = list(table)
        doc = np.repeat(np.arange(len(rows), dtype=np.uint32), counts)
        code, freq = np.array(code, np.int64), np.array(freq, np.uint32)
        bucket = np.fromiter((zlib.crc32(t.encode("utf-8", "surrogatepass")) % n_buckets for t in tokens), np.int64, len(tokens))
        by_bucket = np.argsort(bucket, kind="stable")
        rank = np.empty(len(tokens), np.int64)
        rank[by_bucket] = np.arange(len(tokens))
        order = np.argsort(rank[code], kind="stable")
        pairs = np.bincount(rank[code], minlength=len(tokens)).astype(np.uint32)
        at = np.concatenate([[0], np.cumsum(pairs, dtype=np.int64)])
        edges = np.searchsorted(bucket[by_bucket], np.arange(n_buckets + 1))
        ids, crcs = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        block = int(np.sum(K.mix(ids.astype(K.U64) + K.mix(crcs.astype(K.U64)))) >> K.U64(1))
        doc = doc.astype(np.uint16) if len(rows) < 1 << 16 else doc
        out = []
        for b in range(n_buckets):
            lo, hi = edges[b], edges[b + 1]
            head = (ids, crcs, len(code)) if b == block % n_buckets else None
            if lo == hi and not head:
                continue
            these = order[at[lo] : at[hi]]
            f = freq[these]
            f = f.astype(np.uint8) if not len(f) or f.max() < 256 else f
            out.append((b, K.pack(block, [tokens[i] for i in by_bucket[lo:hi]], pairs[lo:hi], doc[these], f, head)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], schema=PACKED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(PATTERN).findall
        special = specials(path)
        split = regex.compile("(" + "|".join(map(regex.escape, special)) + ")").split if special else None
        rows: list[tuple[int, int, str]] = []
        size, most = 0, block_bytes(n_buckets, BLOCK_BYTES)
        for batch in K.sliced(batches, "text"):
            rows += zip(batch.column("_id").to_pylist(), batch.column("_crc").to_pylist(), (t or "" for t in batch.column("text").to_pylist()), strict=True)
            size += batch.nbytes
            if size >= most:
                yield pack(rows, split, find, set(special))
                rows, size = [], 0
        if rows:
            yield pack(rows, split, find, set(special))

    return run


def _counted(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        pieces: dict[str, int] = {}
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                block, tokens, pairs, doc, freq, head = K.unpack(payload)
                if len(pieces) > KNOWN_PIECES:
                    pieces.clear()
                new = [t for t in tokens if t not in pieces]
                for at in range(0, len(new), 4096):
                    part = new[at : at + 4096]
                    pieces.update(zip(part, map(len, tokenizer.encode_batch_fast(part, add_special_tokens=False)), strict=True))
                each = np.fromiter((pieces[t] for t in tokens), np.int64, len(tokens))
                sums = np.bincount(doc, np.repeat(each, pairs) * freq).astype(np.int64)
                some = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([K.pack(np.diff(some, prepend=0).astype(np.int32), sums[some], len(doc), head)], pa.binary())], schema=PARTS)

    return run


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up a block's parts; a block whose parts are not those of one computation is an error."""
    sums: dict[int, np.ndarray] = {}
    heads: dict[int, tuple] = {}
    pairs: Counter = Counter()
    for batch in batches:
        for block, payload in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist(), strict=True):
            steps, values, n, head = K.unpack(payload)
            pairs[block] += n
            if head:
                heads[block] = head
            at = np.cumsum(steps)
            have = sums.get(block, np.zeros(0, np.int64))
            if len(at) and at[-1] >= len(have):
                have = np.concatenate([have, np.zeros(at[-1] + 1 - len(have), np.int64)])
            have[at] += values
            sums[block] = have
    for block, have in sums.items():
        ids, crcs, n = heads.get(block, ((), (), 0))
        if block not in heads or (pairs[block] % n if n else pairs[block]):
            raise RuntimeError("the parts of a block of documents do not fit together: docs gave other rows when a lost task ran again; checkpoint them first")
        have = np.concatenate([have, np.zeros(len(ids) - len(have), np.int64)]) // max(1, pairs[block] // max(1, n))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(crcs), pa.array(have)], schema=COUNTS)


def token_counts(docs: DataFrame, path: str, limit: int = MAX_TOKENS) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    `path` is a vocabulary file of the tokenizers library, present on every worker.
    """
    n = partitions(docs.sparkSession)
    rows = keyed(docs)
    packed = rows.select("_id", "_crc", "text").mapInArrow(_frequencies(path, n), "bucket int, payload binary")
    parts = dealt(packed).select("payload").mapInArrow(_counted(path), "block long, payload binary")
    sums = parts.repartition(n, "block").mapInArrow(_summed, "_id long, _crc long, n_tokens long")
    # rows that repeat doc_id and text may stand in several blocks
    counts = sums.groupBy("_id", "_crc").agg(F.max("n_tokens").alias("n_tokens"))
    sized = rows.select("_id", "_crc", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    n_tokens = F.coalesce("n_tokens", F.lit(0).cast("long"))
    return sized.join(counts, ["_id", "_crc"], "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
