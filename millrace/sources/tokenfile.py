"""Token files: headless files of unsigned 16-bit tokens, as a Spark data source and sink, batch and streaming.

    spark.dataSource.register(TokenFiles)
    spark.read.format("tokenfile").option("length", 4096).load(path)   -> seq_id, input_ids
    df.write.format("tokenfile").mode("append").save(path)             <- seq_id, input_ids
    df.writeStream.format("tokenfile").option("checkpointLocation", c).start(path)

`path` is a file or a folder in any store that pyarrow reaches from all executors: /..., file://, hdfs://, s3://, gs://.

A folder holds part files, each written once under a name of its own, and commits. A commit lists the
stretches of part files that one write added, in order, and is itself written in one step: what no commit lists
does not count. An append is one more commit; an overwrite is a commit that hides those before it, whose files go afterwards.
A write may name its commit. Writing under a name again replaces what was written under it, in its old
place, so a batch of a stream that runs again changes nothing. A folder without commits is read by the names of its *.bin files.

The reader sees one run of tokens, cut every `length`, wherever parts begin and end. The tail short of a sequence
is dropped. Reading is split in ranges of whole sequences; a task reads the bytes of its ranges only.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

SCHEMA = "seq_id long, input_ids array<int>"
RANGE = 1024
WIDTH = 2  # bytes of a token


@dataclass
class Stretch:
    """Tokens of a part file, from the byte `start` on. `first` and `last` are the sequences that were written there."""

    file: str
    start: int
    tokens: int
    first: int = 0
    last: int = 0


@dataclass
class _Range(InputPartition):
    first: int
    count: int
    stretches: list[Stretch]


@dataclass
class _Written(WriterCommitMessage):
    stretches: list[Stretch]


class Folder:
    """A token file's place in its store."""

    def __init__(self, path: str):
        self.store, self.root = pafs.FileSystem.from_uri(path)

    def _names(self) -> list[str]:
        return sorted(x.base_name for x in self.store.get_file_info(pafs.FileSelector(self.root, allow_not_found=True)) if x.is_file)

    def at(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def commits(self) -> list[tuple[int, str]]:
        """(number, name) of what has been committed and not been hidden, in order."""
        found = [(int(m[1]), m[3], m[2]) for x in self._names() if (m := re.fullmatch(r"commit-(\d+)-([ar])-(.+)\.json", x))]
        hides = max((n for n, _, kind in found if kind == "r"), default=0)
        return sorted((n, name) for n, name, _ in found if n >= hides)

    def _file_of(self, number: int, name: str) -> str:
        return next(x for x in self._names() if re.fullmatch(rf"commit-{number:012d}-[ar]-{re.escape(name)}\.json", x))

    def _read(self, number: int, name: str) -> list[Stretch]:
        with self.store.open_input_stream(self.at(self._file_of(number, name))) as f:
            return [Stretch(*x) for x in json.loads(f.read())]

    def stretches(self) -> list[Stretch]:
        """All tokens in order."""
        if self.store.get_file_info(self.root).type == pafs.FileType.File:
            return [Stretch("", 0, self.store.get_file_info(self.root).size // WIDTH)]
        commits = self.commits()
        return [s for n, name in commits for s in self._read(n, name)] if commits else self._plain()

    def _plain(self) -> list[Stretch]:
        """Files that other programs wrote."""
        names = [x for x in self._names() if x.endswith(".bin") and not re.fullmatch(r"part-[0-9a-f]{32}\.bin", x)]
        return [Stretch(x, 0, self.store.get_file_info(self.at(x)).size // WIDTH) for x in names]

    def read(self, s: Stretch) -> bytes:
        with self.store.open_input_file(self.at(s.file)) as f:
            return f.read_at(s.tokens * WIDTH, s.start)

    def commit(self, written: list[Stretch], name: str | None, overwrite: bool) -> None:
        """Adds what was written, in the order of its sequences."""
        written = sorted(written, key=lambda s: s.first)
        if any(a.last >= b.first for a, b in zip(written, written[1:], strict=False)):
            raise ValueError("sequences of several tasks overlap; use write_tokens or stream_tokens")
        old = self.commits()
        again = next(((n, x) for n, x in old if x == name), None)
        number = again[0] if again and not overwrite else max((n for n, _ in old), default=0) + 1
        file = f"commit-{number:012d}-{'r' if overwrite else 'a'}-{name or uuid.uuid4().hex}.json"
        replaced = old if overwrite else [again] if again else []
        if again and not overwrite:
            file = self._file_of(*again)
        gone = [s.file for n, x in replaced for s in self._read(n, x)]
        stale = [self._file_of(n, x) for n, x in replaced]
        self.store.create_dir(self.root, recursive=True)
        plain = [] if old else self._plain()
        if plain and not overwrite:
            self._write("commit-000000000000-a-plain.json", plain)
        self._write(file, written)
        for x in [*gone, *(s.file for s in plain if overwrite), *(x for x in stale if x != file)]:
            self._delete(x)

    def _write(self, file: str, stretches: list[Stretch]) -> None:
        temporary = self.at(f"{file}.{uuid.uuid4().hex}.tmp")
        with self.store.open_output_stream(temporary) as f:
            f.write(json.dumps([[s.file, s.start, s.tokens, s.first, s.last] for s in stretches]).encode())
        self.store.move(temporary, self.at(file))

    def _delete(self, name: str) -> None:
        if self.store.get_file_info(self.at(name)).type == pafs.FileType.File:
            self.store.delete_file(self.at(name))

    def vacuum(self) -> int:
        """Deletes part files that no commit lists, as lost tasks leave them; how many. No write may be under way."""
        listed = {s.file for s in self.stretches()}
        extra = [x for x in self._names() if (x.startswith("part-") and x not in listed) or x.endswith(".tmp")]
        for x in extra:
            self._delete(x)
        return len(extra)


class TokenFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tokenfile"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("length", 4096)), int(self.options.get("range", RANGE)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], overwrite, self.options.get("commit"), int(self.options.get("fill", 1)))

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options["path"], self.options.get("commit", "batch"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, length: int, step: int):
        self.path, self.length, self.step = path, length, step

    def partitions(self) -> list[_Range]:
        stretches = Folder(self.path).stretches()
        n = sum(s.tokens for s in stretches) // self.length
        out, left, skip = [], iter(stretches), 0
        now = next(left, None)
        for first in range(0, n, self.step):
            count = min(self.step, n - first)
            missing, own = count * self.length, []
            while missing:
                take = min(missing, now.tokens - skip)
                if take:
                    own.append(Stretch(now.file, now.start + skip * WIDTH, take))
                missing, skip = missing - take, skip + take
                if skip == now.tokens:
                    now, skip = next(left, None), 0
            out.append(_Range(first, count, own))
        return out

    def read(self, part: _Range | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        folder = Folder(self.path)
        tokens = np.frombuffer(b"".join(map(folder.read, part.stretches)), "<u2")
        lists = pa.ListArray.from_arrays(pa.array(np.arange(part.count + 1) * self.length, pa.int32()), pa.array(tokens.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.count) + part.first), lists], names=["seq_id", "input_ids"])


def _tokens(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False)


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


class _Part:
    """A new part file."""

    def __init__(self, path: str):
        self.folder, self.name, self.size = Folder(path), f"part-{uuid.uuid4().hex}.bin", 0
        self.folder.store.create_dir(self.folder.root, recursive=True)
        self.out = self.folder.store.open_output_stream(self.folder.at(self.name))

    def write(self, tokens: np.ndarray) -> None:
        self.out.write(tokens.astype("<u2").tobytes())
        self.size += len(tokens)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, name: str | None, fill: int = 1):
        self.path, self.overwrite, self.commit_name, self.fill = path, overwrite, name, fill

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """One part file of a task's sequences, which must come in order (see `write_tokens`)."""
        part, first, last = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = _column(batch, "seq_id").to_numpy()
            if (last is not None and ids[0] <= last) or (np.diff(ids) <= 0).any():
                raise ValueError("sequences of a task are not in order; use write_tokens")
            if part is None:
                part, first = _Part(self.path), int(ids[0])
            part.write(_tokens(_column(batch, "input_ids")))
            last = int(ids[-1])
        if part is None:
            return _Written([])
        part.out.close()
        return _Written([Stretch(part.name, 0, part.size, first, last)])

    def commit(self, messages: list) -> None:
        written = [s for m in messages if m for s in m.stretches]
        missing = -sum(s.tokens for s in written) % self.fill
        if missing:
            end, part = max(s.last for s in written) + 1, _Part(self.path)
            part.write(np.zeros(missing, np.int64))
            part.out.close()
            written.append(Stretch(part.name, 0, missing, end, end))
        Folder(self.path).commit(written, self.commit_name, self.overwrite)

    def abort(self, messages: list) -> None:
        folder = Folder(self.path)
        for m in messages:
            for s in m.stretches if m else ():
                folder._delete(s.file)


class _StreamWriter(DataSourceStreamArrowWriter):
    """A micro-batch is one commit under its number."""

    def __init__(self, path: str, name: str):
        self.path, self.name = path, name

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        """One part file of a task's share of the batch, sorted; a stretch for each run of consecutive sequences."""
        rows: list[tuple[int, np.ndarray]] = []
        for batch in batches:
            lists = _column(batch, "input_ids")
            rows += zip(_column(batch, "seq_id").to_pylist(), (_tokens(lists.slice(i, 1)) for i in range(len(lists))), strict=True)
        if not rows:
            return _Written([])
        rows.sort(key=lambda r: r[0])
        part, out = _Part(self.path), []
        for seq_id, tokens in rows:
            if out and seq_id == out[-1].last + 1:
                out[-1].last = seq_id
                out[-1].tokens += len(tokens)
            else:
                out.append(Stretch(part.name, part.size * WIDTH, len(tokens), seq_id, seq_id))
            part.write(tokens)
        part.out.close()
        return _Written(out)

    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        Folder(self.path).commit([s for m in messages if m for s in m.stretches], f"{self.name}-{batchId}", overwrite=False)

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        _Writer(self.path, False, None).abort(messages)


def write_tokens(sequences: DataFrame, path: str, mode: str = "overwrite", parts: int | None = None, commit: str | None = None) -> None:
    """Sequences (seq_id, input_ids) in the order of seq_id, in place of what is at `path` or (append) behind it.

    Written again under the same `commit`, they replace what was written under it.
    """
    spark = sequences.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = sequences.select("seq_id", "input_ids")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = rows.repartitionByRange(n, "seq_id").sortWithinPartitions("seq_id").write.format("tokenfile").mode(mode)
    (out.option("commit", commit) if commit else out).save(path)


def write_in_order(tokens: DataFrame, path: str, fill: int, mode: str = "overwrite", commit: str | None = None) -> None:
    """Tokens (input_ids: of any number) in the order of their partitions and, in these, of their rows; filled up with zeros to
    a multiple of `fill`. Nothing is shuffled, and a reader of that length finds them packed."""
    spark = tokens.sparkSession
    spark.dataSource.register(TokenFiles)
    rows = tokens.select(F.monotonically_increasing_id().alias("seq_id"), "input_ids")
    out = rows.write.format("tokenfile").option("fill", fill).mode(mode)
    (out.option("commit", commit) if commit else out).save(path)


def stream_tokens(sequences: DataFrame, path: str, progress: str, run: int = RANGE, **trigger: object) -> StreamingQuery:
    """A running query that appends a stream of sequences (seq_id, input_ids); each batch's are behind those of earlier ones."""
    spark = sequences.sparkSession
    spark.dataSource.register(TokenFiles)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = sequences.select("seq_id", "input_ids").repartition(n, F.floor(F.col("seq_id") / run))
    return rows.writeStream.format("tokenfile").option("checkpointLocation", progress).trigger(**(trigger or {"availableNow": True})).start(path)


def concatenate(path: str, to: str) -> int:
    """All tokens as one plain file at another place; how many."""
    folder = Folder(path)
    store, place = pafs.FileSystem.from_uri(to)
    stretches = folder.stretches()
    with store.open_output_stream(place) as out:
        for s in stretches:
            for at in range(0, s.tokens, 1 << 24):
                out.write(folder.read(Stretch(s.file, s.start + at * WIDTH, min(1 << 24, s.tokens - at))))
    return sum(s.tokens for s in stretches)
