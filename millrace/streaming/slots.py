"""An endless stream of slots for a weighted mix of sources (ST1), the same slots as `mixing.round_slots` has.

    spark.dataSource.register(RoundSlots)
    spark.readStream.format("round_slots").option("pattern", json.dumps({"a": 30, "b": 70})).option("notes", folder).load()  -> slot, source, ordinal

Each round has exactly the pattern's counts in an order of its own, which depends on the seed and the round
alone. A batch has `rounds` rounds, cut into ranges of `range` rounds, one for each task, which makes its slots itself; the
driver knows numbers of rounds only. The offset is the next round. A source is not told where a query that starts again
stands, so it notes the end of each batch in `notes`, a folder in any store (beside the checkpoint, say), before the batch
runs; without that folder a query cannot be started again. Joined with pools that are
numbered by source it is a stream of documents that never ends (`mixed`).
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from millrace.functions.joins import fresh
from millrace.functions.prefix import running_sum
from millrace.operators.mixing import ROUND


def round_of(number: int, pattern: dict[str, int], seed: int) -> list[tuple[int, str, int]]:
    """(slot, source, ordinal) of one round."""
    names = [s for s, n in pattern.items() for _ in range(n)]
    order = sorted(range(len(names)), key=lambda at: (md5(f"{seed}|{number}|{at}".encode()).hexdigest(), at))
    seen = dict.fromkeys(pattern, 0)
    out = []
    for place, at in enumerate(order):
        source = names[at]
        out.append((number * len(names) + place, source, number * pattern[source] + seen[source]))
        seen[source] += 1
    return out


@dataclass
class _Rounds(InputPartition):
    start: int
    stop: int


class RoundSlots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "round_slots"

    def schema(self) -> str:
        return "slot long, source string, ordinal long"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        return _Reader(json.loads(o["pattern"]) if "pattern" in o else dict(ROUND), int(o.get("seed", 42)), int(o.get("rounds", 1)), int(o.get("range", 16)), o.get("notes"))


class _Reader(DataSourceStreamReader):
    def __init__(self, pattern: dict[str, int], seed: int, rounds: int, step: int, notes: str | None):
        self.pattern, self.seed, self.rounds, self.step, self.notes = pattern, seed, rounds, step, notes
        self.next = self._noted()

    def _noted(self) -> int:
        if self.notes is None:
            return 0
        store, root = pafs.FileSystem.from_uri(self.notes)
        names = [x.base_name for x in store.get_file_info(pafs.FileSelector(root, allow_not_found=True))]
        return max((int(x) for x in names if x.isdigit()), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"round": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"round": self.next + self.rounds}

    def partitions(self, start: dict, end: dict) -> list[_Rounds]:
        first, last = start["round"], end["round"]
        if last < first:
            raise ValueError("the option notes is needed to go on after a restart")
        self.next = max(self.next, last)
        if self.notes is not None and last > self._noted():
            store, root = pafs.FileSystem.from_uri(self.notes)
            store.create_dir(root, recursive=True)
            before = self._noted()
            with store.open_output_stream(f"{root}/{last}") as f:
                f.write(b"")
            if before:
                store.delete_file(f"{root}/{before}")
        return [_Rounds(k, min(k + self.step, last)) for k in range(first, last, self.step)]

    def read(self, partition: _Rounds) -> Iterator[pa.RecordBatch]:
        for k in range(partition.start, partition.stop):
            slot, source, ordinal = zip(*round_of(k, self.pattern, self.seed), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(source, pa.string()), pa.array(ordinal, pa.int64())], names=["slot", "source", "ordinal"])


def mixed(slots: DataFrame, pools: dict[str, DataFrame], order: str) -> DataFrame:
    """A stream of slots with the rows of static pools (`order` and other columns, the same in all), each going round."""
    taken = [*slots.columns, *(c for pool in pools.values() for c in pool.columns)]
    one, at, size = (fresh(taken, x) for x in ("one", "at", "size"))
    parts = None
    for source, pool in pools.items():
        numbered = running_sum(pool.withColumn(one, F.lit(1)), order, one, at).drop(one)
        own = numbered.withColumns({"source": F.lit(source), size: F.lit(max(1, pool.count()))})
        parts = own if parts is None else parts.unionByName(own)
    sizes = parts.select("source", size).distinct()
    placed = slots.join(F.broadcast(sizes), "source").withColumn(at, F.col("ordinal") % F.col(size)).drop(size)
    return placed.join(parts.drop(size), ["source", at]).drop(at)
