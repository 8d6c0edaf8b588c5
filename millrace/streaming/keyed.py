"""Near-duplicate removal over a stream, with the keys of kept documents in keyed state (ST2).

    prepare_by_state(docs, output, interval) -> a running query

State is one flag for each (band, key) that a kept document has, held by a state store, so a batch asks
for the keys it has and reads nothing of earlier batches. A batch goes through three steps: the stateful operator
tells each row (document, band, key) whether its key is taken; documents with a taken key are dropped, and the others of the
batch are decided by the batch rule; the keys of those that are kept are written as a small table. That table is a
second source of the same stream: its rows arrive with the next batch, in which a key's flag is set before its documents are told.

A batch is told apart by its number. One that runs again replaces what it wrote, and the keys that it wrote before are
not read, as the next batch lists the folder after it. Keys may be forgotten: with `remember` a key counts for that long.

Columns of docs travel beside one of a document's rows, so a text passes the stateful operator once.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from millrace.functions.checkpoints import checkpointed
from millrace.operators import dedup, quality

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KEYS = "band int, key long, batch long"


class Taken(StatefulProcessor):
    """Sets a key's flag where a kept document has it, and tells documents whether it is set."""

    def __init__(self, remember: timedelta | None = None):
        self.remember = remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = int(self.remember.total_seconds() * 1000) if self.remember else None
        self.flag = handle.getValueState("taken", "taken boolean", ttlDurationMs=ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:  # noqa: N802, N803
        rows = list(rows)
        documents = [r for r in rows if r.ord is not None]
        if len(documents) < len(rows):
            self.flag.update((True,))
        if documents:
            taken = key[0] >= 0 and (len(documents) < len(rows) or self.flag.exists())
            for r in documents:
                yield Row(ord=r.ord, band=r.band, key=r.key, taken=taken, doc=r.doc)

    def close(self) -> None:
        pass


def _settled(told: DataFrame, batch: int, output: str) -> None:
    """Decides a batch, and writes its kept documents and their keys."""
    told = checkpointed(told)
    if told.isEmpty():  # a batch of keys only, or one that lets keys expire
        return
    known = told.where("taken").select("ord").distinct()
    new = checkpointed(told.where("band >= 0").join(known, "ord", "left_anti").select("ord", "band", "key"))
    kept = checkpointed(dedup.greedy_kept(new))
    docs = told.where("band < 0").join(kept, "ord", "left_semi").select("doc.*")
    docs.write.mode("overwrite").parquet(f"{output}/documents/batch={batch}")
    keys = new.join(kept, "ord", "left_semi").select("band", "key").distinct()
    if not keys.isEmpty():
        keys.coalesce(max(1, int(told.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)).write.mode("overwrite").parquet(f"{output}/keys/batch={batch}")


def prepare_by_state(docs: DataFrame, output: str, order: str = "doc_id", remember: timedelta | None = None, **trigger: object) -> StreamingQuery:
    """A running query over a streaming documents table; the same documents stay as when the batch rule takes them in the order of batches.

    `trigger` is not availableNow, whose end is fixed before the first batch has written its keys.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    _empty(spark, f"{output}/keys")
    passed = quality.quality_filter(docs)
    named = passed.select(F.col(order).cast("long").alias("ord"), "text", F.struct(*docs.columns).alias("doc"))
    kind = named.schema["doc"].dataType
    bands = dedup.band_rows(named, "ord").withColumn("doc", F.lit(None).cast(kind))
    # a document's columns, under a band of its own, which no other document has
    whole = named.select("ord", F.lit(-1).alias("band"), F.col("ord").alias("key"), "doc")
    known = spark.readStream.schema(KEYS).parquet(f"{output}/keys").select(F.lit(None).cast("long").alias("ord"), "band", "key", F.lit(None).cast(kind).alias("doc"))
    rows = bands.unionByName(whole).unionByName(known)
    schema = rows.withColumn("taken", F.lit(True)).select("ord", "band", "key", "taken", "doc").schema
    told = rows.groupBy("band", "key").transformWithState(Taken(remember), schema, "Append", "ProcessingTime" if remember else "None")
    write = told.writeStream.foreachBatch(lambda df, n: _settled(df, n, output)).option("checkpointLocation", f"{output}/progress")
    return write.trigger(**(trigger or {"processingTime": "1 second"})).start()


def _empty(spark: SparkSession, folder: str) -> None:
    """The folder, with a table of no rows, if there is none."""
    from millrace.functions import files

    if not files.exists(spark, folder):
        spark.createDataFrame([], "band int, key long").coalesce(1).write.parquet(f"{folder}/batch=-1")
