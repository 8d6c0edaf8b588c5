"""Corpus preparation and running statistics over streams (ST1-ST6).

Near-duplicate removal against all earlier batches keeps the bands of kept documents in a table, as the
batch form keeps them in a join; a batch's own order decides within it. Each batch writes under its
number, so a batch that is run again replaces what it wrote and state stays exact.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions import files
from millrace.functions.checkpoints import checkpointed
from millrace.operators import dedup, packing, quality
from millrace.sources import tokenfile


def _earlier(spark: SparkSession, folder: str, batch: int) -> DataFrame | None:
    """What batches before this one have written; the first batch finds nothing."""
    if not files.exists(spark, folder):
        return None
    bands = spark.read.schema("ord long, band int, key long, batch long").parquet(folder)
    return bands.where(F.col("batch") < batch).select("band", "key")


def prepare_batch(spark: SparkSession, docs: DataFrame, batch: int, output: str) -> None:
    """Filters a batch, removes near-duplicates of kept documents of this and earlier ones, and writes it."""
    passed = checkpointed(quality.quality_filter(docs))
    rows = checkpointed(dedup.band_rows(passed))
    earlier = _earlier(spark, f"{output}/bands", batch)
    if earlier is not None:
        rows = rows.join(rows.join(earlier, ["band", "key"], "left_semi").select("ord").distinct(), "ord", "left_anti")
    kept = checkpointed(dedup.greedy_kept(rows))
    rows.join(kept, "ord", "left_semi").write.mode("overwrite").parquet(f"{output}/bands/batch={batch}")
    passed.join(kept.withColumnRenamed("ord", "doc_id"), "doc_id", "left_semi").write.mode("overwrite").parquet(f"{output}/documents/batch={batch}")


def prepare_stream(docs: DataFrame, output: str, **trigger: object) -> StreamingQuery:
    """A running query over a streaming documents table; trigger as DataStreamWriter takes it."""
    spark = docs.sparkSession
    write = docs.writeStream.foreachBatch(lambda df, n: prepare_batch(spark, df, n, output))
    return write.option("checkpointLocation", os.path.join(output, "progress")).trigger(**(trigger or {"availableNow": True})).start()


_REST = "n_sequences long, n_documents long, n_tokens long, ids array<int>"


def pack_batch(spark: SparkSession, docs: DataFrame, batch: int, output: str, length: int, order: str = "ord", ids: str = "ids", tokens: str | None = None) -> None:
    """Packs a batch's token arrays behind what earlier batches left over; whole sequences are written, the rest waits.

    The rest is shorter than a sequence. It is kept with its batch's number, so a batch that runs again starts from the
    same place and replaces what it wrote. Sequences go to Parquet below `output`, or to the token file at `tokens`.
    """
    before = spark.read.schema(_REST).parquet(f"{output}/rest/batch={batch - 1}").first() if batch else None
    n_sequences, n_documents, left = (before.n_sequences, before.n_documents, before.ids) if before else (0, 0, [])
    new = checkpointed(docs.where(F.size(ids) > 0).select(F.col(order).cast("long").alias("ord"), F.col(ids).alias("ids")))
    first = spark.createDataFrame([(-(1 << 62), left)] if left else [], "ord long, ids array<int>")
    packed = checkpointed(packing.pack(new.unionByName(first), "ord", "ids", length).select("seq_id", "input_ids"))
    added, count = new.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)), F.count("*")).first()
    whole, tail = divmod(len(left) + added, length)
    sequences = packed.where(F.col("seq_id") < whole).withColumn("seq_id", F.col("seq_id") + n_sequences)
    _flush(sequences, batch, output, tokens)
    rest = packed.where(F.col("seq_id") == whole).first().input_ids[:tail] if tail else []
    state = spark.createDataFrame([(n_sequences + whole, n_documents + count, (n_sequences + whole) * length + tail, rest)], _REST)
    state.coalesce(1).write.mode("overwrite").parquet(f"{output}/rest/batch={batch}")


def _flush(sequences: DataFrame, batch: int, output: str, tokens: str | None) -> None:
    """What a batch has packed, in place of what it wrote when it ran before."""
    if tokens is None:
        sequences.write.mode("overwrite").parquet(f"{output}/sequences/batch={batch}")
    else:
        tokenfile.write_tokens(sequences, tokens, "append", commit=f"batch-{batch}")


def pack_stream(docs: DataFrame, output: str, length: int, order: str = "ord", ids: str = "ids", tokens: str | None = None, **trigger: object) -> StreamingQuery:
    """A running query that packs a stream of token arrays; `finish_packing` pads what is left when it has ended."""
    spark = docs.sparkSession
    write = docs.writeStream.foreachBatch(lambda df, n: pack_batch(spark, df, n, output, length, order, ids, tokens))
    return write.option("checkpointLocation", os.path.join(output, "progress")).trigger(**(trigger or {"availableNow": True})).start()


def finish_packing(spark: SparkSession, output: str, length: int, tokens: str | None = None) -> dict[str, int]:
    """Writes the last sequence, filled up with id 0, and counts documents, sequences and tokens (in whole sequences)."""
    last = spark.read.schema(f"{_REST}, batch long").parquet(f"{output}/rest").orderBy(F.desc("batch")).first()
    n_sequences = last.n_sequences
    if last.ids:
        rows = spark.createDataFrame([(n_sequences, [*last.ids, *[0] * (length - len(last.ids))])], "seq_id long, input_ids array<int>")
        _flush(rows.coalesce(1), last.batch + 1, output, tokens)
        n_sequences += 1
    return {"documents": last.n_documents, "sequences": n_sequences, "tokens": n_sequences * length}


def recurrence_stream(events: DataFrame, run: str, order: str, a: str, b: str) -> DataFrame:
    """(run, order, h) of h = a * h before + b over a stream; a run's state is one number."""

    def step(key: tuple, parts, state: GroupState):
        (h,) = state.get if state.exists else (0.0,)
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for x, y in zip(rows[a], rows[b], strict=True):
            h = x * h + y
            out.append(h)
        state.update((h,))
        yield pd.DataFrame({run: rows[run], order: rows[order], "h": out})

    types = dict(events.dtypes)
    return events.groupBy(run).applyInPandasWithState(step, f"{run} {types[run]}, {order} {types[order]}, h double", "h double", "append", GroupStateTimeout.NoTimeout)
