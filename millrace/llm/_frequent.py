"""Which n-grams are so frequent that they should not name a bucket.

Minimisers and anchors are n-grams with the smallest hash. A stock phrase with a small hash would draw
a fixed share of any corpus into one bucket, each time in other words. So n-grams come in the order of
(frequent, hash): one that stands in many documents is taken only where a window has no other.

Frequent are the cells of a table of 2 ** BITS cells, dealt by hash, whose n-grams stand in SHARE of a
hash sample of about SAMPLE_DOCS documents. The table only orders n-grams: it is fixed before the plan
is made, the same for all tasks, and of one size whatever the corpus; results do not depend on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import _kernel as K

BITS = 20
SAMPLE_DOCS = 512
SHARE = 0.02
LEAST_DOCS = 10


def frequent(docs: DataFrame, grams: Callable[[bytes], np.ndarray]) -> bytes:
    """The table as bits. `grams` gives the hashes of a text's n-grams; docs has the columns _id and text."""
    n = docs.count()
    sample = docs if n <= SAMPLE_DOCS else docs.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < int(SAMPLE_DOCS / n * (1 << 30)))

    def cells(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.sliced(batches, "text"):
            found = [np.unique(grams(t) >> K.U64(64 - BITS)).astype(np.int32) for t in K.texts_of(batch.column("text"))]
            cell, count = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(count, pa.int64())], names=["cell", "n"])

    least = max(LEAST_DOCS, int(SHARE * min(n, SAMPLE_DOCS)))
    counted = sample.select("text").mapInArrow(cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    table = np.zeros(1 << BITS, bool)
    table[[r.cell for r in counted.where(F.col("n") >= least).select("cell").collect()]] = True
    return np.packbits(table).tobytes()


def unpacked(bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8)).astype(bool)


def ordered(hashes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Keys that sort as (frequent, hash)."""
    return (hashes >> K.U64(1)) | (table[hashes >> K.U64(64 - BITS)].astype(K.U64) << K.U64(63))
