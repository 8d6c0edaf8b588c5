"""Connected components of an edge table, by alternating large and small stars.

Each half-round is one aggregation and one join over the edges; the number of rounds grows with the
logarithm of the longest path. No node's neighbours are gathered in one place: minima are
pre-aggregated, and a node with very many neighbours is an ordinary skewed join. Every round is written
as a table in the shared folder, in as few files as its rows ask for, and deleted when the next one is.

Defined results: edges that join a node with itself and repeated edges add nothing; no edges give no
rows; edges with a null end are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions import files
from millrace.functions.checkpoints import stored
from millrace.functions.joins import matched

EDGES_PER_FILE = 100_000


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b: of one type that has an order) -> (node, root): the smallest node reachable, for nodes of edges with a != b."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def cut(e: DataFrame, rows: int) -> tuple[DataFrame, str, tuple]:
        """e without loops and repeats, written once; its table; its count and a sum of hashes."""
        out, path = stored(e.where("a != b").distinct().coalesce(max(1, min(n, -(-rows // EDGES_PER_FILE)))), "components")
        return out, path, tuple(out.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    found = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null")
    now, path, was = cut(found, n * EDGES_PER_FILE // 8)
    while was[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = matched(both, low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = matched(large, low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        old = path
        now, path, is_ = cut(small, was[0])
        files.delete(edges.sparkSession, old)
        if is_ == was:
            break
        was = is_
    # at rest every node has one edge, to its root
    return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
