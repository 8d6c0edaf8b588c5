"""Streams against the batch forms, runs that are killed, and long chains and runs."""

import random
import time
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, numeric
from millrace.streaming import keyed


def test_recurrence_cut_into_stretches(spark):
    draw = random.Random(5)
    rows = [(r, k if r != "c" else k**3, draw.choice((0.5, -1.0, 0.0, 0.9, None)), draw.choice((1.0, -2.0, 0.25, None))) for r, n in (("a", 1), ("b", 700), ("c", 1500), (None, 3), ("d", 30)) for k in range(n)]
    want, h, now = {}, 0.0, object()
    for r, k, a, b in rows:
        h = 0.0 if r != now else h
        now = r
        h = (1.0 if a is None else a) * h + (0.0 if b is None else b)
        want[r, k] = h
    draw.shuffle(rows)
    table = spark.createDataFrame(rows, "run string, at long, a double, b double").repartition(5)
    for stretch in (1 << 16, 64):
        got = {(r.run, r.at): r.h for r in numeric.recurrence(table, "run", "at", "a", "b", stretch).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_one_long_run_in_many_tasks(spark):
    rows = spark.range(300_000).select(F.lit(1).alias("run"), "id", F.lit(0.999).alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    cut = numeric.stretched(rows, "id", "s", 10_000)
    assert cut[1] == 32 and cut[0].groupBy("s").count().agg(F.max("count")).first()[0] < 11_000
    out = numeric.recurrence(rows, "run", "id", "a", "b", 10_000)
    h = 0.0
    for i in range(300_000):
        h = 0.999 * h + i % 7
    assert out.count() == 300_000 and out.where("id = 299999").first().h == pytest.approx(h)


def test_greedy_chain_is_not_followed_link_by_link(spark, monkeypatch):
    """A chain keeps every second document; two chains side by side, and rows that no other document shares."""
    n = 2000
    rows = [(base + i, 0, base + i + k) for base in (0, 10**6) for i in range(n) for k in (0, 1)] + [(3 * 10**6, 1, 5)]
    table = spark.createDataFrame(rows, "ord long, band int, key long")
    cuts = []
    monkeypatch.setattr(dedup, "checkpointed", lambda df, real=dedup.checkpointed: cuts.append(1) or real(df))
    kept = sorted(r.ord for r in dedup.greedy_kept(table, rounds=2).collect())
    assert kept == [*range(0, n, 2), *range(10**6, 10**6 + n, 2), 3 * 10**6] and len(cuts) < 20


def test_components_that_are_too_large_go_on_in_rounds(spark):
    draw = random.Random(2)
    table = [(d, b, draw.randrange(12)) for d in range(40) for b in range(2)] + [(1000 + d, 5, d // 2) for d in range(8)]
    kept, seen = [], set()
    for d in sorted({d for d, _, _ in table}):
        keys = {(b, k) for x, b, k in table if x == d}
        if not keys & seen:
            kept.append(d)
            seen |= keys
    rows = spark.createDataFrame(table, "ord long, band int, key long")
    for component in (10**6, 5):
        assert sorted(r.ord for r in dedup.greedy_kept(rows, rounds=2, component=component).collect()) == kept


def texts(n, seed):
    draw = random.Random(seed)
    words = [f"word{i}" for i in range(60)]
    base = [" ".join(draw.choice(words) for _ in range(40)) for _ in range(max(1, n // 3))]
    return [draw.choice(base) + draw.choice(("", " tail", " other tail here")) for _ in range(n)]


def test_keyed_state_equals_the_batch_rule(spark, tmp_path):
    """Batches in order, near copies across them; the query is stopped and started again, once before its last batch was marked as done."""
    rows = list(enumerate(texts(60, 1)))
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "later" / f"{k}"))
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in" / "*"))
    out = tmp_path / "out"
    for k in range(3):
        (tmp_path / "later" / f"{k}").rename(tmp_path / "in" / f"{k}")
        query = keyed.prepare_by_state(source, str(out), processingTime="0 seconds")
        query.processAllAvailable()
        query.stop()
        if k == 1:
            last = max((p for p in (out / "progress" / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
            for p in (last, last.with_name(f".{last.name}.crc")):
                p.unlink(missing_ok=True)
    got = sorted(r.doc_id for r in spark.read.parquet(str(out / "documents")).collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(r.ord for r in dedup.greedy_kept(dedup.band_rows(docs)).collect())
    assert got == want and len(want) < 60


def written(spark, tmp_path):
    folder = tmp_path / "out" / "documents"
    return [f"doc_id={r.doc_id}" for r in spark.read.schema("doc_id long").parquet(str(folder)).collect()] if folder.exists() else []


def test_keys_are_forgotten(spark, tmp_path):
    text = texts(1, 3)[0]
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in" / "*"))
    query, until = None, time.time() + 150
    for k in range(2):
        spark.createDataFrame([(k, text)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "later" / f"{k}"))
        (tmp_path / "later" / f"{k}").rename(tmp_path / "in" / f"{k}")
        query = query or keyed.prepare_by_state(source, str(tmp_path / "out"), remember=timedelta(milliseconds=1), processingTime="1 second")
        while time.time() < until and f"doc_id={k}" not in written(spark, tmp_path):
            time.sleep(1)
        # the batch behind it has set the keys, the next ones, without rows, let them expire
        done = query.lastProgress["batchId"] if query.lastProgress else 0
        while k == 0 and time.time() < until and (query.lastProgress is None or query.lastProgress["batchId"] < done + 3):
            time.sleep(1)
    query.stop()
    assert sorted(written(spark, tmp_path)) == ["doc_id=0", "doc_id=1"]
