"""The pipeline against a plain Python form of its stages on the smallest tables."""

import math
from collections import Counter

import brute
import pytest
from test_operators import lines_of

import corpus_pipeline
from millrace.llm import quality_rules as q

SF = "/root/testdata/sf0.001"


def class_of(c):
    if c.isascii():
        if c.islower():
            return 0
        if c.isupper():
            return 1
        if c.isdigit():
            return 2
        return 3 if c in " \t\n\x0b\x0c\r" else 4 if c in "#*$%&|<>" else 5
    return 6


def histograms(text):
    classes = Counter(map(class_of, text))
    return [classes[k] for k in range(7)], Counter(brute.ALNUM.findall(text.translate(brute.LOWER)))


def distance(p, r):
    p = [x / max(1, sum(p)) for x in p]
    h = lambda d: -sum(x * math.log2(x) for x in d if x > 0)
    return math.sqrt(max(0, h([(a + b) / 2 for a, b in zip(p, r, strict=True)]) - (h(p) + h(r)) / 2))


def plain_quality(rows):
    sums = {}
    for r in rows:
        if r["lang"] is not None:
            c, w = histograms(r["text"])
            have = sums.setdefault(r["lang"], [[0] * 7, Counter(), 0])
            sums[r["lang"]] = [[a + b for a, b in zip(have[0], c, strict=True)], have[1] + w, have[2] + 1]
    refs = []
    for c, w, n in sums.values():
        if n >= q.MIN_DOCS and w.total() >= q.MIN_REFERENCE_WORDS:
            top = sorted(w, key=lambda x: (-w[x], x.encode()))[: q.COMMON]
            shares = [w[x] / w.total() for x in top]
            refs.append(([x / sum(c) for x in c], top, [*shares, 1 - sum(shares)]))
    out = []
    for r in rows:
        n, *_, failed = brute.quality(r["text"])
        c, w = histograms(r["text"])
        by_class = min(distance(c, ref) for ref, _, _ in refs)
        by_word = min(distance([*(w[x] for x in top), w.total() - sum(w[x] for x in top)], shares) for _, top, shares in refs)
        odd = n >= q.GUARD_CLASS and by_class > q.CLASS_DISTANCE + q.CLASS_SCATTER / math.sqrt(max(n, 1))
        odd = odd or n >= q.GUARD_WORDS and by_word > q.WORD_DISTANCE + q.WORD_SCATTER / math.sqrt(max(n, 1))
        if not failed and not odd:
            out.append(r)
    return out


def plain_lines(rows):
    """Runs of three lines, or of fewer with fifty words, that stand earlier, too, go."""
    seen, out = set(), []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        lines = lines_of(r["text"])
        bare = [(x.strip(" \t\x0b\x0c\r\n"), len(brute.SPACE.findall(x))) for x in lines]
        gone = [False] * len(lines)
        for n in (1, 2, 3):
            for i in range(len(lines) - n + 1):
                if n == 3 or sum(k for _, k in bare[i : i + n]) >= 50:
                    key = tuple(x for x, _ in bare[i : i + n])
                    if key in seen:
                        gone[i : i + n] = [True] * n
                    seen.add(key)
        if not all(gone):
            out.append(r | {"text": "\n".join(x for x, y in zip(lines, gone, strict=True) if not y)})
    return out


def plain_near(rows):
    of = brute.components([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    return [r for r in rows if of[r["doc_id"], r["text"]][1] == r["doc_id"]]


@pytest.fixture(scope="module")
def plain(spark):
    rows = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    stages = [rows]
    for stage in (plain_quality, plain_lines, plain_near):
        stages.append(stage(stages[-1]))
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.contamination([(r["doc_id"], r["text"]) for r in stages[-1]], bench, 10)
    stages.append([r for r in stages[-1] if not hit[r["doc_id"], r["text"]][4]])
    return stages


def test_stages_and_run(spark, plain):
    docs = spark.createDataFrame(plain[0], spark.read.parquet(f"{SF}/documents.parquet").schema)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        before = spark.createDataFrame(plain[k], docs.schema)
        out = stage(spark, before, SF)
        assert out.columns == docs.columns
        assert sorted((r.asDict() for r in out.collect()), key=lambda r: r["doc_id"]) == sorted(plain[k + 1], key=lambda r: r["doc_id"])
    out = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r.doc_id for r in out) == sorted(r["doc_id"] for r in plain[4])
    assert all(r.n_ids == len(r.ids) > 0 and r.round_trip for r in out)
    assert [len(x) for x in plain] == sorted((len(x) for x in plain), reverse=True) and len(plain[4]) > 100


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "decontaminate", "sentencepiece"]
