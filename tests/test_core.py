"""Operators of corpus compilation on small hand-made frames."""

import collections
import functools
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace import queries
from millrace.functions import maps
from millrace.functions import text as tx
from millrace.functions.prefix import running_sum
from millrace.operators import dedup, fim, formatters, mixing, numeric, packing, quality, rewards
from millrace.operators import tokenize as tok
from millrace.plans.compile import compile_corpus, write_corpus
from millrace.sources import tables, templates, tokenfile
from millrace.streaming import compile as streams


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("s", ["", " a b  ", "\x1c\x1dk\x1f", "é²½ x_1", "😀 a-b!", "\n\nx\n"])
def test_text_rules_are_python_s(spark, s):
    assert one(spark, s, tx.strip) == s.strip()
    assert one(spark, s, tx.not_blank) == bool(s.split())
    assert one(spark, s, tx.symbols) == sum(not c.isalnum() and not c.isspace() for c in s)


def test_blank_lines_count_in_the_denominator(spark):
    assert one(spark, "a\n\nb\n\nc\n\nd", quality.duplicate_line_ratio) == pytest.approx(1 - 4 / 7)
    assert one(spark, "a\na\na\na\na", quality.duplicate_line_ratio) == 0.0


def test_quality_and_score(spark):
    text = "# Title\nTherefore the proof of the theorem explains the concept; for example def f(): pass " + "word " * 20
    assert one(spark, text, quality.passes) and one(spark, text, quality.educational_score) == pytest.approx(2.5 + 0.25 * 5 + 0.5 + 0.3)
    assert not one(spark, None, quality.passes) and not one(spark, "short", quality.passes) and not one(spark, "#" * 90, quality.passes)


def test_greedy_chain(spark):
    rows = spark.createDataFrame([(1, 0, 1), (2, 0, 1), (2, 1, 2), (3, 1, 2), (1, 1, 9), (3, 0, 8)], "ord long, band int, key long")
    assert sorted(r.ord for r in dedup.greedy_kept(rows).collect()) == [1, 3]


def test_greedy_equals_the_sequential_rule(spark):
    draw = random.Random(1)
    table = [(d, b, draw.randrange(30)) for d in range(120) for b in range(3)]
    kept, seen = [], set()
    for d in range(120):
        keys = {(b, k) for x, b, k in table if x == d}
        if not keys & seen:
            kept.append(d)
            seen |= keys
    rows = spark.createDataFrame(table, "ord long, band int, key long")
    assert sorted(r.ord for r in dedup.greedy_kept(rows).collect()) == kept


def test_exact_copy_goes(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, "one two three four five six seven"), (3, "alpha beta gamma delta epsilon zeta")], "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.deduplicate(docs).collect()) == [1, 2]


def test_running_sum(spark):
    draw = random.Random(2)
    rows = sorted({draw.randrange(10**6): draw.randrange(50) for _ in range(300)}.items())
    out = {r.k: r.s for r in running_sum(spark.createDataFrame(rows, "k long, v long"), "k", "v", "s", 16).collect()}
    total = 0
    for k, v in rows:
        assert out[k] == total
        total += v


@pytest.mark.parametrize("rows", [4, 50, 10**6])
def test_running_sum_of_skewed_orders(spark, rows):
    """Nearly all values in a narrow stretch, some far away, also below zero."""
    keys = [-(10**12), *range(200), 10**9, 10**15]
    out = {r.k: r.s for r in running_sum(spark.createDataFrame([(k, 2) for k in keys], "k long, v long"), "k", "v", "s", rows).collect()}
    assert out == {k: 2 * i for i, k in enumerate(keys)}
    assert running_sum(spark.createDataFrame([], "k long, v long"), "k", "v", "s", rows).count() == 0


def test_interleave_goes_round(spark):
    pool = spark.createDataFrame([("a", i, f"a{i}") for i in range(500)] + [("b", i, f"b{i}") for i in (5, 3)], "source string, ord long, text string")
    slots = spark.createDataFrame([(0, "a", 0), (1, "b", 0), (2, "b", 1), (3, "b", 2), (4, "a", 1)], "slot long, source string, ordinal long")
    assert [r.text for r in mixing.interleave(slots, pool, "ord").orderBy("slot").collect()] == ["a0", "b3", "b5", "b3", "a1"]


def test_generated_curriculum(spark):
    out = mixing.generated_curriculum({n: make(spark, 30) for n, make in templates.GENERATORS.items()}, 30).orderBy("place").collect()
    assert [r.place for r in out] == list(range(1, 31)) and all(len(r.text) > 20 for r in out)
    assert collections.Counter(r.part for r in out) == {0: 15, 1: 6, 2: 4, 3: 5}
    assert [r.part for r in out] != sorted(r.part for r in out)
    first = templates.traces(spark, 3).orderBy("ord").collect()[0].text
    assert first.startswith("<|bos|>User: How many days") and '"tool": "calculator"' in first and first.endswith("<|eos|>")
    assert templates.code_pairs(spark, 1).first().text.startswith("# Python Source Code\n") and all("User:" in r.text for r in templates.prompts(spark, 20).collect())


def test_quotas_rounds_and_budget(spark):
    assert mixing.phase_quotas(500) == (250, 170, 80) and mixing.phase_quotas(1) == (1, 1, 1) and mixing.split_quota(5, 0.5) == (2, 3)
    slots = mixing.round_slots(spark, 3)
    counts = {(r[0], r[1]): r[2] for r in slots.groupBy(F.floor(F.col("slot") / 100), "source").count().collect()}
    assert all(counts[k, s] == n for k in range(3) for s, n in mixing.ROUND.items())
    assert [r.ordinal for r in slots.where("source = 'cot'").orderBy("slot").collect()] == list(range(18))
    docs = spark.createDataFrame([(i, 5) for i in range(10)], "ord long, n long")
    # flushed tokens reach 16 after the fourth document (20 raw tokens)
    assert sorted(r.ord for r in mixing.within_budget(docs, "ord", "n", 8, 16).collect()) == [0, 1, 2, 3]


def test_every_document_has_a_place(spark):
    from hashlib import md5

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = sorted((r.doc_id for r in docs.select("doc_id").collect()), key=lambda d: (md5(f"42|{d}".encode()).hexdigest(), d))
    out = {r.doc_id: r.place for r in queries.QUERIES["seeded_shuffle"](spark, "/root/testdata/sf0.001").collect()}
    assert len(ids) > 100 and out == {d: k for k, d in enumerate(ids, 1)}
    assert [r.doc_id for r in mixing.shuffled(docs.select("doc_id"), "doc_id").collect()] == ids
    twice = spark.createDataFrame([(1,), (1,), (2,)], "k long")
    assert sorted(r.place for r in mixing.placed(twice, "k").collect()) == [1, 2, 3]


def test_curriculum_is_filled_up(spark):
    pool = lambda s, n: spark.createDataFrame([(i, f"{s}{i}") for i in range(n)], "ord long, text string")
    sources = {"cosmo": pool("c", 50), "fineweb": pool("f", 50), "python": pool("p", 3), "math": pool("m", 50)}
    out = [r.text for r in mixing.curriculum(sources, 40, tables.templated(spark, ["t0", "t1"], 40)).collect()]
    assert len(out) == 40 and out.count("t0") + out.count("t1") == 40 - 20 - 3 - 5


def test_curriculum_is_filled_up_in_order(spark):
    have = spark.createDataFrame([(0, "a")], "ord long, text string")
    late_first = tables.templated(spark, ["t0", "t1"], 40).orderBy(F.desc("ord"))
    assert sorted((r.ord, r.text) for r in mixing.backfilled(have, 4, late_first).collect()) == [(0, "a"), (0, "t0"), (1, "t1"), (2, "t0")]


def test_advantage_is_added_up_in_order(spark):
    """A value that is the mean as added up in order, and not as added up in the order in which the rows come."""
    draw = random.Random(1)
    while True:
        values = [round(draw.uniform(0, 10), 2) for _ in range(8)]
        values[3] = round(8 * sum(values[:3] + values[4:]) / 56, 2)
        if functools.reduce(lambda a, b: a + b, values) / 8 == values[3] != functools.reduce(lambda a, b: a + b, values[::-1]) / 8:
            break
    rows = spark.createDataFrame([(1, i, v) for i, v in reversed(list(enumerate(values)))], "g long, i long, v double").coalesce(1)
    assert {r.i: r.a for r in rows.withColumn("a", rewards.advantage("v", "g", order="i")).collect()}[3] == 0.0
    assert {r.i: r.a for r in rows.withColumn("a", rewards.advantage("v", "g")).collect()}[3] != 0.0


def in_windows(df):
    """The columns that windows of df's plan carry."""

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    windows = [x for x in nodes(df._jdf.queryExecution().optimizedPlan()) if x.nodeName() == "Window"]
    assert windows
    return {x.output().apply(i).name() for x in windows for i in range(x.output().size())}


def test_no_window_carries_tokens_or_texts(spark):
    docs = spark.createDataFrame([(i, [i] * (i % 5), "t" * i) for i in range(40)], "ord long, ids array<int>, text string")
    assert "_ids" not in in_windows(packing.pack(docs, "ord", "ids", 8))
    out = running_sum(docs.withColumn("n", F.size("ids")), "ord", "n", "before", rows=10)
    assert not {"ids", "text"} & in_windows(out) and out.columns == ["ord", "ids", "text", "n", "before"]
    assert sorted((r.ord, r.before, r.text) for r in out.collect()) == [(i, sum(k % 5 for k in range(i)), "t" * i) for i in range(40)]
    assert sorted(r.ord for r in mixing.within_budget(docs.withColumn("n", F.size("ids")), "ord", "n", 8, 16).collect()) == list(range(9))


def test_batches_are_encoded_in_slices():
    """However many rows a batch has, few of them are Python objects at once; long pieces and many pieces are not kept."""
    import pyarrow as pa

    texts = pa.array(["x" * 1000, None, ""] * 2000)
    parts = list(tok._slices(texts))
    assert pa.chunked_array(parts).to_pylist() == texts.to_pylist()
    assert max(sum(len(t or "") for t in p.to_pylist()) for p in parts) <= tok.SLICE + 1000 and len(parts) > 5
    lists = pa.array([[1, 2], None, []])
    assert [p.to_pylist() for p in tok._slices(lists)] == [lists.to_pylist()] and [len(p) for p in tok._slices(lists.slice(0, 0))] == [0]
    known = tok._Known(lambda piece: (len(piece),))
    assert known["y" * 1000] == (1000,) and known["ab"] == (2,) and list(known) == ["ab"]


def test_prompts(spark):
    p = spark.createDataFrame([(i, f" p{i} " if i else "  ") for i in range(5)], "ord long, problem string")
    c = spark.createDataFrame([(i, f"do {i}") for i in range(5)], "ord long, instruction string")
    t = spark.createDataFrame([(i, f"USER: u{i} ASSISTANT: x" if i % 2 else "none") for i in range(6)], "ord long, chat string")
    out = [(r.kind, r.prompt) for r in mixing.prompts(p, c, t, 7).orderBy("kind", "ord").collect()]
    assert [x for x in out if x[0] == "math"] == [("math", f"User: Solve the following math problem step-by-step:\np{i}\n") for i in (1, 2)]
    assert [x for x in out if x[0] == "tool"] == [("tool", f"User: u{i}\n") for i in (1, 3, 5)]


def test_tokenizer_round_trip(spark, tmp_path):
    t = tok.Tokenizer()
    assert len(t.ranks) + len(t.special) == tok.SIZE and sorted(t.bytes_of) == list(range(tok.SIZE))
    text = "Hello the <|call tool|> wörld 😀\n\n  x=1<|eos|>"
    ids = one(spark, text, lambda c: tok.encode(c, t))
    assert t.special["<|call tool|>"] in ids and ids[-1] == 2 and t.decode(ids) == text
    assert t.special["<|eos|>"] not in one(spark, text, lambda c: tok.encode(c, t, allow_special=False))
    t.save(spark, str(tmp_path / "t.json"))
    assert tok.Tokenizer.load(spark, str(tmp_path / "t.json")).ranks == t.ranks


def test_merges_equal_the_library(spark):
    import tiktoken

    t = tok.Tokenizer()
    library = tiktoken.Encoding("x", pat_str=tok.PATTERN, mergeable_ranks=t.ranks, special_tokens=t.special)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(tok.encode(F.col("x"), t).alias("y")).collect()
    assert [r.y for r in got] == [library.encode_ordinary(x) for x in texts]


def test_merges_of_long_pieces(spark):
    import time

    import tiktoken

    t = tok.Tokenizer()
    library = tiktoken.Encoding("x", pat_str=tok.PATTERN, mergeable_ranks=t.ranks, special_tokens=t.special)
    draw = random.Random(3)
    for piece in ["a", "  " * 40, "é" * 50, *("".join(draw.choice(" \t\nab\x01\x05é") for _ in range(draw.randrange(1, 60))) for _ in range(200))]:
        raw = piece.encode()
        want = library.encode_single_token(raw) if raw in t.ranks else None
        got = list(t._merge(piece))
        assert got == ([want] if want is not None else library._core_bpe.encode_single_piece(raw))
    began = time.process_time()
    assert len(t._merge(" " * 50_000)) == 12_500 and time.process_time() - began < 5
    rows = spark.createDataFrame([(None,), ("",), ("a<|eos|>b",)], "x string").select(tok.encode(F.col("x"), t).alias("y")).collect()
    assert [r.y for r in rows] == [None, [], [t.ranks[b"a"], 2, t.ranks[b"b"]]]


def test_text_of_tokens_one_by_one(spark):
    t = tok.Tokenizer()
    raw = [*"né😀".encode()]
    ids = [t.ranks[bytes([b])] for b in raw]
    tokens = [*ids[:3], 4, t.ranks[b"\xff"], *ids[3:5], 2, *ids[5:]]  # a special token within a character, a byte that is none
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate(tokens)] + [("s", 0, ids[1]), ("s", 1, t.ranks[b"z"])], "run string, at int, id int")
    out = {(r.run, r.at): r.chunk for r in tok.text_chunks(rows, ["run"], "at", "id", t).collect()}
    assert [out["r", i] for i in range(len(tokens))] == ["n", "", "é", "<|thought end|>", "", "", "", "<|eos|>", "", "😀"]
    assert [out["s", 0], out["s", 1]] == ["", "z"]


def test_fill_in_middle(spark):
    rows = spark.createDataFrame([(n * 100 + k, list(range(20, 20 + n))) for n in (15, 16, 17, 40) for k in range(20)], "k long, ids array<int>")
    for r in rows.select("k", "ids", fim.fill_in_middle(F.col("ids"), F.col("k"), rate=1.0).alias("m")).collect():
        if len(r.ids) < 16:
            assert r.m == r.ids
            continue
        assert len(r.m) == len(r.ids) + 4 and sorted(x for x in r.m if x > 11) == r.ids
        parts, key = {}, None
        for x in r.m:
            if x in (fim.PREFIX, fim.SUFFIX, fim.MIDDLE, fim.END):
                key = x
                parts[key] = []
            else:
                parts[key].append(x)
        assert parts[fim.PREFIX] + parts[fim.MIDDLE] + parts[fim.SUFFIX] == r.ids and all(parts[x] for x in (fim.PREFIX, fim.MIDDLE, fim.SUFFIX))
    assert one(spark, [5, 2], fim.with_end, "array<int>") == [5, 2] and one(spark, [5], fim.with_end, "array<int>") == [5, 2]


def test_packing(spark):
    docs = spark.createDataFrame([(0, list(range(1, 6))), (1, []), (2, list(range(11, 21))), (3, [31, 32, 33])], "ord long, ids array<int>")
    out = packing.pack(docs, "ord", "ids", 8).orderBy("seq_id").collect()
    assert [r.input_ids for r in out] == [[1, 2, 3, 4, 5, 11, 12, 13], [14, 15, 16, 17, 18, 19, 20, 31], [32, 33, 0, 0, 0, 0, 0, 0]]
    assert out[2].labels == [32, 33] + [-100] * 6 and out[2].position_ids == [0, 1] + [0] * 6 and out[2].document_ids == [2, 2] + [3] * 6
    assert out[0].document_ids == [0] * 5 + [1] * 3


def test_token_file(spark, tmp_path):
    spark.dataSource.register(tokenfile.TokenFiles)
    rows = spark.createDataFrame([(i, [i * 10 + k for k in range(8)]) for i in range(50)], "seq_id long, input_ids array<int>")
    tokenfile.write_tokens(rows, str(tmp_path / "t"), parts=4)
    back = spark.read.format("tokenfile").option("length", 8).option("range", 7).load(str(tmp_path / "t"))
    assert [(r.seq_id, r.input_ids) for r in back.orderBy("seq_id").collect()] == [(r.seq_id, r.input_ids) for r in rows.collect()]
    assert tokenfile.concatenate(str(tmp_path / "t"), str(tmp_path / "all.bin")) == 400
    tail = spark.read.format("tokenfile").option("length", 150).load(str(tmp_path / "all.bin"))
    assert tail.count() == 2


def test_bounded_and_cycled_sources(spark):
    good = "word " * 40
    books = spark.createDataFrame([(i, good if i % 2 else "short") for i in range(20)], "ord long, text string")
    web = spark.createDataFrame([(i, good, 4.5 if i > 2 else 1.0) for i in range(9)], "ord long, text string, score double")
    out = [(r.part, r.ord) for r in tables.bounded_textbooks(books, web, 10).orderBy("part", "ord").collect()]
    assert out == [(0, i) for i in (1, 3, 5, 7, 9, 11)] + [(1, i) for i in (3, 4, 5, 6)]
    three = spark.createDataFrame([(7, "b"), (5, "a"), (9, "c")], "ord long, text string")
    assert [r.text for r in tables.cycled(three, 7, "ord").orderBy("place").collect()] == list("abcabca")
    assert [r.text for r in tables.cycled(three.where("ord < 0"), 2, "ord", three).orderBy("place").collect()] == list("ab")


def test_maps(spark):
    row = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3, "c": 1})], "x map<string,int>, y map<string,int>")
    both = maps.merged(F.col("x"), F.col("y"))
    assert row.select(both.alias("m")).first().m == {"a": 1, "b": 3, "c": 1}
    assert row.select(maps.inverted(both).alias("m")).first().m == {1: "c", 3: "b"}


def test_prompt_files_and_settings(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b\n"), (1, 'a "é"'), (3, "c")], "ord long, prompt string")
    path = str(tmp_path / "prompts.json")
    assert tables.write_prompts(rows, path, 2) == 2
    assert open(path, encoding="utf-8").read() == json.dumps(['a "é"', "b\n"], indent=2)
    fallback = templates.prompts(spark, 3)
    assert [(r.ord, r.prompt) for r in tables.prompts_or(spark, path, fallback).orderBy("ord").collect()] == [(0, 'a "é"'), (1, "b\n")]
    assert tables.prompts_or(spark, path + ".none", fallback).count() == 3
    (tmp_path / "mix.yaml").write_text("curriculum:\n  phases:\n  - {name: Phase 1 Syntax, share: 0.2}\n  - {name: logic, share: 0.3}\nmodel: {width: 8, depth: 2}\ndepth: 3\nodd: 1\n")
    settings = tables.config(str(tmp_path / "mix.yaml"))
    assert tables.phase_shares(settings, mixing.SHARES) == (0.2, 0.3, 0.16) and tables.phase_shares({}, mixing.SHARES) == mixing.SHARES
    assert tables.projected(settings, {"width", "depth"}) == {"width": 8, "depth": 3}
    with pytest.raises(FileNotFoundError):
        tables.config(str(tmp_path / "none.yaml"))


def test_scores_of_letters_in_any_case(spark):
    """As if every phrase's pattern were tried on every text."""
    from millrace.operators.quality import LOWERING, RAISING

    texts = ["THEOREM and Proof", "theorems", "ſtep-by-ſtep", "STEP-BY-STEP", "funct\u0131on", "defin\u0130tion", "Coo\u212aie policy", "xalgorithm", "click  here", "Click here. SUBSCRIBE!", ""]
    plain = F.lit(2.5)
    for phrase, worth in [*((p, 0.25) for p in RAISING), *((p, -0.5) for p in LOWERING)]:
        plain = plain + F.when(F.col("x").rlike(rf"(?iU)\b{phrase}\b"), worth).otherwise(0.0)
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", quality.educational_score(F.col("x")).alias("got"), plain.alias("want")).collect()
    assert [r.got for r in rows] == pytest.approx([r.want for r in rows]) and {r.got for r in rows} > {2.5}


def test_signatures_in_one_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, ""), (-2, "Two Words"), (-3, "é_1 x² ÀB c d E f")], "doc_id long, text string"))
    two = dedup.signatures(docs.select("doc_id", dedup.shingles(F.col("text")).alias("s")), "doc_id")
    assert {r.ord: r.sig for r in dedup.text_signatures(docs, "doc_id").collect()} == {r.doc_id: r.sig for r in two.collect()}
    pairs = dedup.coefficients()
    (few,) = dedup.signatures(spark.createDataFrame([(1, [0, 5, (1 << 32) - 1])], "ord long, s array<long>")).collect()
    assert few.sig == [min((a * s + b) % dedup.PRIME for s in (0, 5, (1 << 32) - 1)) for a, b in pairs]


def test_drafts_and_time_left(spark):
    row = lambda d, t, u: spark.createDataFrame([(d, t, u)], "d array<double>, t array<double>, u array<double>").select(numeric.accepted_drafts(F.col("d"), F.col("t"), F.col("u")).alias("n")).first().n
    assert row([0.5, 0.5], [0.6, 0.1], [0.9, 0.1]) == 2 and row([0.5, 0.5], [0.6, 0.1], [0.9, 0.3]) == 1
    assert row([0.5], [0.0], [0.0]) == 0 and row([], [], []) == 0
    assert one(spark, 90.0, numeric.eta_text, "double") == "1.5m" and one(spark, 5400.0, numeric.eta_text, "double") == "1.5h"


def test_rewards(spark):
    tag = "<|call tool|>"
    rows = [
        ("<|thought start|>x<|thought end|>```python\nx = 1\n```" + tag + '{"tool": "a"} trailing<|reflect|>looks good', (1.0, 2.0, 0.0, 1.0, 4.0)),
        ("<|thought start|>x" + tag + "{broken", (0.0, 0.0, -3.0, 0.0, -3.0)),
        ("```python\ndef (:\n```" + tag + '{"x": 1}' + tag + "none", (0.5, 0.0, -2.5, 0.0, -2.0)),
        ("plain", (0.0, 0.0, 0.0, 0.0, 0.0)),
    ]
    out = rewards.reward(spark.createDataFrame([(c,) for c, _ in rows], "completion string")).collect()
    for r, (_, want) in zip(out, rows, strict=True):
        assert (r.syntax_reward, r.tool_reward, r.format_penalty, r.reflection_reward, r.total_reward) == want


def test_formatters(spark):
    assert json.loads(formatters.code_pair_text("x = 1").split("```json\n")[1][:-3])["body"][0]["_type"] == "Assign"
    assert formatters.code_pair_text("def (").startswith("# Source\ndef (\n# Parse Error: ")
    row = spark.createDataFrame([("p", "t", 'na"me', '{"a": [1]}', '{"r": null}', "", "done")], "p string, t string, n string, a string, r string, f string, e string")
    got = row.select(formatters.interaction(*[F.col(c) for c in "ptnarfe"]).alias("y")).first().y
    call = json.dumps({"tool": 'na"me', "parameters": {"a": [1]}}, indent=2)
    assert got == f"<|bos|>User: p\n<|thought start|>t<|thought end|><|call tool|>\n{call}\n<|tool response|>\n" + json.dumps({"r": None}, indent=2) + "\n\nFinal Response: done<|eos|>"
    assert one(spark, "no markers", formatters.tool_dialogue) is None
    assert one(spark, "a�<|reflect|>b", lambda c: formatters.highlighted(c, {"<|reflect|>": "["})) == "a[b"


def test_formatters_get_the_whole_text(spark, tmp_path):
    texts = ["  short \n", "a 'quoted' \"text\"\n\n\tand\\more <|call tool|> " + "word " * 40 + "\nlast é😀", "x" * 5000 + " end"]
    docs = spark.createDataFrame([(i, t, "en", "src") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    rows = lambda name: queries.QUERIES[name](spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.proof.split("Derivation\n")[1]) for r in rows("proof_text")) == [(i, t.strip() + "\n") for i, t in enumerate(texts)]
    assert sorted((r.doc_id, r.prompt) for r in rows("prompt_prefix")) == [(i, f"User: Write a python solution for: {t.strip()}\n") for i, t in enumerate(texts)]
    leads = {"math": "Solve the following math problem step-by-step:\n", "code": "Write a python solution for: ", "tool": ""}
    assert sorted((r.kind, r.ord, r.prompt) for r in rows("prompt_mix")) == sorted((k, i, f"User: {lead}{t.strip()}\n") for k, lead in leads.items() for i, t in enumerate(texts))
    pairs = {r.doc_id: r.pair for r in rows("code_pairs")}
    for i, t in enumerate(texts[:2]):
        tree = json.loads(pairs[i].split("```json\n")[1][:-3])
        assert tree["body"][0]["name"] == f"f_{i}" and tree["body"][0]["body"][0]["value"]["value"] == t
    assert pairs[2] == formatters.code_pair_text(f'def f_2(x):\n    return "{texts[2]}"'[:2000])


def test_tool_dialogue_of_every_turn(spark):
    sf = "/root/testdata/sf0.001"
    rows = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    out = queries.QUERIES["tool_dialogue"](spark, sf).collect()
    assert len(out) == len(rows) and {(r.conv_id, r.turn) for r in out} == set(rows) and any(turn for _, turn in rows)
    for r in out:
        assert r.formatted.startswith(f"<|bos|>User: {rows[r.conv_id, r.turn].strip()}\n<|thought start|>") and r.formatted.endswith("Final Response: done<|eos|>")


@pytest.mark.parametrize("total", [1, 20, 100])
@pytest.mark.parametrize("decay", ["sqrt", "cosine", "linear"])
def test_schedule(spark, total, decay):
    out = [r.y for r in spark.range(total).select(numeric.schedule(F.col("id"), total, decay=decay).alias("y")).collect()]
    assert all(0 < x <= 1 + 1e-9 for x in out)


def test_anomaly(spark):
    rows = spark.createDataFrame([("a", i, 1.0 if i != 20 else 9.0) for i in range(30)] + [("b", 0, float("nan"))], "run string, step long, loss double")
    plain = {(r.run, r.step) for r in rows.select("run", "step", numeric.anomalous("loss", "step", "run").alias("y")).where("y").collect()}
    assert plain == {("a", 20), ("b", 0)}
    assert {(r.run, r.step) for r in numeric.anomalous_with_rollback(rows, "loss", "step", "run").where("anomalous").collect()} == plain


def test_compile_and_report(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    out = compile_corpus(docs, tok.Tokenizer(), length=256, fim_rate=0.5)
    r = out.report
    assert r["documents"] == 60 == r["filtered"] + r["duplicates"] + r["kept"] and r["bytes"] == r["sequences"] * 512
    assert {len(x.input_ids) for x in out.sequences.collect()} == {256}


def test_corpus_file(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    r = write_corpus(docs, tok.Tokenizer(), str(tmp_path / "c"), length=256)
    assert r["sequences_in_file"] == r["sequences"] > 0 and r["kept"] + r["duplicates"] + r["filtered"] == 60


def test_corpus_file_is_the_packed_sequences_and_needs_no_more_disk_than_its_texts(spark, tmp_path, monkeypatch):
    from millrace.functions.checkpoints import checkpointed
    from millrace.plans import compile as plan

    monkeypatch.setattr(plan, "TEXT", 20_000, raising=False)  # many stretches, rows in any order
    docs = checkpointed(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(5, "text"))
    folder = str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).removeprefix("file:")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(folder) for f in files)
    had, path = size(), str(tmp_path / "c")
    report = write_corpus(docs, tok.Tokenizer(), path, length=256, fim_rate=0.5)
    assert size() - had < docs.agg(F.sum(F.octet_length("text"))).first()[0]
    out = compile_corpus(docs, tok.Tokenizer(), length=256, fim_rate=0.5)
    want = [(r.seq_id, r.input_ids) for r in out.sequences.orderBy("seq_id").collect()]
    got = spark.read.format("tokenfile").option("length", 256).load(path).orderBy("seq_id").collect()
    assert [(r.seq_id, r.input_ids) for r in got] == want
    assert report == out.report | {"sequences_in_file": len(want)} and report["duplicates"] > 0
    none = write_corpus(docs.where("false"), tok.Tokenizer(), str(tmp_path / "none"), length=256)
    assert set(none.values()) == {0}


def test_a_corpus_has_no_rejected_text_under_the_id_of_a_kept_one(spark, tmp_path):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(40))) for i in (7, 3, -5)]
    rows = [*good, (3, "#" * 90), (None, good[0][1] + " more"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    report = write_corpus(docs.where("doc_id is not null"), tok.Tokenizer(), str(tmp_path / "c"), length=64)
    assert (report["documents"], report["filtered"], report["kept"], report["duplicates"]) == (5, 2, 3, 0)
    back = spark.read.format("tokenfile").option("length", 64).load(str(tmp_path / "c")).orderBy("seq_id").collect()
    ids = [x for r in back for x in r.input_ids]
    texts = tok.Tokenizer().decode(ids[: len(ids) - next(i for i, x in enumerate(reversed(ids)) if x)]).split("<|eos|>")
    assert texts == [*(t for _, t in sorted(good)), ""]


def test_an_endless_mix(spark, tmp_path):
    import time

    from millrace.streaming import slots

    pattern = {"a": 3, "b": 2}
    batch = [tuple(r) for r in mixing.round_slots(spark, 4, pattern).orderBy("slot").collect()]
    assert [x for k in range(4) for x in slots.round_of(k, pattern, 42)] == batch
    spark.dataSource.register(slots.RoundSlots)
    reader = spark.readStream.format("round_slots").option("pattern", json.dumps(pattern)).option("rounds", 3).option("range", 2)
    source = reader.option("notes", f"file://{tmp_path}/notes").load()
    pools = {s: spark.createDataFrame([(10 * i, f"{s}{i}") for i in range(n)], "ord long, text string") for s, n in (("a", 4), ("b", 3))}
    for batches in (1, 3):  # stopped, and started again
        query = slots.mixed(source, pools, "ord").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).start()
        until = time.time() + 60
        while time.time() < until and (query.lastProgress is None or query.lastProgress["batchId"] < batches):
            time.sleep(0.3)
        query.stop()
    assert slots._Reader(pattern, 42, 3, 2, None).partitions({"round": 0}, {"round": 3}) == [slots._Rounds(0, 2), slots._Rounds(2, 3)]
    with pytest.raises(ValueError, match="notes"):
        slots._Reader(pattern, 42, 3, 2, None).partitions({"round": 6}, {"round": 3})
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("slot").collect()
    assert len(rows) >= 15 and [r.slot for r in rows] == list(range(len(rows)))
    assert [r.text for r in rows[:20]] == [f"{s}{o % (4 if s == 'a' else 3)}" for _, s, o in batch][: len(rows)]


def test_packing_a_stream_equals_the_batch(spark, tmp_path):
    draw = random.Random(8)
    rows = [(i, [draw.randrange(1, 99) for _ in range(draw.choice((0, 1, 3, 7, 30)))]) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "ord long, ids array<int>").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema("ord long, ids array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out = str(tmp_path / "out")
    streams.pack_stream(source, out, 16).awaitTermination()
    streams.pack_batch(spark, spark.read.parquet(str(tmp_path / "in" / "3")), 3, out, 16)  # a batch that runs again
    counts = streams.finish_packing(spark, out, 16)
    got = [(r.seq_id, r.input_ids) for r in spark.read.parquet(f"{out}/sequences").orderBy("seq_id").collect()]
    want = [(r.seq_id, r.input_ids) for r in packing.pack(spark.createDataFrame(rows, "ord long, ids array<int>"), "ord", "ids", 16).orderBy("seq_id").collect()]
    assert got == want and counts == {"documents": sum(bool(x) for _, x in rows), "sequences": len(want), "tokens": 16 * len(want)}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for k, part in enumerate((docs.where("doc_id < 100"), docs.where("doc_id >= 100"))):
        part.coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    streams.prepare_stream(source, str(tmp_path / "out")).awaitTermination()
    got = {r.doc_id for r in spark.read.parquet(str(tmp_path / "out" / "documents")).collect()}
    want = {r.ord for r in dedup.greedy_kept(dedup.band_rows(quality.quality_filter(docs))).collect()}
    assert got == want


@pytest.mark.parametrize("hidden", ["millrace.llm", "corpus_pipeline", "zstandard", "public_tokenizers"])
def test_entry_without_the_optional_package(hidden):
    """In a fresh process in which the module cannot be found."""
    import subprocess
    import sys
    from pathlib import Path

    code = f"""
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == {hidden!r} or name.startswith({hidden!r} + "."):
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert "greedy_dedup" in e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not [x for x in e.queries() if x.startswith("op1_") or x == "pipeline"]
"""
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)


def test_entry_has_its_queries():
    import __spark_entry__ as e

    assert "greedy_dedup" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_small_tables_are_spread(spark, tmp_path):
    from millrace.functions.spread import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one_file = spark.read.parquet(str(tmp_path / "one"))
    cores = spark.sparkContext.defaultParallelism
    assert spread(one_file).rdd.getNumPartitions() == cores and spread(one_file).count() == 1000
    assert spread(one_file, 10).rdd.getNumPartitions() == one_file.rdd.getNumPartitions()
    spark.range(1000).repartition(cores).write.parquet(str(tmp_path / "many"))
    many = spark.read.parquet(str(tmp_path / "many"))
    assert spread(many).rdd.getNumPartitions() == many.rdd.getNumPartitions()


def _stored(spark, path, length=8):
    spark.dataSource.register(tokenfile.TokenFiles)
    back = spark.read.format("tokenfile").option("length", length).option("range", 7).load(path)
    return [x for r in back.orderBy("seq_id").collect() for x in r.input_ids], sorted(r.seq_id for r in back.select("seq_id").collect())


def _sequences(spark, start, stop, base=0):
    return spark.createDataFrame([(i, [(base + i * 8 + k) % 65536 for k in range(8)]) for i in range(start, stop)], "seq_id long, input_ids array<int>").repartition(3)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_token_files_append_overwrite_and_commit_again(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/t"
    tokenfile.write_tokens(_sequences(spark, 0, 4), path, "append", parts=2)
    tokenfile.write_tokens(_sequences(spark, 0, 4, 1000), path, "append", parts=2, commit="second")
    tokenfile.write_tokens(_sequences(spark, 2, 5, 3000), path, "append")
    want = [*range(32), *range(1000, 1032), *range(3016, 3040)]
    assert _stored(spark, path) == (want, list(range(11)))
    tokenfile.write_tokens(_sequences(spark, 0, 3, 2000), path, "append", commit="second")  # in its old place
    want[32:64] = range(2000, 2024)
    assert _stored(spark, path) == (want, list(range(10)))
    assert _stored(spark, path, 12) == (want[:72], list(range(6)))  # parts end within sequences, the tail is dropped
    assert tokenfile.concatenate(path, f"{scheme}{tmp_path}/all.bin") == 80
    assert _stored(spark, f"{scheme}{tmp_path}/all.bin") == (want, list(range(10)))
    folder = tokenfile.Folder(path)
    tokenfile._Part(path).out.close()  # of a task that was lost
    assert _stored(spark, path)[0] == want and folder.vacuum() == 1
    tokenfile.write_tokens(_sequences(spark, 7, 9), path)
    assert _stored(spark, path) == (list(range(56, 72)), [0, 1]) and folder.vacuum() == 0
    tokenfile.write_tokens(_sequences(spark, 0, 0), path)
    assert _stored(spark, path) == ([], [])


def test_token_files_keep_what_others_wrote(spark, tmp_path):
    import numpy as np

    (tmp_path / "t").mkdir()
    for name, values in (("a.bin", range(5)), ("b.bin", range(5, 21))):
        np.array(values, "<u2").tofile(tmp_path / "t" / name)
    assert _stored(spark, str(tmp_path / "t"))[0] == list(range(16))
    tokenfile.write_tokens(_sequences(spark, 3, 5), str(tmp_path / "t"), "append")
    assert _stored(spark, str(tmp_path / "t"))[0] == [*range(21), *range(24, 35)]
    with pytest.raises(Exception, match="write_tokens"):
        _sequences(spark, 0, 9).orderBy(F.desc("seq_id")).coalesce(1).write.format("tokenfile").mode("append").save(str(tmp_path / "t"))


def _forget_last_commit(progress):
    """As if the query had been killed after its last batch was written and before it was marked as done."""
    last = max((p for p in (progress / "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    for p in (last, last.with_name(f".{last.name}.crc")):
        p.unlink(missing_ok=True)


def test_token_stream_that_is_killed_equals_the_batch(spark, tmp_path):
    spark.dataSource.register(tokenfile.TokenFiles)
    for k in range(4):
        _sequences(spark, 5 * k, 5 * k + 5).coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema("seq_id long, input_ids array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    for _ in range(2):
        tokenfile.stream_tokens(source, str(tmp_path / "t"), str(tmp_path / "progress"), run=2).awaitTermination()
        assert _stored(spark, str(tmp_path / "t")) == (list(range(160)), list(range(20)))
        _forget_last_commit(tmp_path / "progress")
    tokenfile.stream_tokens(source, str(tmp_path / "t"), str(tmp_path / "progress"), run=2).awaitTermination()
    tokenfile.write_tokens(_sequences(spark, 0, 20), str(tmp_path / "batch"))
    assert tokenfile.concatenate(str(tmp_path / "t"), str(tmp_path / "a.bin")) == tokenfile.concatenate(str(tmp_path / "batch"), str(tmp_path / "b.bin")) == 160
    assert (tmp_path / "a.bin").read_bytes() == (tmp_path / "b.bin").read_bytes()


def test_packed_stream_into_a_token_file(spark, tmp_path):
    draw = random.Random(9)
    rows = [(i, [draw.randrange(1, 99) for _ in range(draw.choice((0, 1, 3, 7, 30)))]) for i in range(30)]
    for k in range(3):
        spark.createDataFrame(rows[10 * k : 10 * k + 10], "ord long, ids array<int>").coalesce(1).write.parquet(str(tmp_path / "in" / f"{k}"))
    source = spark.readStream.schema("ord long, ids array<int>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    out, path = str(tmp_path / "out"), str(tmp_path / "t")
    for _ in range(2):  # the second run repeats the last batch
        streams.pack_stream(source, out, 16, tokens=path).awaitTermination()
        _forget_last_commit(tmp_path / "out" / "progress")
    streams.pack_stream(source, out, 16, tokens=path).awaitTermination()
    streams.finish_packing(spark, out, 16, path)
    want = packing.pack(spark.createDataFrame(rows, "ord long, ids array<int>"), "ord", "ids", 16).orderBy("seq_id").collect()
    assert _stored(spark, path, 16)[0] == [x for r in want for x in r.input_ids]


def test_helper_columns_do_not_touch_the_user_s(spark):
    rows = spark.createDataFrame([(i, "s", 3, f"x{i}") for i in range(9)], "ord long, source string, n long, at string").withColumns({c: F.lit(c) for c in ("before", "stretch", "one", "size", "base", "rank", "cuts", "key")})
    names = rows.columns
    for out, more in (
        (running_sum(rows, "ord", "n", "sum", 2), ["sum"]), (mixing.first_n(rows, "source", "ord", 4), []), (mixing.placed(rows, "ord", rows=1), ["place"]), (mixing.within_budget(rows, "ord", "n", 4, 12), []),
        (tables.cycled(rows, 20, "ord"), ["place"]), (packing.chunks(rows, "ord", "n", 4), ["seq_id", "pos", "skip", "take"]), (mixing.interleave(mixing.round_slots(spark, 1, {"s": 3}), rows, "ord"), ["slot", "ordinal"]),
    ):
        assert sorted(out.columns) == sorted([*names, *more]) and {(r.before, r.key, r.at[:1]) for r in out.collect()} == {("before", "key", "x")}
    assert sorted(r.place for r in mixing.placed(rows, "ord", rows=1).collect()) == list(range(1, 10))
