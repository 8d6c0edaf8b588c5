"""Packing, conversation repair and spelling variants against their plain forms, on the smallest tables and on odd rows."""

import collections
import itertools
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from millrace.llm import bin_packing, oracles, queries, spelling, turn_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, bucket string, ids int, size string, start string, word int, n string, key string, low string"


def rows_of(texts):
    return [(d, t, "x", 1, "y", "z", 2, "n", "k", "l") for d, t in texts]


# --- packing


def check_pieces(pieces, plain, path, length):
    """Each row's pieces are its ids in order, sequences are gapless, and nothing needs padding."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    want = collections.Counter()
    for d, t in plain:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, bin_packing.END], "<u4")
        want[d, ids.tobytes()] += 1
    by = collections.defaultdict(list)
    for p in pieces:
        by[p.doc_id, p.start, p.doc_tokens].append(p)
    sequences = collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and 0 < p.length <= length
        sequences[p.sequence_id].append(p)
    for s in sequences.values():
        at = 0
        for p in sorted(s, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length and not at & (at - 1)
    for (d, raw), copies in want.items():
        n = len(raw) // 4
        own = sorted((p for p in pieces if p.doc_id == d and p.doc_tokens == n and raw[4 * p.start : 4 * (p.start + p.length)] == bytes(p.ids)), key=lambda p: p.start)
        covered = np.zeros(n + 1, np.int64)
        for p in own:
            covered[p.start] += 1
            covered[p.start + p.length] -= 1
        assert (np.cumsum(covered)[:n] >= copies).all()
    assert sum(p.length for p in pieces) == sum(len(raw) // 4 * k for (_, raw), k in want.items())


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "a b"), (None, None), (4, "Ab,c <|endoftext|> é x don't"), (4, "Ab,c <|endoftext|> é x don't"), (5, "x" * 40_000), (6, "word " * 9_000), (7, "日本語 テキスト ²½ 😀")]


@pytest.mark.parametrize(("length", "group"), [(64, 4), (4096, 2048), (16, 1)])
def test_packing_of_odd_rows(spark, length, group):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.createDataFrame(rows_of(ODD), SCHEMA).repartition(3)
    check_pieces(bin_packing.packed(docs, path, length, group_docs=group).collect(), ODD, path, length)
    assert bin_packing.packed(docs.where("doc_id > 99"), path).count() == 0


def test_packing_of_the_table(spark):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = bin_packing.packed(docs, path).collect()
    check_pieces(pieces, [(r.doc_id, r.text) for r in docs.collect()], path, 4096)
    by = {(r.doc_id, r.start): r for r in queries.op11_packing(spark, SF).collect()}
    assert sum(r.length for r in by.values()) == sum(p.length for p in pieces)
    whole = {(p.doc_id, p.start, p.length): zlib.crc32(p.ids) for p in pieces}
    assert all(r.ids_crc32 == whole[d, s, r.length] for (d, s), r in by.items() if (d, s, r.length) in whole)


def test_long_words_and_slices(monkeypatch):
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    words = bin_packing.Words(path)
    texts = ["One, two. two,three\n" * 50 + "Y" * 300 + "\x0b é, É. ..., x'S. 9.9. ", "", "<|ENDOFTEXT|> A. <|endoftext|>, B.", "K., ² A\u0308. ½,"]
    want = [words.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    for size, known in ((1 << 20, 10**6), (1, 2), (7, 2), (64, 5), (5000, 3)):
        monkeypatch.setattr(bin_packing, "SLICE_BYTES", size)
        monkeypatch.setattr(bin_packing, "KNOWN_WORDS", known)
        assert [x.tolist() for x in words.ids([t.encode() for t in texts])] == want
    with pytest.raises(ValueError, match="white space"):
        bin_packing.Words(str(public_tokenizers.path("byte_bpe_50k.json")))


def test_first_fit_decreasing():
    draw = random.Random(3)
    for n in (1, 2, 5, 100, 333):
        sizes = sorted((draw.randrange(1, 64) for _ in range(n)), reverse=True)
        room, want = [], []
        for s in sizes:
            b = next((i for i, r in enumerate(room) if r >= s), len(room))
            room += [64] * (b == len(room))
            room[b] -= s
            want.append(b)
        assert bin_packing.first_fit_decreasing(sizes, 64) == want
        made = bin_packing.filled(sizes, 64)
        lengths = [sum(p[2] for p in s) for s in made]
        assert all(not x & (x - 1) for x in lengths) and sum(x < 64 for x in lengths) <= 6
        spans = collections.defaultdict(list)
        for item, start, size in itertools.chain.from_iterable(made):
            spans[item].append((start, start + size))
        assert all([x for s in sorted(spans[i]) for x in s][1:-1] == [e for a, b in zip(sorted(spans[i]), sorted(spans[i])[1:], strict=False) for e in (a[1], b[0])] for i in spans)
        assert {i: sum(e - s for s, e in spans[i]) for i in spans} == dict(enumerate(sizes))


# --- repair


def talk(n, seed, conv=1):
    draw = random.Random(seed)
    texts = ["Hello.", "Hi!", "cut off", "", " \n", "Why? ", "Hello.", None]
    return [(conv, draw.choice([None, *range(n)]), draw.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None]), draw.choice(texts)) for _ in range(n)]


def talks():
    out = [r for k in range(60) for r in talk(k % 13 + 1, k, None if k == 7 else k)]
    out += [(900, t, "user", "Same.") for t in range(40)] + [(901, None, "assistant", "x") for _ in range(5)] + talk(300, 5, 902)
    return out


@pytest.fixture(scope="module")
def conversations(spark):
    schema = "conv_id long, turn long, role string, text string, conv string, place string, edit int, copy int, fault long, name string, later int"
    return spark.createDataFrame([(*r, "c", "p", 1, 2, 3, "n", 4) for r in talks()], schema).repartition(3)


def summary(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize(("long", "block"), [(4096, 65536), (5, 3), (0, 1), (100, 64)])
def test_repair_of_odd_rows(spark, conversations, long, block):
    assert summary(turn_repair.summaries(turn_repair.damaged(conversations), conversations, long, block)) == brute.repairs(talks())


def test_repair_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert summary(queries.op12_turn_repair(spark, SF)) == brute.repairs(rows)


def test_repair_of_nothing(spark, conversations):
    empty = conversations.where("conv_id = -1")
    assert turn_repair.summaries(turn_repair.damaged(empty), empty).count() == 0
    gone = turn_repair.damaged(conversations).where("false")
    out = summary(turn_repair.summaries(gone, conversations))
    assert len(out) == len({r[0] for r in talks()}) and set(out.values()) == {(0, 0, 0, 0, 0, 0, "", brute.sha(""))}


def test_distances_join_over_blocks():
    """A block's matrix gives the distances before it from those behind it, and walks do not depend on the cut."""
    draw = random.Random(4)
    for _ in range(40):
        codes = bytes(draw.randrange(12) for _ in range(30))
        whole = turn_repair.distances(codes)
        cut = draw.randrange(1, 30)
        back = turn_repair.distances(codes[cut:])
        front = turn_repair.distances(codes[:cut], tuple(back[:4]))
        m = turn_repair._matrix(codes[:cut])
        assert front[:4] == whole[:4] == [min(m[4 * x + y] + back[y] for y in range(4)) for x in range(4)]
        a, state = turn_repair.walk(codes[:cut], front)
        b, end = turn_repair.walk(codes[cut:], back, state)
        assert (a + b, end) == turn_repair.walk(codes, whole)


# --- spelling


def test_variants_of_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op13_spelling(spark, SF).collect()}
    assert out == brute.variants(rows)


@pytest.mark.parametrize("most", [4096, 3, 0])
def test_variants_of_odd_rows(spark, most):
    """Neighbours of repeated letters, chains of forms, ties, and few candidates a key, so that keys are cut to single characters."""
    draw = random.Random(6)
    words = ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "baaaaaaa", "aaaaaaab", "aabaaaa", "abababab", "babababa", "ababababa", "élève-élèves", "ÀÉÎõüÿñ", "àÉÎõüÿñ", "straßenbahn", "straßenbahm", "x" * 3000, "x" * 2999 + "y"]
    words += ["".join(draw.choice("ab") for _ in range(draw.randrange(7, 11))) for _ in range(120)]
    texts = [(d, " ".join(draw.choices(words, [200 if i % 9 == 0 else 12 if i % 4 == 0 else 1 for i in range(len(words))], k=150))) for d in range(40)]
    texts += [(None, "aaaaaaa×aaaaaaab÷"), (None, None), (1, ""), (2, "İıaaaaaaa ǅ"), *[(50, "Common wordings " * 30)] * 2, (51, "wordinga wordinga wordingas wordingas")]
    docs = spark.createDataFrame(rows_of(texts), SCHEMA).repartition(3)
    out = spelling.variants(docs, most=most)
    assert {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in out.collect()} == brute.variants(texts)
    assert spelling.variants(docs.where("doc_id > 99")).count() == 0


def test_roots_of_long_chains(spark):
    found = spark.createDataFrame([(f"w{k}", 10**k, f"w{k + 1}" if k < 12 else None) for k in range(13)], "word string, n long, form string")
    assert {r.root for r in spelling.rooted(found).collect()} == {"w12"}


def test_pairs_are_made_once(spark):
    words = spark.createDataFrame([("".join(x), 2) for x in itertools.product("ab", repeat=7)] + [("".join(x), 3) for x in itertools.product("ab", repeat=8)], "word string, n long")
    for most in (10**9, 20):
        pairs = [frozenset((r.word, r.other)) for r in spelling.near_pairs(words, most).collect()]
        assert len(pairs) == len(set(pairs)) == 128 * 7 // 2 + 256 * 8 // 2 + sum(len({x[:i] + x[i + 1 :] for i in range(8)}) for x in itertools.product("ab", repeat=8))
    assert words.select(F.max("n")).first()[0] == 3


def in_duckdb(sql, table, columns, rows):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE TABLE {table} ({columns})")
    db.executemany(f"INSERT INTO {table} VALUES ({', '.join('?' * (columns.count(',') + 1))})", rows)
    cursor = db.execute(sql)
    names = [x[0] for x in cursor.description]
    return [dict(zip(names, r, strict=True)) for r in cursor.fetchall()]


def test_sql_of_odd_rows():
    """The SQL is judged by the same plain forms as the operators."""
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    rows = in_duckdb(oracles.OP12, "conversations", "conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR", talks())
    assert {r["conv_id"]: tuple(r[c] for c in names) for r in rows} == brute.repairs(talks())
    draw = random.Random(8)
    words = ["aaaaaaa", "aaaaaaaa", "baaaaaaa", "ÀÉÎõüÿñ", "àÉÎõüÿñ"] + ["".join(draw.choice("ab") for _ in range(draw.randrange(7, 10))) for _ in range(40)]
    texts = [(d, " ".join(draw.choices(words, [90 if i % 9 == 0 else 1 for i in range(len(words))], k=80))) for d in range(20)] + [(None, "aaaaaaa"), (5, None)]
    rows = in_duckdb(oracles.OP13, "documents", "doc_id BIGINT, text VARCHAR", texts)
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows} == brute.variants(texts)
