"""Repair of conversations whose turns are damaged, by shortest paths over edits.

A conversation's rows in order are read from left to right, and what has been written so far is in one of four states:
nothing, a system turn, a user turn last, an assistant turn last. A node is (rows read, state). Its arcs are
the edits: Delete reads a row and writes nothing, Keep and Rerole read a row and write it, Insert writes an empty
turn. A cheapest way from (0, nothing) to the last row with nothing or an assistant turn last is a cheapest repair.

Costs are small integers, so Dial's bucket queue finds the distances to the end: nodes wait in buckets by
distance, and the buckets are emptied in order. From the start, the tight arcs (those whose cost is the difference
of the distances) are then walked by the least letter, which gives the least of the cheapest audits. An arc's
letter and state name its end, so an audit says which roles were written.

A conversation of up to LONG rows is repaired in one task. The rows of a longer one are dealt by ranges of
(conversation, turn, role, text) and cut into blocks of BLOCK rows; only a byte for each row goes on. A block's distances between
its four states at either end are a matrix, and the matrices of a conversation (16 numbers for each BLOCK rows) give the distances
behind each block; with these each block is walked by itself, from each of the four states it may be entered in.

Order within a turn: by role, then by text. A duplicate has role and text of an earlier row of its conversation.

Defined results: a null role or text is one space; a null turn comes first; rows with a null conv_id are one
conversation. A conversation that lost all its rows has no edits. A role whose first letter is none of s, u and a is
never kept as it is. Repeated rows are duplicates. Empty tables give no rows. Other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import count

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._rows import checkpointed, matched, partitions

LONG = 4096
BLOCK = 1 << 16
FAR = 1 << 60

# What each edit costs, and the state that each writing leads to.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
WRITE = {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
ROLES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
#: Behind the last row turns can be inserted only.
END = (0, 2 * INSERT, INSERT, 0)
TAIL = ("", "II", "I", "")

#: A row's byte: its role's place here times 3, plus its fault.
KINDS = "?sua"
SOUND, MUST_GO, CUT_OFF = range(3)


def _arcs(code: int, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, rows read, next state, cost) of the arcs before a row, by letter."""
    kind, fault = KINDS[code // 3], code % 3
    out = [("D", 1, state, DELETE), ("I", 0, WRITE[state], INSERT)]
    if fault != MUST_GO:
        more = TRUNCATED if fault == CUT_OFF else 0
        if (state, kind) in KEEP:
            out.append(("K", 1, KEEP[state, kind], more))
        out.append(("R", 1, WRITE[state], REROLE + more))
    return out


ARCS = [[_arcs(code, state) for state in range(4)] for code in range(12)]
#: (state before, cost) of the arcs that read a row and come to a state; of those that insert
READING = [[[(p, c) for p in range(4) for _, n, q, c in ARCS[code][p] if n and q == state] for state in range(4)] for code in range(12)]
INSERTING = [[(p, INSERT) for p in range(4) if WRITE[p] == state] for state in range(4)]


def distances(codes: bytes, end: tuple[int, ...] = END) -> list[int]:
    """The distance of node 4 * (rows read) + state to the end, for all nodes, from the distances behind the last row."""
    n = len(codes)
    least = min(end)
    dist = [FAR] * (4 * n + 4)
    buckets: list[list[int]] = []

    def offer(node: int, d: int) -> None:
        if d < dist[node]:
            dist[node] = d
            while len(buckets) <= d:
                buckets.append([])
            buckets[d].append(node)

    for state, d in enumerate(end):
        if d < FAR:
            offer(4 * n + state, d - least)
    for d in count():
        if d >= len(buckets):
            break
        bucket = buckets[d]  # it grows while it is read: keeping a sound row costs nothing
        for node in bucket:
            if dist[node] != d:
                continue
            row, state = divmod(node, 4)
            if row < n:
                for p, c in INSERTING[state]:
                    offer(node - state + p, d + c)
            if row:
                for p, c in READING[codes[row - 1]][state]:
                    offer(node - state - 4 + p, d + c)
        buckets[d] = []
    return [d + least if d < FAR else FAR for d in dist]


def walk(codes: bytes, dist: list[int], state: int = NOTHING) -> tuple[str, int]:
    """The least of the cheapest audits from a state before the first row, and the state behind the last."""
    out, row = [], 0
    while row < len(codes):
        here = dist[4 * row + state]
        if here >= FAR:
            return "", state
        for letter, read, then, cost in ARCS[codes[row]][state]:
            if dist[4 * (row + read) + then] + cost == here:
                out.append(letter)
                row, state = row + read, then
                break
    return "".join(out), state


def written(audit: str, state: int = NOTHING, kinds: Iterable[str] = ()) -> Iterator[str | None]:
    """For each letter the role that it writes; null where it keeps or deletes. `kinds` are the rows' role initials."""
    rows = iter(kinds)
    for letter in audit:
        kind = None if letter == "I" else next(rows)
        if letter == "K":
            state = KEEP[state, kind]
            yield None
        elif letter == "D":
            yield None
        else:
            state = WRITE[state]
            yield ROLES[state]


# --- rows


def damaged(conversations: DataFrame, parts: int = 20) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that a hash of conversation and turn names."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(parts)).alias("hit"),
    ).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    twice = F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))
    return rows.withColumns({"role": role, "text": text}).select("conv_id", "turn", "role", "text", F.explode(twice).alias("copy")).drop("copy")


_SPACE = r"\x20\x09-\x0D"


def _fault(text: Column) -> Column:
    """What is wrong with a row by itself: 'blank', 'truncated' or null."""
    return F.when(~text.rlike(rf"[^{_SPACE}]"), "blank").when(~text.rlike(rf"[.!?][{_SPACE}]*\z"), "truncated")


def _prepared(rows: DataFrame) -> DataFrame:
    """rows with the conversation as a key that is not null, each row's own fault, and the turn in which its role and text first stand if they stand twice."""
    name = F.md5(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    keyed = rows.select(
        F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("id")).alias("conv"), "turn", "role", "text",
        _fault(F.col("text")).alias("fault"), name.alias("name"),
    )
    first = keyed.where("fault is null or fault <> 'blank'").groupBy("conv", "name").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("n"))
    first = first.where("n > 1").select(F.struct("conv", "name").alias("same"), "first")
    out = matched(keyed.withColumn("same", F.struct("conv", "name")), first, "same", "left")
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))
    return out.select("conv", "turn", "role", "text", "fault", later.alias("later"))


ORDER = ["conv", "turn", "role", "text"]
EDITED = pa.schema([
    ("conv", pa.struct([pa.field("none", pa.bool_(), False), pa.field("id", pa.int64(), False)])), ("place", pa.int64()), ("turn", pa.int64()), ("edit", pa.string()),
    ("fault", pa.string()), ("illegal", pa.bool_()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string()),
])
CONV = "conv struct<none: boolean, id: bigint>"
EDITED_DDL = f"{CONV}, place long, turn long, edit string, fault string, illegal boolean, cost long, role string, text string"


def _told(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv, turn, role, text, fault, kind, code) of rows in order, duplicates told."""
    before = None
    for batch in batches:
        convs = batch.column("conv")
        columns = [convs.field("none").to_pylist(), convs.field("id").to_pylist(), *(batch.column(c).to_pylist() for c in ("turn", "role", "text", "fault", "later"))]
        for none, key, turn, role, text, fault, later in zip(*columns, strict=True):
            row = (none, key, turn, role, text)
            if fault != "blank" and (later or row == before):
                fault = "duplicate"
            before = row
            kind = role[:1]
            code = 3 * max(0, KINDS.find(kind, 1) if kind else 0) + (MUST_GO if fault in ("blank", "duplicate") else CUT_OFF if fault else SOUND)
            yield (none, key), turn, role, text, fault, kind, code


def _cost(letter: str, fault: str | None) -> int:
    return {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[letter] + (TRUNCATED if fault == "truncated" and letter in "KR" else 0)


def _edited(conv: tuple, rows: list[tuple]) -> list[tuple]:
    codes = bytes(r[6] for r in rows)
    audit, state = walk(codes, distances(codes))
    audit += TAIL[state]
    out, at, last = [], 0, None
    for place, (letter, role) in enumerate(zip(audit, written(audit, kinds=[r[5] for r in rows]), strict=True)):
        if letter == "I":
            out.append((conv, place, None, "I", None, False, INSERT, role, ""))
            continue
        _, turn, own, text, fault, kind, _ = rows[at]
        out.append((conv, place, turn, letter, fault, at > 0 and last + kind not in LEGAL, _cost(letter, fault), role or own, text))
        at, last = at + 1, kind
    return out


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array([{"none": none, "id": key} for none, key in c] if f.name == "conv" else c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _repaired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole conversations, one after another."""
    now, rows, out, size = None, [], [], 0
    for row in _told(batches):
        if row[0] != now and rows:
            out += _edited(now, rows)
            rows = []
            if size > 1 << 20:
                yield _batch(out, EDITED)
                out, size = [], 0
        now = row[0]
        rows.append(row)
        size += 100 + len(row[3])
    if rows:
        out += _edited(now, rows)
    if out:
        yield _batch(out, EDITED)


# --- long conversations, block by block

NUMBERED = pa.schema([EDITED.field("conv"), ("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), *((c, EDITED.field(c).type) for c in ("turn", "role", "text", "fault")), ("kind", pa.string()), ("code", pa.int32())])
NUMBERED_DDL = f"{CONV}, part long, block long, at long, turn long, role string, text string, fault string, kind string, code int"
BLOCKS = pa.schema([EDITED.field("conv"), ("part", pa.int64()), ("block", pa.int64()), ("codes", pa.binary()), ("kinds", pa.string())])
LETTERS = pa.schema([EDITED.field("conv"), ("part", pa.int64()), ("block", pa.int64()), ("at", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("new_role", pa.string())])
AT = ["conv", "part", "block"]
AT_DDL = f"{CONV}, part long, block long"


def _numbered(size: int):
    """Rows with the block of `size` rows of their conversation in this partition, and their place in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, now, n, out = TaskContext.get().partitionId(), None, 0, []
        for conv, turn, role, text, fault, kind, code in _told(batches):
            now, n = conv, n + 1 if conv == now else 0
            out.append((conv, part, n // size, n % size, turn, role, text, fault, kind, code))
            if len(out) >= 1000:
                yield _batch(out, NUMBERED)
                out = []
        if out:
            yield _batch(out, NUMBERED)

    return run


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block: its rows' codes, and the role initials of its first and last row."""
    now, codes, kinds = None, bytearray(), ["", ""]
    for batch in batches:
        convs = batch.column("conv")
        columns = [convs.field("none").to_pylist(), convs.field("id").to_pylist(), *(batch.column(c).to_pylist() for c in ("part", "block", "code", "kind"))]
        for none, key, part, block, code, kind in zip(*columns, strict=True):
            name = ((none, key), part, block)
            if name != now:
                if now:
                    yield _batch([(*now, bytes(codes), "\n".join(kinds))], BLOCKS)
                now, codes, kinds = name, bytearray(), [kind, kind]
            codes.append(code)
            kinds[1] = kind
    if now:
        yield _batch([(*now, bytes(codes), "\n".join(kinds))], BLOCKS)


def _matrix(codes: bytes) -> list[int]:
    """The distance from each state before a block to each one behind it."""
    columns = [distances(codes, tuple(0 if x == y else FAR for x in range(4)))[:4] for y in range(4)]
    return [columns[y][x] for x in range(4) for y in range(4)]


def _matrices(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in parts:
        yield pdf[["conv", "part", "block"]].assign(matrix=[_matrix(bytes(c)) for c in pdf["codes"]], kinds=pdf["kinds"])


def _ends(pdf: pd.DataFrame) -> pd.DataFrame:
    """The distances behind each block of a conversation, and whether its first row may not follow the row before."""
    pdf = pdf.sort_values(["part", "block"])
    end, ends = END, []
    for m in reversed(pdf["matrix"].tolist()):
        ends.append(list(end))
        end = tuple(min(min(m[4 * x + y] + end[y] for y in range(4)), FAR) for x in range(4))
    kinds = [k.split("\n") for k in pdf["kinds"]]
    illegal = [False, *(a[1] + b[0] not in LEGAL for a, b in zip(kinds, kinds[1:], strict=False))]
    last = [False] * (len(pdf) - 1) + [True]
    return pdf[["conv", "part", "block"]].assign(ends=ends[::-1], illegal=illegal, last=last)


def _walks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The audit of a block and the state behind it, for each state it may be entered in."""
    for pdf in parts:
        audits, states = [], []
        for codes, end, last in zip(pdf["codes"], pdf["ends"], pdf["last"], strict=True):
            dist = distances(bytes(codes), tuple(int(x) for x in end))
            ways = [walk(bytes(codes), dist, state) for state in range(4)]
            audits.append([a + TAIL[s] if last else a for a, s in ways])
            states.append([s for _, s in ways])
        yield pdf[["conv", "part", "block"]].assign(audits=audits, states=states)


def _entries(pdf: pd.DataFrame) -> pd.DataFrame:
    """The state in which each block of a conversation is entered, and the number of edits before it."""
    pdf = pdf.sort_values(["part", "block"])
    state, place, entries, places = NOTHING, 0, [], []
    for states, lengths in zip(pdf["states"], pdf["lengths"], strict=True):
        entries.append(state)
        places.append(place)
        place += int(lengths[state])
        state = int(states[state])
    return pdf[["conv", "part", "block"]].assign(entry=entries, place=places)


def _letters(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each edit of a block; `at` is the row it reads, below zero for an insertion."""
    for batch in batches:
        for row in batch.to_pylist():
            conv, kinds, at, out = (row["conv"]["none"], row["conv"]["id"]), [KINDS[c // 3] for c in row["codes"]], 0, []
            for k, (letter, role) in enumerate(zip(row["audit"], written(row["audit"], row["entry"], kinds), strict=True)):
                out.append((conv, row["part"], row["block"], -1 - k if letter == "I" else at, row["place"] + k, letter, role))
                at += letter != "I"
                if len(out) >= 10_000:
                    yield _batch(out, LETTERS)
                    out = []
            if out:
                yield _batch(out, LETTERS)


def _long(rows: DataFrame, size: int) -> DataFrame:
    n = partitions(rows.sparkSession)
    ranged = rows.repartitionByRange(n, "conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions(*ORDER)
    numbered = checkpointed(ranged.mapInArrow(_numbered(size), NUMBERED_DDL))
    blocks = checkpointed(numbered.select(*AT, "code", "kind").mapInArrow(_blocks, f"{AT_DDL}, codes binary, kinds string"))
    matrices = blocks.mapInPandas(_matrices, f"{AT_DDL}, matrix array<long>, kinds string")
    ends = checkpointed(matrices.groupBy("conv").applyInPandas(_ends, f"{AT_DDL}, ends array<long>, illegal boolean, last boolean"))
    walks = checkpointed(blocks.join(ends, AT).mapInPandas(_walks, f"{AT_DDL}, audits array<string>, states array<int>"))
    lengths = walks.select(*AT, "states", F.transform("audits", F.length).alias("lengths"))
    entries = lengths.groupBy("conv").applyInPandas(_entries, f"{AT_DDL}, entry int, place long")
    chosen = walks.join(entries, AT).join(blocks, AT).select(*AT, "codes", "entry", "place", F.get("audits", F.col("entry")).alias("audit"))
    letters = chosen.mapInArrow(_letters, f"{AT_DDL}, at long, place long, edit string, new_role string")
    pairs = numbered.withColumn("before", F.lag("kind").over(_in_block())).join(ends.select(*AT, F.col("illegal").alias("illegal_first")), AT)
    legal = F.concat("before", "kind").isin(*sorted(LEGAL))
    pairs = pairs.withColumn("illegal", F.when(F.col("at") == 0, F.col("illegal_first")).otherwise(~legal))
    out = letters.join(pairs.select(*AT, "at", "turn", "role", "text", "fault", "illegal"), [*AT, "at"], "left")
    more = F.when((F.col("fault") == "truncated") & F.col("edit").isin("K", "R"), TRUNCATED).otherwise(0)
    cost = F.when(F.col("edit") == "D", DELETE).when(F.col("edit") == "I", INSERT).when(F.col("edit") == "R", REROLE).otherwise(0) + more
    return out.select("conv", "place", "turn", "edit", "fault", F.coalesce("illegal", F.lit(False)).alias("illegal"), cost.cast("long").alias("cost"), F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def _in_block():
    from pyspark.sql import Window

    return Window.partitionBy(*AT).orderBy("at")


def repaired(rows: DataFrame, long: int = LONG, block: int = BLOCK) -> tuple[DataFrame, DataFrame | None]:
    """(conv, place, turn, edit, fault, illegal, cost, role, text) of rows (conv_id, turn, role, text): one row for each edit.

    Deleted rows are among them, with edit D. `illegal` tells that a row may not follow the row that stood before it, `fault` its
    first fault. The first frame has the conversations of up to `long` rows, each conversation's edits next to each
    other and in order; the second one those of longer conversations in no order, or is null if there are none.
    """
    prepared = _prepared(rows)
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > long)
    longer = checkpointed(sizes.select(F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0).cast("long")).alias("id")).alias("conv")))
    some = not longer.isEmpty()
    short = prepared.join(longer, "conv", "left_anti") if some else prepared
    n = partitions(rows.sparkSession)
    ordered = short.repartition(n, "conv").sortWithinPartitions(*ORDER)
    out = ordered.mapInArrow(_repaired, EDITED_DDL)
    return out, _long(prepared.join(longer, "conv", "left_semi"), block) if some else None


SUMMARY = pa.schema([EDITED.field("conv"), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _summed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of edits in order. Texts go through a hash, one after another; nothing of them is kept."""
    now, out = None, []

    def done() -> None:
        gaps = turns[1] - turns[0] + 1 - turns[2] if turns[2] else 0
        out.append((now, gaps, *(faults[c] for c in ("blank", "duplicate", "truncated")), illegal, cost, audit.decode(), digest.hexdigest()))

    for batch in batches:
        convs = batch.column("conv")
        columns = [convs.field("none").to_pylist(), convs.field("id").to_pylist(), *(batch.column(c).to_pylist() for c in EDITED.names[2:])]
        for none, key, turn, edit, fault, odd, price, role, text in zip(*columns, strict=True):
            if (none, key) != now:
                if now:
                    done()
                now, audit, digest, faults, illegal, cost, turns, some = (none, key), bytearray(), hashlib.sha256(), dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0, [0, 0, 0], False
            audit += edit.encode()
            illegal += odd
            cost += price
            if fault:
                faults[fault] += 1
            if turn is not None and (not turns[2] or turn != turns[1]):
                turns = [turn if not turns[2] else turns[0], turn, turns[2] + 1]
            if edit != "D":
                digest.update(f"{chr(10) * some}{role}:{text}".encode())
                some = True
        if len(out) >= 1000:
            yield _batch(out, SUMMARY)
            out = []
    if now:
        done()
    if out:
        yield _batch(out, SUMMARY)


def summaries(rows: DataFrame, ids: DataFrame, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """One row for each conv_id of `ids`: gaps, faults, cost, audit and a digest of the repaired conversation of rows.

    A digest reads a conversation from its first turn to its last, so the edits of a long one stream through one task
    in order; no task keeps more of it than its audit.
    """
    short, longer = repaired(rows, long, block)
    ddl = f"{CONV}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = short.mapInArrow(_summed, ddl)
    if longer is not None:
        n = partitions(rows.sparkSession)
        out = out.unionByName(longer.repartition(n, "conv").sortWithinPartitions("conv", "place").mapInArrow(_summed, ddl))
    found = out.select(F.when(~F.col("conv.none"), F.col("conv.id")).alias("conv_id"), F.lit(True).alias("found"), "*").drop("conv")
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    joined = every.alias("e").join(found.alias("f"), F.expr("e.conv_id <=> f.conv_id"), "left")
    numbers = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("e.conv_id", *numbers, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
