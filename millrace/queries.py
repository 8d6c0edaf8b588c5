"""Queries over the test tables, one for each operator, and the same in SQL where SQL can say it."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import files, maps
from millrace.functions.checkpoints import checkpointed, shared_folder
from millrace.functions.hashing import uniform
from millrace.functions.spread import spread
from millrace.functions.text import strip
from millrace.operators import dedup, fim, formatters, mixing, numeric, packing, quality, rewards
from millrace.operators import tokenize as tok
from millrace.plans.compile import prepared
from millrace.sources import tables, templates

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


# --- text rules in SQL, shared by several oracles
_WS = r"[\p{Z}\t\n\x0b\x0c\r\x1c-\x1f\x85]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


_LINES = f"string_split({_strip('text')}, chr(10))"
_DUPLICATES = f"CASE WHEN len({_LINES}) > 5 THEN 1.0 - len(list_distinct(list_filter(list_transform({_LINES}, lambda x: {_strip('x')}), lambda x: x <> '')))::DOUBLE / len({_LINES}) ELSE 0.0 END"
_SYMBOLS = rf"length(regexp_replace(text, '[\p{{L}}\p{{N}}\p{{Z}}\t\n\x0b\x0c\r\x1c-\x1f\x85]', '', 'g'))::DOUBLE / greatest(length(text), 1)"


def _passes(least: int = 64) -> str:
    return rf"(length(text) BETWEEN {least} AND 100000 AND regexp_matches(text, '[^\p{{Z}}\t\n\x0b\x0c\r\x1c-\x1f\x85]') AND {_SYMBOLS} <= 0.35 AND {_DUPLICATES} <= 0.40)"


_EDU = "greatest(0.0, least(5.0, 2.5 + " + " + ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{p}\\b') THEN 0.25 ELSE 0 END" for p in quality.RAISING) + " + CASE WHEN contains(text, '```') OR contains(text, 'def ') OR contains(text, 'class ') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(text, '(?m)^#{1,4}\\s+') OR regexp_matches(text, '(?m)^\\d+\\.\\s+') THEN 0.3 ELSE 0 END - " + " - ".join(f"CASE WHEN regexp_matches(text, '(?i)\\b{p}\\b') THEN 0.5 ELSE 0 END" for p in quality.LOWERING) + "))"
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"
_SHINGLES = f"SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: {_HASH.format('array_to_string(w[i:i+4], chr(32))')}) ELSE [{_HASH.format('lower(text)')}] END) AS s FROM (SELECT doc_id, text, {_WORDS} AS w FROM documents"
_COEFFICIENTS = "[" + ", ".join(f"{{'a': {a}::BIGINT, 'b': {b}::BIGINT}}" for a, b in dedup.coefficients()) + "]"
_SIGNED = f"SELECT doc_id, list_transform({_COEFFICIENTS}, lambda c: list_min(list_transform(s, lambda x: (x * c.a + c.b) % {dedup.PRIME}))) AS sig FROM sh"


def _bands(where: str = "") -> str:
    return f"WITH sh AS ({_SHINGLES} {where})), si AS ({_SIGNED}) SELECT doc_id, band, array_to_string(sig[band*8+1:band*8+8], ',') AS key FROM si, range(16) AS r(band)"


def _kept(where: str = "") -> str:
    """CTEs that end in kept(doc_id): documents in order, dropped if they share a band with a kept one."""
    return f"""b AS ({_bands(where)}), k AS MATERIALIZED (SELECT doc_id, list(hash(band || ':' || key)) AS keys, row_number() OVER (ORDER BY doc_id) AS o FROM b GROUP BY doc_id),
  g(o, seen, doc_id, keep) AS (SELECT 0::BIGINT, []::UBIGINT[], NULL::BIGINT, false
    UNION ALL SELECT k.o, CASE WHEN list_has_any(g.seen, k.keys) THEN g.seen ELSE list_concat(g.seen, k.keys) END, k.doc_id, NOT list_has_any(g.seen, k.keys) FROM g JOIN k ON k.o = g.o + 1),
  kept AS (SELECT doc_id FROM g WHERE keep)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(tables.table(spark, sf_dir, "documents"))


# --- quality
@query("quality_measures", f"SELECT doc_id, length(text)::BIGINT AS n_chars, round({_SYMBOLS}, 9) AS symbol_ratio, round({_DUPLICATES}, 9) AS duplicate_ratio, {_passes(64)} AS passes FROM documents")
def quality_measures(spark, sf_dir):
    t = F.col("text")
    return _documents(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("n_chars"), F.round(quality.symbol_ratio(t), 9).alias("symbol_ratio"), F.round(quality.duplicate_line_ratio(t), 9).alias("duplicate_ratio"), quality.passes(t).alias("passes"))


@query("educational_score", f"SELECT doc_id, round({_EDU}, 6)::DOUBLE AS score FROM documents")
def educational_score(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", F.round(quality.educational_score(F.col("text")), 6).alias("score"))


@query("source_acceptance", f"SELECT d.doc_id, (coalesce(l.quality * 4.5, 0) >= 4.0 OR {_EDU} >= 4.0) AND {_passes(128)} AS accepted FROM documents d LEFT JOIN labels l USING (doc_id)")
def source_acceptance(spark, sf_dir):
    joined = _documents(spark, sf_dir).join(tables.table(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", quality.accepted_source(F.col("text"), F.col("quality") * 4.5).alias("accepted"))


@query("stage_counters", f"SELECT source, count(*)::BIGINT AS documents, count_if({_passes(64)})::BIGINT AS kept, count_if(NOT {_passes(64)})::BIGINT AS filtered FROM documents GROUP BY source")
def stage_counters(spark, sf_dir):
    ok = quality.passes(F.col("text"))
    return _documents(spark, sf_dir).groupBy("source").agg(F.count("*").alias("documents"), F.count_if(ok).alias("kept"), F.count_if(~ok).alias("filtered"))


# --- near-duplicates
@query("shingles", f"SELECT doc_id, len(s)::BIGINT AS n, list_sum(s)::BIGINT AS total FROM ({_SHINGLES}))")
def shingles(spark, sf_dir):
    s = _documents(spark, sf_dir).select("doc_id", dedup.shingles(F.col("text")).alias("s"))
    return s.select("doc_id", F.size("s").cast("long").alias("n"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("minhash_bands", _bands())
def minhash_bands(spark, sf_dir):
    sig = dedup.signatures(_documents(spark, sf_dir).select("doc_id", dedup.shingles(F.col("text")).alias("s")), "doc_id")
    each = sig.select("doc_id", F.posexplode(dedup.bands(F.col("sig"))).alias("band", "key"))
    return each.select("doc_id", F.col("band").cast("long").alias("band"), F.array_join("key", ",").alias("key"))


@query("greedy_dedup", f"WITH RECURSIVE {_kept('WHERE ' + _passes())} SELECT doc_id FROM kept")
def greedy_dedup(spark, sf_dir):
    return dedup.greedy_kept(dedup.band_rows(quality.quality_filter(_documents(spark, sf_dir)))).select(F.col("ord").alias("doc_id"))


# --- mixing
@query("phase_quotas", "SELECT source, n, greatest(1, floor(n * 0.5)::BIGINT) AS one, greatest(1, floor(n * 0.34)::BIGINT) AS two, greatest(1, n - greatest(1, floor(n * 0.5)::BIGINT) - greatest(1, floor(n * 0.34)::BIGINT)) AS three FROM (SELECT source, sum(n_chars)::BIGINT AS n FROM documents GROUP BY source)")
def phase_quotas(spark, sf_dir):
    """Each source's characters as a budget for the three phases."""
    totals = _documents(spark, sf_dir).groupBy("source").agg(F.sum("n_chars").alias("n"))
    return totals.select("source", "n", *[q.alias(name) for name, q in zip(("one", "two", "three"), mixing.quota_columns(F.col("n")), strict=True)])


@query("first_n_per_source", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 7")
def first_n_per_source(spark, sf_dir):
    return mixing.first_n(_documents(spark, sf_dir).select("doc_id", "source"), "source", "doc_id", 7)


@query("seeded_shuffle", "SELECT doc_id, (row_number() OVER (ORDER BY md5('42|' || doc_id), doc_id))::BIGINT AS place FROM documents")
def seeded_shuffle(spark, sf_dir):
    return mixing.placed(_documents(spark, sf_dir).select("doc_id"), "doc_id").select("doc_id", "place")


_SLOTS = """SELECT slot, source, row_number() OVER (PARTITION BY source ORDER BY slot) - 1 AS ordinal FROM (
  SELECT turn_ * 100 + row_number() OVER (PARTITION BY turn_ ORDER BY md5('42|' || turn_ || '|' || k), k) - 1 AS slot, source FROM (
    SELECT r.turn_, a.k, CASE WHEN k < 62 THEN 'en' WHEN k < 77 THEN 'fr' WHEN k < 90 THEN 'de' ELSE 'es' END AS source FROM range(5) r(turn_), range(100) a(k)))"""
_PATTERN = {"en": 62, "fr": 15, "de": 13, "es": 10}


@query("interleave", f"WITH s AS ({_SLOTS}), p AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT s.slot::BIGINT AS slot, s.source, p.doc_id FROM s JOIN p ON p.source = s.source AND p.k = s.ordinal % p.n")
def interleave(spark, sf_dir):
    slots = mixing.round_slots(spark, 5, _PATTERN)
    pool = _documents(spark, sf_dir).select(F.col("lang").alias("source"), "doc_id")
    return mixing.interleave(slots, pool, "doc_id").select("slot", "source", "doc_id")


@query("token_budget", "SELECT doc_id, n FROM (SELECT doc_id, strlen(text)::BIGINT AS n, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS before FROM documents) WHERE floor(before / 4096) * 4096 < 1000000")
def token_budget(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return mixing.within_budget(docs, "doc_id", "n", 4096, 1_000_000)


@query("shares", "SELECT source, count(*)::DOUBLE / (SELECT count(*) FROM documents) AS share FROM documents GROUP BY source")
def shares(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return docs.groupBy("source").agg(F.count("*").cast("double").alias("n")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("all")))).select("source", (F.col("n") / F.col("all")).alias("share"))


# --- tokens, packing
@query("packed_chunks", """WITH g AS (SELECT doc_id, strlen(text)::BIGINT AS n, sum(strlen(text)) OVER (ORDER BY doc_id) - strlen(text) AS g FROM documents),
  c AS (SELECT doc_id, n, g, unnest(range((g // 4096)::BIGINT, ((g + n - 1) // 4096)::BIGINT + 1)) AS seq_id FROM g WHERE n > 0)
  SELECT seq_id, count(*)::BIGINT AS documents, sum(least(g + n, (seq_id + 1) * 4096) - greatest(g, seq_id * 4096))::BIGINT AS tokens, min(doc_id) AS first_doc FROM c GROUP BY seq_id""")
def packed_chunks(spark, sf_dir):
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return packing.chunks(docs, "doc_id", "n", 4096).groupBy("seq_id").agg(F.count("*").alias("documents"), F.sum("take").cast("long").alias("tokens"), F.min("doc_id").alias("first_doc"))


@functools.cache
def _tokenizer() -> tok.Tokenizer:
    return tok.Tokenizer()


@query("encode_tokens")
def encode_tokens(spark, sf_dir):
    ids = _documents(spark, sf_dir).select("doc_id", tok.encode(F.col("text"), _tokenizer()).alias("ids"))
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.xxhash64("ids").alias("ids_hash"))


@query("decode_round_trip", "SELECT conv_id, turn, text, true AS same FROM conversations")
def decode_round_trip(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations")
    back = rows.withColumn("back", tok.decode(tok.encode(F.col("text"), _tokenizer()), _tokenizer()))
    return back.select("conv_id", "turn", F.col("back").alias("text"), (F.col("back") == F.col("text")).alias("same"))


@query("unprintable_tokens", r"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS c FROM conversations), b AS (SELECT conv_id, turn, hex(encode(c)) AS h FROM c WHERE c <> '')
  SELECT conv_id, turn, sum(len(h) // 2)::BIGINT AS tokens, coalesce(sum(len(h) // 2) FILTER (WHERE NOT regexp_matches(h, '^(0[9AD]|[2-6][0-9A-F]|7[0-9A-E])$')), 0)::BIGINT AS masked FROM b GROUP BY conv_id, turn""")
def unprintable_tokens(spark, sf_dir):
    """Tokens of each turn, and those among them that a vocabulary of single bytes masks as unprintable."""
    by_byte = tok.Tokenizer(tok.build_ranks((), 256 + len(tok.SPECIAL)), name="bytes")
    rows = tables.table(spark, sf_dir, "conversations").where("text <> ''")
    tokens = rows.select("conv_id", "turn", F.explode(tok.encode(F.col("text"), by_byte)).alias("token_id"))
    told = tokens.join(F.broadcast(tok.vocabulary(spark, by_byte).select("token_id", "printable")), "token_id")
    return told.groupBy("conv_id", "turn").agg(F.count("*").alias("tokens"), F.count_if(~F.col("printable")).alias("masked"))


def _code_points(text):
    """A text's characters as numbers, which SQL can make, too."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c))


_POINTS = "list_transform(string_split(text, ''), lambda c: unicode(c))"
_DRAW = "('0x' || substr(md5('42|{0}|' || key), 1, 8))::BIGINT / 4294967296.0"
_JOINED = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))


@query("fill_in_middle", f"""WITH x AS (SELECT conv_id, turn, conv_id || '-' || turn AS key, {_POINTS} AS ids FROM conversations),
  a AS (SELECT *, len(ids) AS n, 1 + floor({_DRAW.format('cut1')} * (len(ids) - 2))::INT AS one FROM x),
  b AS (SELECT *, one + 1 + floor({_DRAW.format('cut2')} * (n - 1 - one))::INT AS two FROM a),
  c AS (SELECT *, ids[1:one] AS pre, ids[one+1:two] AS mid, ids[two+1:n] AS suf FROM b),
  m AS (SELECT conv_id, turn, n, CASE WHEN n < 16 OR {_DRAW.format('apply')} > 0.5 THEN ids WHEN {_DRAW.format('order')} < 0.5 THEN flatten([[10], suf, [8], pre, [9], mid, [2]]) ELSE flatten([[8], pre, [10], suf, [9], mid, [2]]) END AS moved FROM c),
  e AS (SELECT conv_id, turn, n, CASE WHEN moved[-1] = 2 THEN moved ELSE list_append(moved, 2) END AS moved FROM m)
  SELECT conv_id, turn, n::INT AS before, len(moved)::INT AS after, md5(array_to_string(moved, ',')) AS moved FROM e""")
def fill_in_middle(spark, sf_dir):
    ids = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", _code_points(F.col("text")).alias("ids"))
    moved = ids.select("conv_id", "turn", "ids", fim.with_end(fim.fill_in_middle(F.col("ids"), F.concat_ws("-", "conv_id", "turn"))).alias("moved"))
    return moved.select("conv_id", "turn", F.size("ids").alias("before"), F.size("moved").alias("after"), _JOINED("moved").alias("moved"))


@query("packed_sequences", f"""WITH x AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc, list_append({_POINTS}, 2) AS ids FROM conversations),
  t AS (SELECT doc, unnest(ids) AS id, unnest(range(len(ids))) AS k FROM x), g AS (SELECT id, doc, row_number() OVER (ORDER BY doc, k) - 1 AS i FROM t),
  s AS (SELECT i // 512 AS seq_id, list(id ORDER BY i) AS ids, list(doc ORDER BY i) AS docs FROM g GROUP BY 1), d AS (SELECT count(*) AS n FROM x)
  SELECT seq_id::BIGINT AS seq_id, md5(array_to_string(list_resize(ids, 512, 0), ',')) AS input_ids, md5(array_to_string(list_resize(ids, 512, -100), ',')) AS labels,
    md5(array_to_string(list_resize(range(len(ids)), 512, 0), ',')) AS position_ids, md5(array_to_string(list_resize(docs, 512, d.n), ',')) AS document_ids FROM s, d""")
def packed_sequences(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), fim.with_end(_code_points(F.col("text"))).alias("ids"))
    out = packing.pack(checkpointed(rows), "ord", "ids", 512)
    return out.select("seq_id", *[_JOINED(c).alias(c) for c in ("input_ids", "labels", "position_ids", "document_ids")])


@query("incremental_decode", """WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, unnest(range(1, len(text) + 1)) AS i FROM conversations),
  b AS (SELECT conv_id, turn, c, sum(strlen(c)) OVER (PARTITION BY conv_id, turn ORDER BY i) - strlen(c) AS low FROM c)
  SELECT conv_id, turn, (low + k)::INT AS pos, CASE WHEN k = strlen(c) - 1 THEN c ELSE '' END AS chunk FROM (SELECT conv_id, turn, c, low, unnest(range(strlen(c))) AS k FROM b)""")
def incremental_decode(spark, sf_dir):
    code = F.split(F.regexp_replace(F.hex(F.encode(F.col("text"), "utf-8")), "(..)(?=.)", "$1 "), " ")
    each = tables.table(spark, sf_dir, "conversations").where("text <> ''").select("conv_id", "turn", F.posexplode(code).alias("pos", "x"))
    tokens = each.select("conv_id", "turn", "pos", (F.conv("x", 16, 10).cast("int") + len(tok.SPECIAL)).alias("token_id"))
    return tok.text_chunks(tokens, ["conv_id", "turn"], "pos", "token_id", _tokenizer())


# --- formatters
@query("proof_text", """SELECT doc_id, '# Subject: ' || coalesce(source, 'Mathematics') || ' (Level ' || coalesce(NULL, 'Advanced') || ')' || chr(10) || chr(10) || '## Mathematical Theorem / Problem Specification' || chr(10) || lang || chr(10) || chr(10) || '## Formal Step-by-Step Proof and Derivation' || chr(10) || """ + _strip("text") + """ || chr(10) AS proof FROM documents""")
def proof_text(spark, sf_dir):
    return _documents(spark, sf_dir).select("doc_id", formatters.proof(F.col("source"), F.lit(None).cast("string"), F.col("lang"), F.col("text")).alias("proof"))


@query("agent_turn", "SELECT conv_id, turn, CASE role WHEN 'system' THEN '<|thought start|>' || text || '<|thought end|>' WHEN 'assistant' THEN '<|reflect|>' || text ELSE text END AS formatted FROM conversations")
def agent_turn(spark, sf_dir):
    of = lambda role: F.when(F.col("role") == role, F.col("text"))
    none = F.lit(None).cast("string")
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", formatters.turn(of("system"), none, F.lit(""), of("assistant"), of("user")).alias("formatted"))


@query("chat_prompt", "SELECT conv_id, turn, '<|bos|>User: ' || text || chr(10) || '<|thought start|>' AS prompt FROM conversations WHERE role = 'user'")
def chat_prompt(spark, sf_dir):
    return tables.table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", formatters.chat_prompt(F.col("text")).alias("prompt"))


@query("tool_dialogue", """SELECT conv_id, turn, '<|bos|>User: ' || """ + _strip("text") + """ || chr(10) || '<|thought start|>I should invoke the requested tool with the parsed parameters.<|thought end|><|call tool|>' || chr(10) || '{"name": "f"}' || chr(10) || '<|tool response|>' || chr(10) || '{"ok": true}' || chr(10) || '<|reflect|>Execution returned result without error. Formulating final answer to the user.' || chr(10) || 'Final Response: done<|eos|>' AS formatted FROM conversations""")
def tool_dialogue(spark, sf_dir):
    chat = F.concat(F.lit("USER: "), F.col("text"), F.lit('\nASSISTANT: <functioncall> {"name": "f"} <|endoftext|>\nFUNCTION RESPONSE: {"ok": true}\nASSISTANT: done <|endoftext|>'))
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", formatters.tool_dialogue(chat).alias("formatted"))


@query("token_count_literals", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id || 'M' WHEN 1 THEN ' ' || event_id || '.5b' WHEN 2 THEN event_id || 'k ' WHEN 3 THEN event_id::VARCHAR WHEN 4 THEN event_type END AS literal,
  CASE event_id % 6 WHEN 0 THEN event_id * 1000000 WHEN 1 THEN event_id * 1000000000 + 500000000 WHEN 2 THEN event_id * 1000 WHEN 3 THEN event_id END::BIGINT AS n FROM events""")
def token_count_literals(spark, sf_dir):
    """Numbers of events as people write counts, with words and nulls among them."""
    i = F.col("event_id").cast("string")
    ways = [F.concat(i, F.lit("M")), F.concat(F.lit(" "), i, F.lit(".5b")), F.concat(i, F.lit("k ")), i, F.col("event_type")]
    literal = F.when(F.lit(False), "")
    for k, way in enumerate(ways):
        literal = literal.when(F.col("event_id") % 6 == k, way)
    rows = tables.table(spark, sf_dir, "events").select("event_id", literal.alias("literal"))
    return rows.withColumn("n", formatters.token_count(F.col("literal")))


@query("prompt_prefix", f"SELECT doc_id, 'User: Write a python solution for: ' || {_strip('text')} || chr(10) AS prompt FROM documents WHERE {_strip('text')} <> '' ORDER BY doc_id LIMIT 33")
def prompt_prefix(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("text").alias("instruction"))
    none = spark.createDataFrame([], "ord long, problem string, chat string")
    out = mixing.prompts(none, docs, none, 99)
    return out.select(F.col("ord").alias("doc_id"), "prompt")


# --- rewards (rules 1-4, A4, A5, A12)
_COMPLETION = """CASE conv_id % 6 WHEN 4 THEN text || chr(10) || '```python' || chr(10) || 'x = [1]' || chr(10) || '```' || chr(10) || '```python' || chr(10) || 'def f(): pass' || chr(10) || '```' WHEN 5 THEN '```python' || chr(10) || 'def (:' || chr(10) || '```' || text WHEN 0 THEN '<|thought start|>' || text || '<|thought end|><|call tool|>{"tool": "t"} rest' WHEN 1 THEN '<|thought start|>' || text WHEN 2 THEN text || '<|call tool|>no brace<|reflect|>' || text ELSE '<|call tool|>{"other": 1}<|reflect|> ab ' END"""


@query("completion_reward", f"""WITH x AS (SELECT conv_id, turn, CASE conv_id % 6 WHEN 3 THEN 0.5 WHEN 4 THEN 2.0 ELSE 0.0 END::DOUBLE AS syntax_reward, CASE conv_id % 6 WHEN 0 THEN 2.0 ELSE 0.0 END::DOUBLE AS tool_reward,
  CASE conv_id % 6 WHEN 1 THEN -1.5 WHEN 2 THEN -1.5 WHEN 5 THEN -1.0 ELSE 0.0 END::DOUBLE AS format_penalty,
  CASE WHEN contains(c, '<|reflect|>') AND length({_strip("string_split(c, '<|reflect|>')[-1]")}) > 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS reflection_reward
  FROM (SELECT conv_id, turn, {_COMPLETION} AS c FROM conversations)) SELECT *, syntax_reward + tool_reward + format_penalty + reflection_reward AS total_reward FROM x""")
def completion_reward(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_COMPLETION).alias("completion"))
    return rewards.reward(rows).drop("completion")


@query("group_advantage", "SELECT event_id, round((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8), 5) AS advantage FROM events WINDOW w AS (PARTITION BY event_id // 8)")
def group_advantage(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").withColumn("g", F.floor(F.col("event_id") / 8))
    return rows.select("event_id", F.round(rewards.advantage("value", "g"), 5).alias("advantage"))


@query("group_summary", "SELECT (event_id // 8)::BIGINT AS g, round(avg(value), 6) AS mean_reward, max(value) AS max_reward, min(value) AS min_reward FROM events GROUP BY 1")
def group_summary(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").withColumn("g", F.floor(F.col("event_id") / 8))
    return rewards.group_summary(rows, "value", "g").withColumn("mean_reward", F.round("mean_reward", 6))


# --- numeric
@query("loss_anomaly", "SELECT event_id, user_id, (count(value) OVER w >= 10 AND coalesce(value > avg(value) OVER w + 3.5 * greatest(stddev_pop(value) OVER w, 0.1), false)) AS anomalous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING)")
def loss_anomaly(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", "user_id", numeric.anomalous("value", "event_id", "user_id").alias("anomalous"))


@query("loss_anomaly_rollback", """WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events),
  h(user_id, event_id, r, kept, anomalous) AS (SELECT DISTINCT user_id, NULL::BIGINT, 0::BIGINT, []::DOUBLE[], false FROM events
    UNION ALL SELECT user_id, event_id, r, CASE WHEN bad THEN kept ELSE list_append(kept, value)[-50:] END, bad FROM (
      SELECT o.user_id, o.event_id, o.r, o.value, h.kept, o.value IS NULL OR NOT isfinite(o.value) OR (len(h.kept) >= 10 AND o.value > list_avg(h.kept) + 3.5 * greatest(list_stddev_pop(h.kept), 0.1)) AS bad
      FROM h JOIN o ON o.user_id = h.user_id AND o.r = h.r + 1))
  SELECT user_id, event_id, anomalous FROM h WHERE r > 0""")
def loss_anomaly_rollback(spark, sf_dir):
    return numeric.anomalous_with_rollback(tables.table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "value", "event_id", "user_id")


def _schedule_sql(total: int) -> str:
    w, d = int(0.05 * total), int(0.05 * total) + int(0.75 * total)
    t = f"least(1.0, (step - {d}) / {max(1, total - d)}::DOUBLE)"
    return f"SELECT step, round(CASE WHEN step < {w} THEN (step + 1) / {max(1, w)}::DOUBLE WHEN step < {d} THEN 1.0 ELSE 0.1 + 0.9 * (1 - sqrt(greatest({t}, 0))) END, 9) AS sqrt_, round(CASE WHEN step < {w} THEN (step + 1) / {max(1, w)}::DOUBLE WHEN step < {d} THEN 1.0 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * {t})) END, 9) AS cosine_, round(CASE WHEN step < {w} THEN (step + 1) / {max(1, w)}::DOUBLE WHEN step < {d} THEN 1.0 ELSE 0.1 + 0.9 * (1 - {t}) END, 9) AS linear_ FROM (SELECT event_id AS step FROM events)"


@query("lr_schedule", _schedule_sql(5000))
def lr_schedule(spark, sf_dir):
    """Events as steps of a run of 5000; later ones stay at the floor."""
    s = F.col("event_id")
    return tables.table(spark, sf_dir, "events").select(s.alias("step"), *[F.round(numeric.schedule(s, 5000, decay=k), 9).alias(f"{k}_") for k in ("sqrt", "cosine", "linear")])


_LOGITS = "SELECT vec_id, i - 1 AS token_id, embedding[i]::DOUBLE AS logit FROM embeddings, range(1, {0}) r(i)"


@query("router_balance", f"WITH x AS ({_LOGITS.format(65)}), p AS (SELECT vec_id, token_id, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) AS r FROM x) SELECT token_id::INT AS expert, round(count_if(r <= 2) / (count(*) * 2.0), 9)::DOUBLE AS dispatched, round(avg(p), 9) AS mean_p, round(64 * count_if(r <= 2) / (count(*) * 2.0) * avg(p), 9) AS part FROM p GROUP BY token_id")
def router_balance(spark, sf_dir):
    out = numeric.load_balance(numeric.exploded(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id")
    return out.select("expert", *[F.round(c, 9).alias(c) for c in ("dispatched", "mean_p", "part")])


@query("router_top2", f"WITH x AS ({_LOGITS.format(65)}), t AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) <= 2) SELECT vec_id, token_id::INT AS token_id, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id), 9) AS weight FROM t")
def router_top2(spark, sf_dir):
    out = numeric.routed(numeric.exploded(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id")
    return out.select("vec_id", "token_id", F.round("weight", 9).alias("weight"))


@query("sampling_filter", f"""WITH x AS (SELECT vec_id, token_id, logit / 0.8 AS logit FROM ({_LOGITS.format(65)})), k AS (SELECT * FROM x QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 20),
  p AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM k), n AS (SELECT vec_id, token_id, logit FROM p QUALIFY sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING) - p <= 0.9),
  q AS (SELECT *, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM n), m AS (SELECT vec_id, token_id, logit FROM q QUALIFY p >= 0.05 * max(p) OVER (PARTITION BY vec_id))
  SELECT vec_id, token_id::INT AS token_id, round(exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id), 7) AS p FROM m""")
def sampling_filter(spark, sf_dir):
    logits = numeric.exploded(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    out = numeric.sampling_filter(logits, "vec_id", temperature=0.8, top_k=20, top_p=0.9, min_p=0.05)
    return out.select("vec_id", "token_id", F.round("p", 7).alias("p"))


@query("repetition_penalty", f"WITH x AS ({_LOGITS.format(65)}) SELECT vec_id, token_id::INT AS token_id, round(CASE WHEN token_id IN (1, 2, 3) AND logit > 0 THEN logit / 1.2 WHEN token_id IN (1, 2, 3) THEN logit * 1.2 ELSE logit END, 9) AS logit FROM x WHERE token_id NOT IN (7, 8)")
def repetition_penalty(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings")
    seen = vectors.select("vec_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 3)))).alias("token_id"))
    masked = spark.createDataFrame([(7,), (8,)], "token_id int")
    out = numeric.penalised(numeric.suppressed(numeric.exploded(vectors, "vec_id", "embedding"), masked), seen, "vec_id", 1.2)
    return out.select("vec_id", "token_id", F.round("logit", 9).alias("logit"))


@query("argmax", f"SELECT vec_id, token_id::INT AS token_id FROM ({_LOGITS.format(65)}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token_id) = 1")
def argmax(spark, sf_dir):
    return numeric.argmax(numeric.exploded(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding"), "vec_id").select("vec_id", "token_id")


@query("categorical_draw", f"""WITH x AS ({_LOGITS.format(65)}), k AS (SELECT * FROM x QUALIFY rank() OVER (PARTITION BY vec_id ORDER BY logit DESC) <= 20),
  p AS (SELECT vec_id, token_id, exp(logit) / sum(exp(logit)) OVER (PARTITION BY vec_id) AS p FROM k),
  c AS (SELECT vec_id, token_id, sum(p) OVER (PARTITION BY vec_id ORDER BY p DESC, token_id ROWS UNBOUNDED PRECEDING) AS c, ('0x' || substr(md5('42|draw|' || vec_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM p)
  SELECT vec_id, coalesce(arg_min(token_id, c) FILTER (WHERE c > u), arg_max(token_id, c))::INT AS token_id FROM c GROUP BY vec_id""")
def categorical_draw(spark, sf_dir):
    logits = numeric.exploded(tables.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return numeric.drawn(numeric.sampling_filter(logits, "vec_id", top_k=20), "vec_id")


@query("cross_entropy", f"WITH x AS ({_LOGITS.format(65)}), n AS (SELECT x.vec_id, ln(sum(exp(logit))) - max(CASE WHEN token_id = label THEN logit END) AS nll FROM x JOIN embeddings e ON e.vec_id = x.vec_id WHERE x.vec_id % 5 <> 0 GROUP BY x.vec_id) SELECT round(avg(nll), 7) AS loss, round(exp(least(avg(nll), 20)), 6) AS perplexity, count(*)::BIGINT AS n FROM n")
def cross_entropy(spark, sf_dir):
    vectors = tables.table(spark, sf_dir, "embeddings")
    targets = vectors.select("vec_id", F.when(F.col("vec_id") % 5 == 0, -100).otherwise(F.col("label")).alias("target"))
    out = numeric.cross_entropy(numeric.exploded(vectors, "vec_id", "embedding"), targets, "vec_id")
    return out.select(F.round("loss", 7).alias("loss"), F.round("perplexity", 6).alias("perplexity"), "n")


@query("causal_convolution", "SELECT event_id, round(0.4 * value + 0.3 * coalesce(lag(value, 1) OVER w, 0) + 0.2 * coalesce(lag(value, 2) OVER w, 0) + 0.1 * coalesce(lag(value, 3) OVER w, 0), 6) AS y FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def causal_convolution(spark, sf_dir):
    return tables.table(spark, sf_dir, "events").select("event_id", F.round(numeric.causal_convolution("value", "event_id", "user_id"), 6).alias("y"))


@query("recurrence", "WITH RECURSIVE o AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events), h AS (SELECT user_id, event_id, r, value AS h FROM o WHERE r = 1 UNION ALL SELECT o.user_id, o.event_id, o.r, cos(o.event_id) * h.h + o.value FROM h JOIN o ON o.user_id = h.user_id AND o.r = h.r + 1) SELECT user_id, event_id, round(h, 5) AS h FROM h")
def recurrence(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select("user_id", "event_id", F.cos("event_id").alias("a"), F.col("value").alias("b"))
    return numeric.recurrence(rows, "user_id", "event_id", "a", "b").withColumn("h", F.round("h", 5))


@query("retention", "WITH c AS (SELECT event_id AS step, event_id % 7 = 3 AS healthy FROM events) SELECT step, healthy FROM (SELECT * FROM c ORDER BY step DESC LIMIT 5) UNION SELECT step, healthy FROM (SELECT * FROM c WHERE healthy ORDER BY step DESC LIMIT 1)")
def retention(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("event_id") % 7 == 3).alias("healthy"))
    return numeric.retained(rows)


@query("cache_footprint", "SELECT doc_id, n_chars AS length, round(6 * 24 * n_chars * 2 / 1048576.0, 3)::DOUBLE AS mb, ceil(n_chars * 1000 / (8.0 * 16 * 4096))::BIGINT AS steps FROM documents")
def cache_footprint(spark, sf_dir):
    """What a cache for each document's characters takes, and the steps of a thousand such documents."""
    n = F.col("n_chars")
    return _documents(spark, sf_dir).select("doc_id", n.alias("length"), numeric.cache_footprint(F.lit(6), F.lit(24), n).cast("double").alias("mb"), numeric.steps_per_epoch(n * 1000, 8, 16, 4096).alias("steps"))


@query("throughput", """WITH r AS (SELECT event_id, (event_id - lag(event_id) OVER w) / nullif(epoch(ts) - epoch(lag(ts) OVER w), 0) AS rate FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT event_id, rate, greatest(0.0, 1000000 - event_id) / CASE WHEN rate > 0 THEN rate END AS s FROM r)
  SELECT event_id, round(rate, 6) AS tokens_per_s, CASE WHEN s < 3600 THEN printf('%.1fm', s / 60) WHEN s IS NOT NULL THEN printf('%.1fh', s / 3600) END AS eta FROM s""")
def throughput(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), F.struct("ts", "event_id").alias("o"))
    rate = numeric.throughput(rows, "user_id", "o", "ts", "event_id", 1_000_000)
    return rate.select("event_id", F.round("tokens_per_s", 6).alias("tokens_per_s"), numeric.eta_text(F.col("hours_left") * 3600).alias("eta"))


# --- end to end
@query("prepared_by_source", f"WITH RECURSIVE {_kept('WHERE ' + _passes())} SELECT source, count(*)::BIGINT AS documents, sum(n_chars)::BIGINT AS chars FROM documents JOIN kept USING (doc_id) GROUP BY source")
def prepared_by_source(spark, sf_dir):
    return prepared(_documents(spark, sf_dir)).groupBy("source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"))


# --- sources, curriculum, reports
_TEMPLATES = ["Chapter: sets and maps.", "Proof: by induction on n.", "def f(x):\n    return x", "Trace: think, call, answer.", "Prompt: add two numbers."]
_TEMPLATE_SQL = "[" + ", ".join("'" + t.replace("\n", "' || chr(10) || '") + "'" for t in _TEMPLATES) + "]"


@query("template_cycle", f"SELECT i AS ord, ({_TEMPLATE_SQL})[i % 5 + 1] AS text FROM range((SELECT count(*) FROM documents)) r(i)")
def template_cycle(spark, sf_dir):
    """As many generated rows as there are documents."""
    return tables.templated(spark, _TEMPLATES, _documents(spark, sf_dir).count())


@query("textbook_scan", f"SELECT doc_id FROM documents WHERE {_passes(128)}")
def textbook_scan(spark, sf_dir):
    return tables.textbooks(_documents(spark, sf_dir)).select("doc_id")


@query("bounded_textbooks", f"""WITH w AS (SELECT d.doc_id, d.text, d.lang, coalesce(l.quality * 4.5, 0) AS score FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT * FROM (SELECT 0 AS part, doc_id AS ord, text FROM w WHERE lang = 'en' AND {_passes(128)} ORDER BY doc_id LIMIT 48)
  UNION ALL SELECT * FROM (SELECT 1, doc_id, text FROM w WHERE lang <> 'en' AND (score >= 4.0 OR {_EDU} >= 4.0) AND {_passes(128)} ORDER BY doc_id LIMIT 32)""")
def bounded_textbooks(spark, sf_dir):
    scored = _documents(spark, sf_dir).join(tables.table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("ord"), "text", "lang", (F.col("quality") * 4.5).alias("score"))
    return tables.bounded_textbooks(scored.where("lang = 'en'"), scored.where("lang <> 'en'"), 80)


@query("cycled_source", "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS n FROM documents) SELECT i AS place, doc_id FROM range(2500) r(i) JOIN d ON d.k = i % n")
def cycled_source(spark, sf_dir):
    return tables.cycled(_documents(spark, sf_dir).select("doc_id"), 2500, "doc_id").select("place", "doc_id")


@query("highlighted_tags", "SELECT conv_id, turn, replace(replace(replace('<|thought start|>' || text || '<|thought end|>' || role, '<|thought start|>', '[think] '), '<|thought end|>', ' [/think]'), chr(65533), '') AS shown FROM conversations")
def highlighted_tags(spark, sf_dir):
    text = F.concat(F.lit("<|thought start|>"), "text", F.lit("<|thought end|>"), "role")
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", formatters.highlighted(text, {"<|thought start|>": "[think] ", "<|thought end|>": " [/think]"}).alias("shown"))


@query("special_ids", """SELECT conv_id, turn, id AS token_id, max(token) AS token FROM (SELECT conv_id, turn, token, CASE WHEN role = token THEN 10 + turn ELSE base END AS id FROM conversations, (VALUES ('system', 0::BIGINT), ('user', 1), ('assistant', 2), ('tool', 2)) t(token, base)) GROUP BY conv_id, turn, id""")
def special_ids(spark, sf_dir):
    """Each turn's ids of the roles: its own setting over the defaults, inverted; of roles with one id the last by name counts."""
    pairs = lambda *kv: F.create_map(*[x if isinstance(x, Column) else F.lit(x) for x in kv])
    under = F.transform_values(pairs("system", 0, "user", 1, "assistant", 2, "tool", 2), lambda k, v: v.cast("long"))
    ids = maps.inverted(maps.merged(under, pairs(F.col("role"), F.col("turn") + 10)))
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(ids).alias("token_id", "token"))


@query("tool_chat_scan", "SELECT conv_id, turn FROM conversations WHERE turn % 3 = 0")
def tool_chat_scan(spark, sf_dir):
    tail = F.when(F.col("turn") % 3 == 0, "<functioncall> {} FUNCTION RESPONSE: {}").otherwise("<functioncall>")
    return tables.tool_chats(tables.table(spark, sf_dir, "conversations").withColumn("chat", F.concat("text", tail))).select("conv_id", "turn")


@query("curriculum_mix", f"""WITH s AS (SELECT 0 AS part, doc_id AS ord, row_number() OVER (ORDER BY doc_id) AS r, 60 AS n, text FROM documents WHERE lang = 'en'
  UNION ALL SELECT 1, doc_id, row_number() OVER (ORDER BY doc_id), 40, text FROM documents WHERE lang = 'fr'
  UNION ALL SELECT 2, doc_id, row_number() OVER (ORDER BY doc_id), 41, text FROM documents WHERE lang = 'de'
  UNION ALL SELECT 3, doc_id, row_number() OVER (ORDER BY doc_id), 27, text FROM documents WHERE lang = 'es'),
  k AS (SELECT part, ord, text FROM s WHERE r <= n), g AS (SELECT 6 AS part, i AS ord, ({_TEMPLATE_SQL})[i % 5 + 1] AS text FROM range(200) r(i) WHERE i < 200 - (SELECT count(*) FROM k))
  SELECT part::INT AS part, ord::BIGINT AS ord, text FROM k UNION ALL SELECT part::INT, ord::BIGINT, text FROM g""")
def curriculum_mix(spark, sf_dir):
    of = lambda lang: _documents(spark, sf_dir).where(F.col("lang") == lang).select(F.col("doc_id").alias("ord"), "text")
    sources = {"cosmo": of("en"), "fineweb": of("fr"), "python": of("de"), "math": of("es")}
    return mixing.curriculum(sources, 200, tables.templated(spark, _TEMPLATES, 200))


@query("prompt_mix", f"""WITH d AS (SELECT doc_id AS ord, {_strip("text")} AS t FROM documents)
  SELECT * FROM (SELECT 'math' AS kind, ord, 'User: Solve the following math problem step-by-step:' || chr(10) || t || chr(10) AS prompt FROM d WHERE t <> '' ORDER BY ord LIMIT 16)
  UNION ALL SELECT * FROM (SELECT 'code', ord, 'User: Write a python solution for: ' || t || chr(10) FROM d WHERE t <> '' ORDER BY ord LIMIT 16)
  UNION ALL SELECT * FROM (SELECT 'tool', ord, 'User: ' || t || chr(10) FROM d ORDER BY ord LIMIT 18)""")
def prompt_mix(spark, sf_dir):
    start = _documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), F.col("text").alias("t"))
    chats = start.select("ord", F.concat(F.lit("USER: "), "t", F.lit(" ASSISTANT: ok")).alias("chat"))
    return mixing.prompts(start.withColumnRenamed("t", "problem"), start.withColumnRenamed("t", "instruction"), chats, 50)


@query("prompt_assignment", "WITH p AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS k, count(*) OVER () AS n FROM conversations WHERE role = 'user'), e AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT i + 1 AS step, text AS prompt FROM e JOIN p ON p.k = i % n")
def prompt_assignment(spark, sf_dir):
    """One step for each event; the prompts, all user turns, go round."""
    prompts = tables.table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), "text")
    steps = tables.cycled(prompts, tables.table(spark, sf_dir, "events").count(), "ord")
    return steps.select((F.col("place") + 1).alias("step"), F.col("text").alias("prompt"))


@query("newest_files", "SELECT event_type || '/' || lpad(event_id::VARCHAR, 12, '0') || '.json' AS path, user_id % 3 AS priority FROM events ORDER BY priority, path DESC LIMIT 10")
def newest_files(spark, sf_dir):
    """Events as a listing of log files, three priorities among them."""
    path = F.concat("event_type", F.lit("/"), F.lpad(F.col("event_id").cast("string"), 12, "0"), F.lit(".json"))
    return numeric.newest(tables.table(spark, sf_dir, "events").select(path.alias("path"), (F.col("user_id") % 3).alias("priority")), 10)


@query("tool_state", "SELECT conv_id, turn, coalesce(last_value(s IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn), 0)::INT AS inside FROM (SELECT conv_id, turn, CASE WHEN role = 'assistant' THEN 0 WHEN turn % 2 = 0 THEN 1 END AS s FROM conversations)")
def tool_state(spark, sf_dir):
    tag = F.when(F.col("role") == "assistant", "<|tool response|>").when(F.col("turn") % 2 == 0, "<|call tool|>").otherwise("")
    state = formatters.inside_after(F.concat("text", tag), "<|call tool|>", "<|tool response|>")
    w = Window.partitionBy("conv_id").orderBy("turn")
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.last(state, ignorenulls=True).over(w), F.lit(0)).alias("inside"))


@query("micro_batches", "SELECT i AS seq_id, i // 8 AS micro_batch, i // 128 AS step FROM range((SELECT ceil(sum(strlen(text)) / 512.0)::BIGINT FROM documents)) r(i)")
def micro_batches(spark, sf_dir):
    """The sequences that all documents' bytes fill, with their micro-batches and steps."""
    docs = _documents(spark, sf_dir).select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return packing.micro_batches(packing.chunks(docs, "doc_id", "n", 512).select("seq_id").distinct(), 8, 16)


@query("parameter_totals", "SELECT p_brand AS module, sum(p_size * 512)::BIGINT AS parameters FROM part GROUP BY p_brand")
def parameter_totals(spark, sf_dir):
    shapes = tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("module"), F.array(F.col("p_size"), F.lit(512)).alias("shape"))
    size = F.aggregate("shape", F.lit(1).cast("long"), lambda a, x: a * x)
    return shapes.groupBy("module").agg(F.sum(size).alias("parameters"))


@query("parameter_report", """WITH t AS (SELECT sum(p_size * 512)::BIGINT AS t, sum(CASE WHEN p_size <= 25 THEN p_size * 512 ELSE p_size * 128 END)::BIGINT AS a FROM part)
  SELECT t AS total_parameters, a AS active_parameters, round(t / 1e6, 2) AS "total_parameters_M", round(a / 1e6, 2) AS "active_parameters_M", round((1.0 - a / t) * 100, 2) AS active_reduction_percent FROM t""")
def parameter_report(spark, sf_dir):
    rows = tables.table(spark, sf_dir, "part").select((F.col("p_size") * 512).alias("size"), F.when(F.col("p_size") <= 25, 1.0).otherwise(0.25).alias("share"))
    return numeric.parameter_report(rows, "size", "share")


@query("state_footprint", """SELECT doc_id, round(6 * 24 * n_chars * 2 / 1048576.0, 3)::DOUBLE AS "kv_cache_MB", round(12 * 512 * 16 * 2 / 1048576.0, 4)::DOUBLE AS "state_MB", round((6 * 24 * n_chars + 12 * 512 * 16) * 2 / 1048576.0, 3)::DOUBLE AS "total_MB" FROM documents""")
def state_footprint(spark, sf_dir):
    """What decoding keeps behind each document's characters."""
    return _documents(spark, sf_dir).select("doc_id", *[c.alias(n) for n, c in numeric.state_footprint(F.lit(6), F.lit(24), F.lit(12), F.lit(512), F.lit(16), F.col("n_chars")).items()])


@query("progress", "SELECT event_id, round(event_id / greatest(value, 1e-6), 6) AS tokens_per_s, least(100.0, 100.0 * event_id / 5000)::DOUBLE AS percent, round(event_id * 2 / 1e6, 6) AS mb FROM events")
def progress(spark, sf_dir):
    from millrace.plans.compile import progress as report

    rows = tables.table(spark, sf_dir, "events").select("event_id", F.col("event_id").alias("tokens"), F.col("value").alias("seconds"))
    return report(rows, 5000).select("event_id", F.round("tokens_per_s", 6).alias("tokens_per_s"), "percent", F.round("mb", 6).alias("mb"))


@query("code_pairs")
def code_pairs(spark, sf_dir):
    """Each text as a JSON string, which Python reads as the same string; code_of cuts code as the reference does."""
    listed = F.to_json(F.array("text"))
    literal = F.when(F.col("text").isNotNull(), listed.substr(F.lit(2), F.length(listed) - 2))
    code = F.concat(F.lit("def f_"), F.col("doc_id").cast("string"), F.lit("(x):\n    return "), literal, F.lit("\n"))
    return _documents(spark, sf_dir).select("doc_id", formatters.code_pair(formatters.code_of(F.lit(None).cast("string"), code)).alias("pair"))


@query("code_nodes", """WITH d AS (SELECT doc_id, lang, n_chars % 7 AS k FROM documents WHERE text IS NOT NULL), t AS (
    SELECT lang, unnest(['Module', 'FunctionDef', 'arguments', 'arg', 'Return', 'Constant', 'Assign', 'Name', 'Store']) AS type, unnest([1, 1, 1, 1, 1, 1 + k, k, k, k]) AS n, unnest([1, 1, 1, 1, 1, 1, k > 0, k > 0, k > 0]) AS any_ FROM d WHERE doc_id % 10 <> 3
    UNION ALL SELECT lang, 'SyntaxError', 1, 1 FROM d WHERE doc_id % 10 = 3)
  SELECT lang, type, sum(n)::BIGINT AS nodes FROM t GROUP BY lang, type HAVING sum(n) > 0""")
def code_nodes(spark, sf_dir):
    """Nodes by type of code made of each document: a function that returns its text, and as many assignments as its length says; every tenth does not parse."""
    listed = F.to_json(F.array("text"))
    literal = listed.substr(F.lit(2), F.length(listed) - 2)
    lines = F.concat_ws("", F.array_repeat(F.lit("x = 1\n"), (F.col("n_chars") % 7).cast("int")))
    code = F.when(F.col("doc_id") % 10 == 3, F.concat(F.lit("def ("), literal)).otherwise(F.concat(F.lit("def f(x):\n    return "), literal, F.lit("\n"), lines))
    rows = _documents(spark, sf_dir).select("lang", code.alias("code"))
    nodes = rows.lateralJoin(formatters.SyntaxTree(F.col("code").outer()))
    return nodes.groupBy("lang", "type").agg(F.count("*").alias("nodes"))


_LENGTH = 1024


@query("compile_report", f"""WITH RECURSIVE {_kept('WHERE ' + _passes())}, n AS (SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM documents WHERE {_passes()}) AS passed, (SELECT count(*) FROM kept) AS kept,
    (SELECT ceil(sum(strlen(text) + 1) / {_LENGTH}.0) FROM documents JOIN kept USING (doc_id)) AS sequences)
  SELECT unnest(['documents', 'filtered', 'duplicates', 'kept', 'sequences', 'tokens', 'bytes', 'sequences_in_file']) AS measure,
    unnest([documents, documents - passed, passed - kept, kept, sequences, sequences * {_LENGTH}, sequences * {2 * _LENGTH}, sequences])::BIGINT AS n FROM n""")
def compile_report(spark, sf_dir):
    """Filter, greedy de-duplication, encoding by single bytes (which SQL can count), packing, a token file, and what it gives back."""
    from millrace.plans.compile import write_corpus

    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    by_byte = tok.Tokenizer(tok.build_ranks((), 256 + len(tok.SPECIAL)), name="bytes")
    report = write_corpus(_documents(spark, sf_dir), by_byte, path, _LENGTH)
    files.delete(spark, path)
    return spark.createDataFrame(list(report.items()), "measure string, n long")


@query("token_file_round_trip", f"""WITH x AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS doc, string_split(text, '') AS c FROM conversations),
  t AS (SELECT doc, unnest(list_append(list_transform(c, lambda y: unicode(y) % 65536), 2)) AS id, unnest(range(len(c) + 1)) AS k FROM x), g AS (SELECT id, row_number() OVER (ORDER BY doc, k) - 1 AS i FROM t)
  SELECT (i // 128)::BIGINT AS seq_id, sum(id)::BIGINT AS total, true AS same FROM g GROUP BY 1""")
def token_file_round_trip(spark, sf_dir):
    """Writes packed texts as a token file in the shared folder in two steps, the second behind the first, reads it back and takes it away."""
    from millrace.sources import tokenfile

    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    ids = F.transform(_code_points(F.col("text")), lambda x: x % 65536)
    rows = tables.table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.concat(ids, F.array(F.lit(2))).alias("ids"))
    was = checkpointed(packing.pack(rows, "ord", "ids", 128).select("seq_id", "input_ids"))
    (half,) = was.agg(F.floor(F.avg("seq_id"))).first()
    for part, mode in ((was.where(F.col("seq_id") <= half), "overwrite"), (was.where(F.col("seq_id") > half), "append")):
        tokenfile.write_tokens(part, path, mode)
    back = spark.read.format("tokenfile").option("length", 128).load(path)
    both = back.join(was.withColumnRenamed("input_ids", "was"), "seq_id")
    out = checkpointed(both.select("seq_id", F.aggregate("input_ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), (F.col("input_ids") == F.col("was")).alias("same")))
    files.delete(spark, path)
    return out


@query("prompt_file", f"SELECT (row_number() OVER (ORDER BY doc_id) - 1)::INT AS ord, 'User: ' || {_strip('text')} || chr(10) AS prompt FROM documents ORDER BY doc_id LIMIT 50")
def prompt_file(spark, sf_dir):
    """The first 50 prompts as a JSON file, read back."""
    path = f"{shared_folder(spark)}/prompts-{uuid.uuid4().hex}.json"
    rows = _documents(spark, sf_dir).select("doc_id", F.concat(F.lit("User: "), strip(F.col("text")), F.lit("\n")).alias("prompt"))
    tables.write_prompts(rows, path, 50, order="doc_id")
    out = checkpointed(tables.prompt_file(spark, path))
    files.delete(spark, path)
    return out


@query("agent_interaction", """SELECT conv_id, turn, '<|bos|>User: ' || text || chr(10) || '<|thought start|>think<|thought end|><|call tool|>' || chr(10) || '{' || chr(10) || '  "tool": "echo",' || chr(10) || '  "parameters": {' || chr(10) || '    "turn": ' || turn || chr(10) || '  }' || chr(10) || '}' || chr(10)
  || '<|tool response|>' || chr(10) || '{' || chr(10) || '  "role": "' || role || '"' || chr(10) || '}' || chr(10) || CASE WHEN turn % 2 = 0 THEN '<|reflect|>' || role ELSE '' END || CASE WHEN turn % 3 > 0 THEN chr(10) || 'Final Response: ' || text || '<|eos|>' ELSE '' END AS formatted FROM conversations""")
def agent_interaction(spark, sf_dir):
    args, result = F.concat(F.lit('{"turn": '), F.col("turn").cast("string"), F.lit("}")), F.concat(F.lit('{"role": "'), F.col("role"), F.lit('"}'))
    reflection, answer = F.when(F.col("turn") % 2 == 0, F.col("role")), F.when(F.col("turn") % 3 > 0, F.col("text")).otherwise("")
    return tables.table(spark, sf_dir, "conversations").select("conv_id", "turn", formatters.interaction(F.col("text"), F.lit("think"), F.lit("echo"), args, result, reflection, answer).alias("formatted"))


_GENERATED = {"chapters": templates.CHAPTERS, "code": templates.CODE, "proofs": templates.PROOFS, "traces": templates.TRACES}


@query("generated_curriculum", f"""WITH t AS (SELECT n, greatest(1, floor(n * 0.5)::BIGINT) AS one, greatest(1, floor(n * 0.34)::BIGINT) AS two FROM (SELECT count(*) AS n FROM documents)),
  q AS (SELECT one, floor(two * 0.6)::BIGINT AS code, two - floor(two * 0.6)::BIGINT AS proofs, greatest(1, n - one - two) AS traces FROM t),
  p AS (SELECT unnest([0, 1, 2, 3]) AS part, unnest([one, code, proofs, traces]) AS n, unnest([{len(templates.CHAPTERS)}, {len(templates.CODE)}, {len(templates.PROOFS)}, {len(templates.TRACES)}]) AS k FROM q),
  r AS (SELECT part, k, unnest(range(n)) AS ord FROM p)
  SELECT row_number() OVER (ORDER BY md5('42|' || part || '-' || ord), part || '-' || ord)::BIGINT AS place, part::INT AS part, ord::BIGINT AS ord, (ord % k)::INT AS template FROM r""")
def generated_curriculum(spark, sf_dir):
    """As many generated documents as there are given ones, by quotas in seeded order, each known by its template again."""
    n = _documents(spark, sf_dir).count()
    out = mixing.generated_curriculum({name: make(spark, n) for name, make in templates.GENERATORS.items()}, n)
    first = None
    for part, (name, rows) in enumerate(_GENERATED.items()):
        own = templates.GENERATORS[name](spark, len(rows)).select(F.lit(part).alias("part"), F.col("ord").cast("int").alias("template"), "text")
        first = own if first is None else first.unionByName(own)
    return out.join(F.broadcast(first), ["part", "text"]).select("place", "part", "ord", "template")


@query("draft_accept", """WITH x AS (SELECT vec_id, i, abs(embedding[i]::DOUBLE) AS d, abs(embedding[i + 1]::DOUBLE) AS t, ('0x' || substr(md5('42|accept|' || vec_id || '|' || i), 1, 8))::BIGINT / 4294967296.0 AS u FROM embeddings, range(1, 64) r(i))
  SELECT vec_id, coalesce(min(i) FILTER (WHERE NOT (d <= t OR u < t / greatest(d, 1e-8))) - 1, 63)::BIGINT AS accepted FROM x GROUP BY vec_id""")
def draft_accept(spark, sf_dir):
    p = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    draws = F.transform(F.sequence(F.lit(1), F.lit(63)), lambda i: uniform(42, F.lit("accept"), F.col("vec_id"), i))
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", numeric.accepted_drafts(F.slice(p, 1, 63), F.slice(p, 2, 63), draws).alias("accepted"))


@query("recurrence_by_state", ORACLES["recurrence"])
def recurrence_by_state(spark, sf_dir):
    """The recurrence over a stream of the events, whose state is one number a user."""
    from millrace.streaming.compile import recurrence_stream

    out = f"{shared_folder(spark)}/recurrence-{uuid.uuid4().hex}"
    table = tables.table(spark, sf_dir, "events")
    # a pattern, since a stream's path is else taken for a folder
    events = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/event[s].parquet").withColumn("a", F.cos("event_id"))
    h = recurrence_stream(events, "user_id", "event_id", "a", "value").withColumn("h", F.round("h", 5))
    h.writeStream.format("parquet").option("path", f"{out}/h").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    rows = checkpointed(spark.read.parquet(f"{out}/h").select("user_id", "event_id", "h"))
    files.delete(spark, out)
    return rows


_UNIFORM = "('0x' || substr(md5('42|{0}|' || {1}), 1, 8))::BIGINT / 4294967296.0"


@query("policy_loss", f"""WITH x AS (SELECT event_id, event_id // 64 AS g, event_id // 8 AS s, sum(value) OVER (PARTITION BY event_id // 8) AS reward, -{_UNIFORM.format('new', 'event_id')} AS n, -{_UNIFORM.format('old', 'event_id')} AS o, -{_UNIFORM.format('ref', 'event_id')} AS f FROM events),
  a AS (SELECT *, (reward - avg(reward) OVER (PARTITION BY g)) / (stddev_pop(reward) OVER (PARTITION BY g) + 1e-8) AS a, exp(n - o) AS r FROM x),
  t AS (SELECT g, s, -least(r * a, least(greatest(r, 0.8), 1.2) * a) AS p, exp(f) * (f - n) AS kl, (r < 0.8 AND a < 0)::BIGINT AS low, (r > 1.2 AND a > 0)::BIGINT AS high FROM a),
  m AS (SELECT g, s, avg(p) AS p, avg(kl) AS kl, sum(low) AS low, sum(high) AS high, count(*) AS n FROM t GROUP BY g, s)
  SELECT g::BIGINT AS g, round(sum(p) / 8 + 0.04 * sum(kl) / 8, 6) AS loss, round(sum(p) / 8, 6) AS policy, round(sum(kl) / 8, 6) AS kl, sum(low)::BIGINT AS clipped_low, sum(high)::BIGINT AS clipped_high, sum(n)::BIGINT AS tokens, count(*)::BIGINT AS samples FROM m GROUP BY g""")
def policy_loss(spark, sf_dir):
    """Events as tokens, eight to a sample and eight samples to a group; a sample's reward is the sum of its values."""
    rows = tables.table(spark, sf_dir, "events").select("event_id", F.floor(F.col("event_id") / 64).alias("g"), F.floor(F.col("event_id") / 8).alias("s"), "value")
    rows = rows.withColumn("reward", F.sum("value").over(rewards.in_order("s", "event_id")))
    draws = {c: -uniform(42, F.lit(c), F.col("event_id")) for c in ("new", "old", "ref")}
    tokens = rows.withColumns(draws).withColumn("adv", rewards.advantage("reward", "g", order="event_id"))
    out = rewards.policy_loss(tokens, "g", "s", "new", "old", "adv", "ref", group_size=8)
    return out.withColumns({c: F.round(c, 6) for c in ("loss", "policy", "kl")})


def _soft(x: str) -> str:
    return f"list_transform({x}, lambda x: exp(x) / list_sum(list_transform({x}, lambda y: exp(y))))"


@query("draft_correction", f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
  k AS (SELECT vec_id, i, e[12 * i + 1 : 12 * i + 12] AS t, e[12 * i + 7 : 12 * i + 18] AS d FROM v, range(4) r(i)),
  p AS (SELECT vec_id, i, {_soft('t')} AS t, CASE WHEN vec_id % 7 = 0 THEN list_transform({_soft('t')}, lambda z: 2 * z) ELSE {_soft('d')} END AS d, floor({_UNIFORM.format('token', "vec_id || '|' || i")} * 12)::INT AS tok, {_UNIFORM.format('accept', "vec_id || '|' || i")} AS u FROM k),
  a AS (SELECT vec_id, coalesce(min(i) FILTER (WHERE NOT (d[tok + 1] <= t[tok + 1] OR u < t[tok + 1] / greatest(d[tok + 1], 1e-8))), 4) AS accepted FROM p GROUP BY vec_id),
  w AS (SELECT a.vec_id, a.accepted, p.t, CASE WHEN a.accepted = 4 THEN {_soft('v.e[49:60]')} ELSE list_transform(range(1, 13), lambda j: greatest(p.t[j] - p.d[j], 0.0)) END AS w, {_UNIFORM.format('pick', 'a.vec_id')} AS u FROM a JOIN v ON v.vec_id = a.vec_id LEFT JOIN p ON p.vec_id = a.vec_id AND p.i = a.accepted),
  c AS (SELECT vec_id, accepted, t, w, list_sum(w) AS s, u * list_sum(w) AS l, list_transform(range(1, 13), lambda j: list_sum(w[1:j])) AS c FROM w)
  SELECT vec_id, accepted::BIGINT AS accepted, CASE WHEN accepted = 4 THEN 'bonus' WHEN s > 0 THEN 'correction' ELSE 'argmax' END AS how,
    (CASE WHEN s > 0 THEN coalesce(list_min(list_filter(range(1, 13), lambda j: w[j] > 0 AND c[j] > l)), list_max(list_filter(range(1, 13), lambda j: w[j] > 0))) ELSE list_position(t, list_max(t)) END - 1)::INT AS next_token FROM c""")
def draft_correction(spark, sf_dir):
    """Four proposed tokens of twelve for each vector; every seventh draft claims twice the target's probabilities, so it has nowhere less."""
    from millrace.functions import vectors

    e = F.col("embedding")
    place = F.sequence(F.lit(0), F.lit(3))
    part = lambda start: F.transform(place, lambda i: vectors.softmax(F.slice(e, i * 12 + start, 12)))
    draw = lambda name: F.transform(place, lambda i: uniform(42, F.lit(name), F.col("vec_id"), i))
    target = part(1)
    rows = tables.table(spark, sf_dir, "embeddings").select(
        "vec_id", target.alias("target"), F.when(F.col("vec_id") % 7 == 0, F.transform(target, lambda p: F.transform(p, lambda x: 2 * x))).otherwise(part(7)).alias("draft"),
        F.transform(draw("token"), lambda u: F.floor(u * 12).cast("int")).alias("tokens"), draw("accept").alias("draws"), vectors.softmax(F.slice(e, 49, 12)).alias("bonus"), uniform(42, F.lit("pick"), F.col("vec_id")).alias("pick"),
    )
    return numeric.verified_drafts(rows).select("vec_id", "accepted", "how", "next_token")


@query("vector_functions", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), h AS (SELECT vec_id, e, e[1:32] AS a, e[33:64] AS b FROM v),
  n AS (SELECT *, sqrt(list_sum(list_transform(e, lambda x: x * x)) / 64 + 1e-5) AS r, list_sum(list_transform(range(1, 33), lambda i: a[i] * b[i])) / (greatest(sqrt(list_sum(list_transform(a, lambda x: x * x))), 1e-8) * greatest(sqrt(list_sum(list_transform(b, lambda x: x * x))), 1e-8)) AS c FROM h)
  SELECT vec_id, round(list_sum(list_transform(e, lambda x: 1 / (1 + exp(-x)))), 6) AS sigmoid, round(list_sum(list_transform(e, lambda x: x / (1 + exp(-x)))), 6) AS silu, round(list_sum(list_transform(e, lambda x: ln(1 + exp(x)))), 6) AS softplus,
    round(list_sum(list_transform(range(1, 33), lambda i: a[i] / (1 + exp(-a[i])) * b[i])), 6) AS gated, round(list_sum(list_transform(range(1, 65), lambda i: e[i] / r * i)), 6) AS rms_norm, round(c, 6) AS cosine, round(greatest(c, 0.0), 6) AS clamped,
    round(list_max(e) - ln(list_sum(list_transform(e, lambda x: exp(x)))), 6) AS log_softmax, round(exp(list_max(e)) / list_sum(list_transform(e, lambda x: exp(x))), 6) AS softmax FROM n""")
def vector_functions(spark, sf_dir):
    """The functions on all 64 values of each vector; gate and cosine take its halves."""
    from millrace.functions import vectors

    e = vectors.doubles(F.col("embedding"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    a, b = F.slice(e, 1, 32), F.slice(e, 33, 32)
    weights = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: i.cast("double"))
    out = {
        "sigmoid": total(F.transform(e, vectors.sigmoid)), "silu": total(F.transform(e, vectors.silu)), "softplus": total(F.transform(e, vectors.softplus)), "gated": total(vectors.gated(a, b)),
        "rms_norm": total(vectors.rms_norm(e, weights)), "cosine": vectors.cosine(a, b), "clamped": vectors.cosine(a, b, 0.0), "log_softmax": F.array_max(vectors.log_softmax(e)), "softmax": F.array_max(vectors.softmax(e)),
    }
    return tables.table(spark, sf_dir, "embeddings").select("vec_id", *[F.round(c, 6).alias(n) for n, c in out.items()])
