"""Mixing sources to quotas: phase quotas, first-n, interleaving, budgets, backfill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import rank_key
from millrace.functions.joins import fresh
from millrace.functions.prefix import ROWS, running_sum
from millrace.functions.text import captured, not_blank, strip

# Shares of the three phases, and slots by source in a round of 100.
SHARES = (0.50, 0.34, 0.16)
ROUND = {"cosmo": 30, "fineweb": 20, "python": 20, "math": 14, "glaive": 10, "cot": 6}
SYNTHETIC_ROUND = {"p1": 50, "p2_ast": 20, "p2_math": 14, "p3": 16}


def phase_quotas(total: int, shares: tuple[float, float, float] = SHARES) -> tuple[int, int, int]:
    one, two = max(1, int(total * shares[0])), max(1, int(total * shares[1]))
    return one, two, max(1, total - one - two)


def quota_columns(total: Column, shares: tuple[float, float, float] = SHARES) -> tuple[Column, Column, Column]:
    """phase_quotas of a column of whole numbers."""
    least = lambda c: F.greatest(F.lit(1).cast("long"), c.cast("long"))
    one, two = least(F.floor(total * shares[0])), least(F.floor(total * shares[1]))
    return one, two, least(total - one - two)


def split_quota(n: int, ratio: float) -> tuple[int, int]:
    """A quota split in two by a ratio, rounded half to even, the first part at least one."""
    first = max(1, round(n * ratio))
    return first, max(0, n - first)


def first_n(df: DataFrame, source: str, order: str, quota: Column | int) -> DataFrame:
    """The first rows of each source by order. quota may be a column that is constant by source."""
    place = fresh(df.columns, "place")
    numbered = df.withColumn(place, F.row_number().over(Window.partitionBy(source).orderBy(order)))
    return numbered.where(F.col(place) <= quota).drop(place)


def shuffled(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """Rows in an order that depends on seed and key only."""
    return df.orderBy(rank_key(seed, F.col(key)), key)


def placed(df: DataFrame, key: str, seed: int = 42, name: str = "place", rows: int = ROWS) -> DataFrame:
    """df with `name`, each row's number from 1 in the order of `shuffled`.

    The order is cut by the hash's first digits into stretches of about `rows` rows, and their counts are added up first;
    within a stretch a window does the rest.
    """
    rank, stretch, base, n = (fresh([*df.columns, name], x) for x in ("rank", "stretch", "base", "n"))
    digits, count = 1, df.count()
    while count > rows * 16**digits:
        digits += 1
    cut = df.withColumn(rank, rank_key(seed, F.col(key))).withColumn(stretch, F.substring(rank, 1, digits))
    counts = cut.groupBy(stretch).agg(F.count("*").alias(n))
    before = counts.select(stretch, (F.sum(n).over(Window.orderBy(stretch)) - F.col(n)).alias(base))
    inside = F.row_number().over(Window.partitionBy(stretch).orderBy(rank, key))
    return cut.join(F.broadcast(before), stretch).withColumn(name, (F.col(base) + inside).cast("long")).drop(rank, stretch, base)


def round_slots(df_spark, rounds: int, pattern: dict[str, int] = ROUND, seed: int = 42) -> DataFrame:
    """(slot, source, ordinal): each round has exactly the pattern's counts, in an order of its own."""
    names = [s for s, n in pattern.items() for _ in range(n)]
    size = len(names)
    table = df_spark.range(rounds * size).select((F.col("id") / size).cast("long").alias("round"), (F.col("id") % size).alias("at"))
    source = F.element_at(F.array(*map(F.lit, names)), (F.col("at") + 1).cast("int"))
    place = F.row_number().over(Window.partitionBy("round").orderBy(rank_key(seed, F.col("round"), F.col("at")), "at")) - 1
    slots = table.select("round", source.alias("source"), place.alias("place")).select((F.col("round") * size + F.col("place")).alias("slot"), "round", "source")
    # a source's ordinal: its slots in earlier rounds are known by count, so no window spans rounds
    count = F.create_map(*[x for s, n in pattern.items() for x in (F.lit(s), F.lit(n))])
    inside = F.row_number().over(Window.partitionBy("round", "source").orderBy("slot")) - 1
    return slots.select("slot", "source", (F.col("round") * F.element_at(count, F.col("source")) + inside).alias("ordinal"))


def interleave(slots: DataFrame, pool: DataFrame, order: str) -> DataFrame:
    """Fills slots from a pool with columns source and `order`, going round when a source runs out.

    Only the rows that the largest ordinal can reach are numbered, by source and order alone; the first of each
    source are found in every partition before any are dealt by source.
    """
    (most,) = slots.agg(F.max("ordinal")).first()
    at, size = (fresh([*slots.columns, *pool.columns], x) for x in ("at", "size"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(order))
    numbered = pool.select("source", order).withColumn(at, place).where(F.col(at) <= (0 if most is None else most + 1))
    numbered = numbered.withColumn(at, F.col(at) - 1)
    sizes = pool.groupBy("source").agg(F.count("*").alias(size))
    turn = (F.col("ordinal") % F.col(size)).cast("int")
    chosen = slots.join(F.broadcast(sizes), "source").withColumn(at, turn).join(numbered, ["source", at]).drop(at, size)
    return chosen.join(pool, ["source", order])


def within_budget(docs: DataFrame, order: str, tokens: str, length: int, target: int) -> DataFrame:
    """Documents taken until the tokens flushed in whole sequences of `length` reach the target."""
    before = fresh(docs.columns, "before")
    summed = running_sum(docs, order, tokens, before)
    return summed.where(F.floor(F.col(before) / length) * length < target).drop(before)


def backfilled(have: DataFrame, total: int, generated: DataFrame, order: str = "ord") -> DataFrame:
    """have, filled up to `total` rows with the first of `generated` by order.

    A limit without an order takes the rows that come first from several executors, others in each run.
    """
    missing = max(0, total - have.count())
    return have.unionByName(generated.orderBy(order).limit(missing)) if missing else have


def curriculum(sources: dict[str, DataFrame], total: int, generated: DataFrame, order: str = "ord") -> DataFrame:
    """Quotas by phase and source, first-n each, concatenated; filled up from `generated` and cut to `total`."""
    one, two, three = phase_quotas(total)
    quotas = dict(zip(("cosmo", "fineweb"), split_quota(one, 0.60), strict=True))
    quotas |= zip(("python", "math"), split_quota(two, 0.60), strict=True)
    quotas |= zip(("glaive", "cot"), split_quota(three, 0.60), strict=True)
    parts = [sources[s].orderBy(order).limit(n).select(F.lit(k).alias("part"), F.col(order).alias("ord"), "text") for k, (s, n) in enumerate(quotas.items()) if s in sources]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = backfilled(out, total, generated.select(F.lit(len(quotas)).alias("part"), F.col(order).alias("ord"), "text"))
    return out.orderBy("part", "ord").limit(total)


def generated_curriculum(generated: dict[str, DataFrame], total: int, shares: tuple[float, float, float] = SHARES, seed: int = 42) -> DataFrame:
    """(place, part, ord, text): chapters, code pairs, proofs and traces by phase quotas, in a seeded order.

    `generated` has a frame (ord, text) with at least `total` rows under each of those four names.
    """
    one, two, three = phase_quotas(total, shares)
    code = int(two * 0.60)
    out = None
    for part, (name, n) in enumerate((("chapters", one), ("code", code), ("proofs", two - code), ("traces", three))):
        rows = generated[name].where(F.col("ord") < n).select(F.lit(part).alias("part"), F.col("ord").cast("long").alias("ord"), "text")
        out = rows if out is None else out.unionByName(rows)
    keyed = out.withColumn("key", F.concat_ws("-", "part", "ord"))
    return placed(keyed, "key", seed).select("place", "part", "ord", "text")


def prompts(problems: DataFrame, instructions: DataFrame, chats: DataFrame, count: int, order: str = "ord") -> DataFrame:
    """Prompts by kind: a third each, the rest from chats; each kind's first non-blank ones."""
    n = count // 3
    plain = [
        ("math", problems, F.col("problem"), "User: Solve the following math problem step-by-step:\n", n),
        ("code", instructions, F.col("instruction"), "User: Write a python solution for: ", n),
        ("tool", chats, captured(F.col("chat"), r"(?s)USER:\s*(.*?)\s*ASSISTANT:"), "User: ", count - 2 * n),
    ]
    out = None
    for kind, df, text, lead, k in plain:
        rows = df.select(F.col(order).alias("ord"), strip(text).alias("t"))
        rows = rows.where(F.col("t").isNotNull() if kind == "tool" else not_blank(F.col("t"))).orderBy("ord").limit(k)
        rows = rows.select(F.lit(kind).alias("kind"), "ord", F.concat(F.lit(lead), F.col("t"), F.lit("\n")).alias("prompt"))
        out = rows if out is None else out.unionByName(rows)
    return out
