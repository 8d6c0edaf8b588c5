"""Schedules, anomaly windows, sampling filters, routing and loss statistics, retention, reports.

(W2, W3, W5-W7, A6, A7, A10, A11, T6-T11, J5-J7, K5, P11, P13, P14)
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import uniform
from millrace.functions.joins import fresh
from millrace.functions.prefix import MOST, stretched


def schedule(step: Column, total: int, warmup: float = 0.05, stable: float = 0.75, floor: float = 0.1, decay: str = "sqrt") -> Column:
    """Factor of the learning rate: linear warm-up, a plateau, then a decay to `floor`."""
    w = int(warmup * total)
    d = w + int(stable * total)
    t = F.least(F.lit(1.0), (step - d) / float(max(1, total - d)))
    shape = {"sqrt": 1 - F.sqrt(F.greatest(t, F.lit(0.0))), "cosine": 0.5 * (1 + F.cos(math.pi * t)), "linear": 1 - t}[decay]
    return F.when(step < w, (step + 1) / float(max(1, w))).when(step < d, 1.0).otherwise(floor + (1 - floor) * shape)


def anomalous(value: str, order: str, run: str, most: int = 50, least: int = 10, sigmas: float = 3.5, spread: float = 0.1) -> Column:
    """Whether a value is far above the values before it in its run. Values not finite are anomalous."""
    w = Window.partitionBy(run).orderBy(order).rowsBetween(-most, -1)
    high = F.col(value) > F.avg(value).over(w) + sigmas * F.greatest(F.stddev_pop(value).over(w), F.lit(spread))
    odd = F.isnan(value) | F.col(value).isin(float("inf"), float("-inf"))
    return odd | ((F.count(value).over(w) >= least) & F.coalesce(high, F.lit(False)))


def anomalous_with_rollback(rows: DataFrame, value: str, order: str, run: str, most: int = 50, least: int = 10, sigmas: float = 3.5, spread: float = 0.1) -> DataFrame:
    """(run, order, anomalous) where rejected values do not enter later windows; sequential by nature within a run."""

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        kept: deque = deque(maxlen=most)
        flags = []
        for x in pdf[value]:
            bad = x is None or not math.isfinite(x)
            if not bad and len(kept) >= least:
                mean = sum(kept) / len(kept)
                sd = math.sqrt(sum((y - mean) ** 2 for y in kept) / len(kept))
                bad = x > mean + sigmas * max(sd, spread)
            flags.append(bad)
            if not bad:
                kept.append(x)
        return pd.DataFrame({run: pdf[run], order: pdf[order], "anomalous": flags})

    types = dict(rows.dtypes)
    return rows.groupBy(run).applyInPandas(scan, f"{run} {types[run]}, {order} {types[order]}, anomalous boolean")


def exploded(vectors: DataFrame, key: str, vector: str, most: int | None = None) -> DataFrame:
    """(key, token_id, logit) of vectors, or of their first `most` entries."""
    v = F.col(vector) if most is None else F.slice(vector, 1, most)
    return vectors.select(key, F.posexplode(v).alias("token_id", "logit")).withColumn("logit", F.col("logit").cast("double"))


def softmax(logit: str, key: str, name: str = "p") -> dict[str, Column]:
    w = Window.partitionBy(key)
    top = F.max(logit).over(w)
    return {name: F.exp(F.col(logit) - top) / F.sum(F.exp(F.col(logit) - top)).over(w)}


def penalised(logits: DataFrame, generated: DataFrame, key: str, penalty: float) -> DataFrame:
    """Logits of tokens generated before divided by the penalty if positive, else multiplied."""
    seen = generated.select(key, "token_id").distinct().withColumn("_seen", F.lit(True))
    new = F.when(F.col("_seen") & (F.col("logit") > 0), F.col("logit") / penalty).when(F.col("_seen"), F.col("logit") * penalty).otherwise(F.col("logit"))
    return logits.join(seen, [key, "token_id"], "left").withColumn("logit", new).drop("_seen")


def suppressed(logits: DataFrame, masked: DataFrame) -> DataFrame:
    """Without the masked tokens."""
    return logits.join(F.broadcast(masked.select("token_id").distinct()), "token_id", "left_anti")


def sampling_filter(logits: DataFrame, key: str, temperature: float = 1.0, top_k: int = 0, top_p: float = 1.0, min_p: float = 0.0) -> DataFrame:
    """(key, token_id, logit, p): what temperature, top-k, nucleus and min-p leave, with probabilities."""
    out = logits.withColumn("logit", F.col("logit") / temperature)
    down = Window.partitionBy(key).orderBy(F.desc("logit"), "token_id")
    if top_k:
        out = out.withColumn("_r", F.rank().over(Window.partitionBy(key).orderBy(F.desc("logit")))).where(F.col("_r") <= top_k).drop("_r")
    if top_p < 1.0:
        out = out.withColumns(softmax("logit", key)).withColumn("_c", F.sum("p").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("p"))
        out = out.where(F.col("_c") <= top_p).drop("_c", "p")
    if min_p > 0.0:
        out = out.withColumns(softmax("logit", key)).withColumn("_m", F.max("p").over(Window.partitionBy(key)))
        out = out.where(F.col("p") >= F.col("_m") * min_p).drop("_m", "p")
    return out.withColumns(softmax("logit", key))


def argmax(logits: DataFrame, key: str) -> DataFrame:
    """The token of the largest logit; the smallest id of equal ones."""
    best = F.max_by(F.struct("token_id", "logit"), F.struct(F.col("logit"), -F.col("token_id")))
    return logits.groupBy(key).agg(best.alias("_b")).select(key, "_b.token_id", "_b.logit")


def drawn(filtered: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """One token for each key, by probability: the first whose cumulative share exceeds a hash-based draw."""
    down = Window.partitionBy(key).orderBy(F.desc("p"), "token_id")
    summed = filtered.withColumn("_c", F.sum("p").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    u = uniform(seed, F.lit("draw"), F.col(key))
    return summed.groupBy(key).agg(F.coalesce(F.min_by("token_id", F.when(F.col("_c") > u, F.col("_c"))), F.max_by("token_id", "_c")).alias("token_id"))


def routed(logits: DataFrame, key: str, k: int = 2) -> DataFrame:
    """The k largest logits of each key, their weights a softmax over those."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("logit"), "token_id"))
    top = logits.withColumn("_r", place).where(F.col("_r") <= k).drop("_r")
    return top.withColumns(softmax("logit", key, "weight"))


def load_balance(logits: DataFrame, key: str, k: int = 2) -> DataFrame:
    """(expert, dispatched, mean_p, part): experts * share of dispatches * mean probability; parts add up to the loss."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("logit"), "token_id"))
    rows = logits.withColumns(softmax("logit", key)).withColumn("_top", (place <= k).cast("int"))
    by = rows.groupBy(F.col("token_id").alias("expert")).agg((F.sum("_top") / (F.count("*") * k)).alias("dispatched"), F.avg("p").alias("mean_p"))
    experts = by.agg(F.count("*").alias("_n"))
    return by.crossJoin(F.broadcast(experts)).select("expert", "dispatched", "mean_p", (F.col("_n") * F.col("dispatched") * F.col("mean_p")).alias("part"))


def cross_entropy(logits: DataFrame, targets: DataFrame, key: str, ignore: int = -100) -> DataFrame:
    """(loss, perplexity, n): mean of log(sum(exp)) - logit of the target over keys whose target counts."""
    known = targets.where(F.col("target") != ignore)
    by = logits.join(known, key).groupBy(key).agg(F.max("logit").alias("m"), F.collect_list("logit").alias("l"), F.max(F.when(F.col("token_id") == F.col("target"), F.col("logit"))).alias("t"))
    nll = F.col("m") + F.log(F.aggregate("l", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("m")))) - F.col("t")
    return by.select(nll.alias("nll")).agg(F.avg("nll").alias("loss"), F.exp(F.least(F.avg("nll"), F.lit(20.0))).alias("perplexity"), F.count("*").alias("n"))


def causal_convolution(value: str, order: str, run: str, weights: tuple[float, ...] = (0.1, 0.2, 0.3, 0.4)) -> Column:
    """Weighted sum of a value and those before it in its run; nothing stands before the first."""
    w = Window.partitionBy(run).orderBy(order)
    out = F.lit(0.0)
    for back, weight in enumerate(reversed(weights)):
        out = out + weight * F.coalesce(F.lag(value, back).over(w) if back else F.col(value), F.lit(0.0))
    return out


STRETCH = 1 << 16  # rows of a run that one task takes at once
BLOCK = 256


def recurrence(rows: DataFrame, run: str, order: str, a: str, b: str, stretch: int = STRETCH) -> DataFrame:
    """(run, order, h) of h = a * h before + b, by an associative scan; before the first row of a run h is 0.

    A step maps h to a * h + b, and so does any number of steps one after another, with other a and b. Runs longer than
    `stretch` rows are cut at the quantiles of their orders. Each stretch is reduced to its two numbers, which are
    the rows of a shorter recurrence; it gives what each stretch starts from, and the stretches are then
    computed side by side. A null a or b leaves h as it is. Orders are unique in a run, and whole numbers or what casts to them.
    """
    steps = rows.select(F.col(run).alias("run"), F.col(order).alias("at"), F.coalesce(F.col(a).cast("double"), F.lit(1.0)).alias("a"), F.coalesce(F.col(b).cast("double"), F.lit(0.0)).alias("b"))
    long = steps.groupBy("run").agg(F.count("*").alias("n")).where(F.col("n") > stretch).select(F.struct("run").alias("name"))
    cut = not long.isEmpty()
    if cut:
        named = steps.withColumn("name", F.struct("run"))
        short = named.join(long, "name", "left_anti").withColumn("stretch", F.lit(0))
        steps = short.unionByName(stretched(named.join(long, "name", "left_semi"), "at", "stretch", stretch)[0]).drop("name")
    else:
        steps = steps.withColumn("stretch", F.lit(0))
    groups = steps.groupBy("run", "stretch").agg(F.sort_array(F.collect_list(F.struct("at", "a", "b"))).alias("x"))
    start = F.lit(0.0)
    if cut:
        both = F.aggregate("x", F.lit(1.0), lambda t, e: t * e["a"]).alias("a"), F.aggregate("x", F.lit(0.0), lambda t, e: e["a"] * t + e["b"]).alias("b")
        ends = recurrence(groups.select("run", "stretch", *both), "run", "stretch", "a", "b", max(stretch, 2 * MOST))
        before = F.lag("h", 1, 0.0).over(Window.partitionBy("run").orderBy("stretch"))
        starts = ends.select(F.struct("run", "stretch").alias("name"), before.alias("start"))
        groups = groups.withColumn("name", F.struct("run", "stretch")).join(starts, "name")
        start = F.col("start")
    # arrays of arrays, since each append copies the array
    last = lambda xs: F.get(xs, F.size(xs) - 1)
    nothing = F.array().cast("array<double>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("x") - 1) / BLOCK)), lambda k: F.slice("x", (k * BLOCK + 1).cast("int"), BLOCK))
    block = lambda done, xs: F.aggregate(xs, nothing, lambda hs, e: F.array_append(hs, e["a"] * F.coalesce(last(hs), last(last(done)), start) + e["b"]))
    hs = F.aggregate(blocks, F.array().cast("array<array<double>>"), lambda done, xs: F.array_append(done, block(done, xs)), F.flatten)
    each = groups.select("run", F.explode(F.arrays_zip(F.col("x.at").alias("at"), hs.alias("h"))).alias("e"))
    return each.select(F.col("run").alias(run), F.col("e.at").alias(order), F.col("e.h").alias("h"))


def retained(checkpoints: DataFrame, keep: int = 5) -> DataFrame:
    """The latest checkpoints, and the last healthy one wherever it stands."""
    latest = checkpoints.orderBy(F.desc("step")).limit(keep)
    healthy = checkpoints.where("healthy").orderBy(F.desc("step")).limit(1)
    return latest.unionByName(healthy).distinct()


def newest(listing: DataFrame, limit: int = 1) -> DataFrame:
    """Files by priority, then by name from the last."""
    return listing.orderBy("priority", F.desc("path")).limit(limit)


def cache_footprint(layers: Column, width: Column, length: Column, width_bytes: int = 2) -> Column:
    """MB of a key-value cache."""
    return F.round(layers * width * length * width_bytes / float(1 << 20), 3)


def throughput(metrics: DataFrame, run: str, order: str, at: str, tokens: str, total: int) -> DataFrame:
    """metrics with tokens by second since the row before, and the hours left at that rate."""
    w = Window.partitionBy(run).orderBy(order)
    seconds = (F.col(at).cast("double") - F.lag(F.col(at).cast("double")).over(w))
    rate = (F.col(tokens) - F.lag(tokens).over(w)) / F.when(seconds > 0, seconds)
    return metrics.withColumn("tokens_per_s", rate).withColumn("hours_left", F.greatest(F.lit(0.0), total - F.col(tokens)) / F.when(F.col("tokens_per_s") > 0, F.col("tokens_per_s")) / 3600)


def parameter_report(parameters: DataFrame, size: str, active: str) -> DataFrame:
    """One row: total and active parameters, in millions too, and by how many percent fewer are active. `active` is the share of each row's `size` that is."""
    total, part = F.sum(size), F.sum(F.col(size) * F.col(active))
    out = parameters.agg(total.cast("long").alias("total_parameters"), part.cast("long").alias("active_parameters"))
    millions = lambda c: F.round(F.col(c) / 1e6, 2)
    less = F.round((1.0 - F.col("active_parameters") / F.col("total_parameters")) * 100, 2)
    return out.withColumns({"total_parameters_M": millions("total_parameters"), "active_parameters_M": millions("active_parameters"), "active_reduction_percent": less})


def state_footprint(kv_layers: Column, kv_width: Column, layers: Column, inner: Column, state: Column, length: Column, width_bytes: int = 2) -> dict[str, Column]:
    """MB of what decoding keeps: a cache that grows with the length, and recurrent state that does not."""
    kv, own = (x * width_bytes / float(1 << 20) for x in (kv_layers * kv_width * length, layers * inner * state))
    return {"kv_cache_MB": F.round(kv, 3), "state_MB": F.round(own, 4), "total_MB": F.round(kv + own, 3)}


def eta_text(seconds: Column) -> Column:
    """'12.5m' below an hour, '1.5h' from there on."""
    return F.when(seconds < 3600, F.format_string("%.1fm", seconds / 60)).when(seconds.isNotNull(), F.format_string("%.1fh", seconds / 3600))


def accepted_drafts(draft_p: Column, target_p: Column, draws: Column) -> Column:
    """How many draft tokens are taken, in order, until the first whose draw is not below target over draft probability."""
    ok = F.transform(F.arrays_zip(draft_p.alias("d"), target_p.alias("t"), draws.alias("u")), lambda x: (x["d"] <= x["t"]) | (x["u"] < x["t"] / F.greatest(x["d"], F.lit(1e-8))))
    stop = F.array_position(ok, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(ok)).cast("long")


def verified_drafts(drafts: DataFrame, target: str = "target", draft: str = "draft", tokens: str = "tokens", bonus: str = "bonus", draws: str = "draws", pick: str = "pick") -> DataFrame:
    """drafts with `accepted`, `next_token` and `how`: what a target model makes of the tokens that a draft model proposed.

    `target` and `draft` are arrays of probability vectors, one for each proposed token of `tokens` (ids from 0), `draws` are numbers in
    [0, 1) for the acceptances, `pick` is one for the next token. Tokens are accepted in order until the first whose draw
    is not below target over draft probability. For that one a correction is drawn from what the target has more
    than the draft, or is the target's largest (the first of equal ones) where it has nowhere more; if all
    pass, a token more is drawn from `bonus`, the target's probabilities behind them. `how` is 'correction', 'argmax' or 'bonus'.
    """
    at = lambda vectors, k: F.get(F.get(F.col(vectors), k), F.get(F.col(tokens), k))
    place = F.when(F.size(tokens) > 0, F.sequence(F.lit(0), F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    of = lambda vectors: F.transform(place, lambda k: at(vectors, k))
    names = [fresh(drafts.columns, x) for x in ("place", "more", "sum")]
    k, more, total = map(F.col, names)
    out = drafts.withColumn("accepted", accepted_drafts(of(draft), of(target), F.col(draws)))
    out = out.withColumn(names[0], F.col("accepted").cast("int"))
    surplus = F.zip_with(F.get(target, k), F.get(draft, k), lambda t, d: F.greatest(t - d, F.lit(0.0)))
    out = out.withColumn(names[1], F.when(k < F.size(tokens), surplus).otherwise(F.col(bonus)))
    out = out.withColumn(names[2], F.aggregate(more, F.lit(0.0), lambda s, p: s + p))
    how = F.when(k >= F.size(tokens), "bonus").when(total > 0, "correction").otherwise("argmax")
    largest = F.array_position(F.get(target, k), F.array_max(F.get(target, k))) - 1
    chosen = F.when((k < F.size(tokens)) & (total <= 0), largest).otherwise(_first_above(more, F.col(pick) * total))
    return out.withColumns({"next_token": chosen.cast("int"), "how": how}).drop(*names)


def _first_above(weights: Column, limit: Column) -> Column:
    """The first place whose cumulative weight is above the limit; the last place with a weight if rounding leaves none."""
    walk = F.aggregate(
        weights, F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"), F.lit(-1).alias("found"), F.lit(-1).alias("last")),
        lambda s, w: F.struct(
            (s["sum"] + w).alias("sum"), (s["at"] + 1).alias("at"),
            F.when((s["found"] < 0) & (w > 0) & (s["sum"] + w > limit), s["at"]).otherwise(s["found"]).alias("found"),
            F.when(w > 0, s["at"]).otherwise(s["last"]).alias("last"),
        ),
        lambda s: F.when(s["found"] >= 0, s["found"]).otherwise(s["last"]),
    )
    return walk


def steps_per_epoch(tokens: Column, batch: int, accumulate: int, length: int) -> Column:
    return F.ceil(tokens / float(batch * accumulate * length))
