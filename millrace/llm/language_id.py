"""Language identification by word-first backoff.

A word that the model knows is scored by its log frequency in each language. A word that it does not
know falls back to character n-grams: at each of its places the longest known n-gram scores, from
LONGEST characters down to one. A document's scores are sums over all of its words; the prediction is
the language with the largest sum, `score` its share of the posterior.

The model learns from text and lang of rows outside the held-out fold only. It is fitted on a sample
of about FIT_DOCS of them, which bounds what is sent to the workers: languages share the sample evenly, a
language with fewer rows than its share gives all and leaves the rest to others, and rows are drawn by
a hash, spread over the whole table. Of more than MAX_LANGUAGES labels the most frequent are learned.
Both bounds are parameters. All words of the sample are in the model. Every row of the table is
predicted from its whole text.

Defined results: null text, or text without a letter, is `und` with score 0; so is every text if
nothing could be learned. Ties go to the first language by name. Rows are predicted one by one, so
repeated rows get the same result each. A null doc_id is not held out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import _kernel as K

FIT_DOCS = 6000
MAX_LANGUAGES = 1000
LONGEST = 4
KNOWN_WORDS = 300_000  # a worker's memory of scored words
UNKNOWN = "und"

_words = re.compile(r"[^\W\d_]+").findall


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _gram_keys(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams at each place of the padded words, and whether the n-gram fits there.

    A place is a character of the word or its closing mark; the n-gram ends there.
    """
    text = "".join([f"\n\n\n<{w}>" for w in words])
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(K.U64)
    pad = codes == 10
    key = np.zeros(len(codes), K.U64)
    ok = np.ones(len(codes), bool)
    for k in range(n):
        moved, gone = np.zeros_like(codes), np.ones_like(pad)
        moved[k:], gone[k:] = codes[: len(codes) - k], pad[: len(codes) - k]
        key = K.mix(key + moved * K.U64(0x9E3779B97F4A7C15) + K.U64(k))
        ok &= ~gone
    place = ~pad & (codes != ord("<"))
    return key[place], ok[place]


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    scores: np.ndarray  # by word
    gram_keys: list[np.ndarray]  # sorted, by length from 1
    gram_scores: list[np.ndarray]

    @classmethod
    def learn(cls, counts: dict[str, dict[str, int]]) -> Model:
        """counts: word counts by language."""
        languages = sorted(counts)
        words = {w: i for i, w in enumerate(sorted(set().union(*counts.values())))} if counts else {}
        table = np.zeros((len(words), len(languages)))
        for j, lang in enumerate(languages):
            for w, n in counts[lang].items():
                table[words[w], j] = n
        keys, scores = [], []
        order = list(words)
        lengths = np.array([len(w) + 1 for w in order], np.int64)
        for n in range(1, LONGEST + 1):
            key, ok = _gram_keys(order, n) if order else (np.empty(0, K.U64), np.empty(0, bool))
            owner = np.repeat(np.arange(len(order)), lengths)[ok] if order else np.empty(0, np.int64)
            unique, at = np.unique(key[ok], return_inverse=True)
            sums = np.zeros((len(unique), len(languages)))
            np.add.at(sums, at, table[owner])
            keys.append(unique)
            scores.append(cls._logs(sums))
        return cls(languages, words, cls._logs(table), keys, scores)

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        return np.log((counts + 0.5) / (counts.sum(0) + 0.5 * (len(counts) + 1)))

    def score(self, words: list[str]) -> np.ndarray:
        """Log scores by word and language."""
        out = np.zeros((len(words), len(self.languages)))
        at = np.fromiter((self.words.get(w, -1) for w in words), np.int64, len(words))
        known = at >= 0
        out[known] = self.scores[at[known]]
        rest = np.flatnonzero(~known)
        if len(rest):
            unseen = [words[i] for i in rest]
            lengths = np.array([len(w) + 1 for w in unseen], np.int64)
            got = np.zeros((int(lengths.sum()), len(self.languages)))
            open_ = np.ones(len(got), bool)
            for n in range(LONGEST, 0, -1):
                keys, values = self.gram_keys[n - 1], self.gram_scores[n - 1]
                if not len(keys):
                    continue
                key, ok = _gram_keys(unseen, n)
                near = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = open_ & ok & (keys[near] == key)
                got[hit] = values[near[hit]]
                open_ &= ~hit
            starts = np.cumsum(lengths) - lengths
            out[rest] = np.add.reduceat(got, starts, axis=0) / lengths[:, None]
        return out


def _word_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, Counter] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            counts.setdefault(lang, Counter()).update(_words(text.lower()))
    rows = [(lang, w, n) for lang, c in counts.items() for w, n in c.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())], names=["lang", "word", "n"])


def shares(sizes: dict[str, int], most: int) -> dict[str, float]:
    """Which share of each language's rows to draw for `most` rows in all, evenly by language."""
    out, left = {}, most
    for k, (lang, n) in enumerate(sorted(sizes.items(), key=lambda x: (x[1], x[0]))):
        take = min(n, left // (len(sizes) - k))
        out[lang] = take / n
        left -= take
    return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, most_languages: int = MAX_LANGUAGES) -> Model:
    """The model of the labelled rows of docs (columns doc_id, text, lang) outside the held-out fold."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect()}
    if not sizes:
        return Model.learn({})
    limits = [(lang, int(share * (1 << 30))) for lang, share in shares(sizes, fit_docs).items()]
    drawn = rows.join(F.broadcast(docs.sparkSession.createDataFrame(limits, "lang string, below long")), "lang")
    drawn = drawn.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(1 << 30)) < F.col("below")).select("text", "lang")
    words = drawn.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, word, n in zip(*(words.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
        counts.setdefault(lang, {})[word] = n
    return Model.learn(counts)


class _Known(dict):
    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        return at


def _predict(model: Model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores = _Known(), np.empty((0, len(model.languages)))
        for batch in K.sliced(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            lists = [_words(t.lower()) for t in texts]
            lists = [x if any(map(str.isalpha, x)) or any(map(str.isalpha, t)) else [] for x, t in zip(lists, texts, strict=True)]
            before = len(known)
            codes = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), np.int64)
            if len(known) > before and model.languages:
                new = list(known)[before:]
                scores = np.concatenate([scores, model.score(new)])
            lengths = np.fromiter(map(len, lists), np.int64, len(lists))
            lang, share = np.full(len(lists), UNKNOWN, object), np.zeros(len(lists))
            full = np.flatnonzero(lengths)
            if len(full) and model.languages:
                total = np.add.reduceat(scores[codes], (np.cumsum(lengths) - lengths)[full], axis=0)
                odds = np.exp(total - total.max(1, keepdims=True))
                best = total.argmax(1)
                lang[full] = np.array(model.languages, object)[best]
                share[full] = odds[np.arange(len(full)), best] / odds.sum(1)
            if len(known) > KNOWN_WORDS:
                known, scores = _Known(), np.empty((0, len(model.languages)))
            rest = [c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(share)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identified(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score."""
    model = model or fit(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_predict(model), "doc_id long, held_out boolean, lang_pred string, score double")
