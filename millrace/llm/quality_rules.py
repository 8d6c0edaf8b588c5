"""Quality rules: distribution divergence from language references, beside four counted rules.

A document's character-class histogram and its common-word histogram are compared with those of
each language by Jensen-Shannon distance (base 2, so from 0 to 1); the nearest language counts, so a
wrong or missing label does not matter. A language's common words are its COMMON most frequent ones, all
other words being one cell; words and references are counted over every document that has a language, in
one pass. A language needs MIN_DOCS documents and MIN_REFERENCE_WORDS words to be a reference, so that its shares
are more than chance. A document whose label is a language without a reference is not measured by the words
and scripts of others: its letters of every kind count as one class, and only with these classes is it compared.
So text of a rare language stays, and what is hardly text goes under any label.

Minimum-length guards: histograms of short texts scatter, so the class test asks for GUARD_CLASS
words and the word test for GUARD_WORDS; below a guard that test accepts. Above it the distance
allowed is what documents of one language differ by, plus the scatter of a sample: over n draws from c
cells, 8 n ln 2 times the squared distance is about chi-squared with c - 1 degrees of freedom, and its mean
and two standard deviations are allowed. Of characters, which depend on each other, four a word count.

The counted rules: word_chars, n_symbols, n_dup_lines, n_repeat_words, and base_failed from two of
them. A document is kept if neither the counted rules nor a divergence rejects it.

Defined results: null text counts as empty; fewer than MIN_WORDS words fail; with no language that may be
a reference the distances are 0 and only the counted rules decide; common words of equal count come in the
order of their bytes; rows are judged one by one, so repeated rows get the same result each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm import _kernel as K
from millrace.llm._rows import fresh

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
SYMBOLS = b"#*$%&|<>"
COMMON = 32
MIN_DOCS, MIN_REFERENCE_WORDS = 10, 1000
GUARD_CLASS = 40
GUARD_WORDS = 80
CLASS_DISTANCE, WORD_DISTANCE = 0.20, 0.08  # between documents of one language, whatever their length
CHARACTERS_A_WORD = 4
KNOWN_WORDS = 500_000  # of a task's counts before they are sent on

CLASSES = ("lower", "upper", "digit", "space", "symbol", "other", "beyond")
_CLASS = np.full(256, 5, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(K.SPACE)] = 3
_CLASS[list(SYMBOLS)] = 4
_CLASS[0xC0:] = 6
_CLASS[0x80:0xC0] = 7  # the rest of a character that its first byte has counted

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def scatter(cells: int) -> float:
    """Distance that sampling alone allows, times the root of the draws."""
    return math.sqrt((cells - 1 + 2 * math.sqrt(2 * (cells - 1))) / (8 * math.log(2)))


CLASS_SCATTER = scatter(len(CLASSES)) / math.sqrt(CHARACTERS_A_WORD)
WORD_SCATTER = scatter(COMMON + 1)


class Reference(NamedTuple):
    lang: str
    classes: np.ndarray  # shares by class
    words: tuple[bytes, ...]
    shares: np.ndarray  # by word, and of all others


def class_counts(texts: list[bytes]) -> np.ndarray:
    """Characters by class; a row for each text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    buf = np.frombuffer(b"".join(texts), np.uint8)
    return np.bincount(np.repeat(np.arange(len(texts)) * 8, sizes) + _CLASS[buf], minlength=8 * len(texts)).reshape(-1, 8)[:, :7]


def normal_words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts from the reference."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)

    def entropy(x: np.ndarray) -> np.ndarray:
        return -np.sum(np.where(x > 0, x * np.log2(np.where(x > 0, x, 1)), 0), axis=-1)

    return np.sqrt(np.maximum(entropy((p + reference) / 2) - (entropy(p) + entropy(reference)) / 2, 0))


def _plain(counts: np.ndarray) -> np.ndarray:
    """Counts by class with letters of every kind as one: small, capital and beyond ASCII."""
    return np.stack([counts[..., 0] + counts[..., 1] + counts[..., 6], *(counts[..., k] for k in range(2, 6))], axis=-1)


def nearest(texts: list[bytes], references: list[Reference]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distance from the nearest reference, by classes, by common words, and by classes with one for all letters; 0 without references."""
    if not references or not texts:
        return np.zeros(len(texts)), np.zeros(len(texts)), np.zeros(len(texts))
    counts = class_counts(texts)
    by_class = np.min([distance(counts, r.classes) for r in references], axis=0)
    by_plain = np.min([distance(_plain(counts), _plain(r.classes)) for r in references], axis=0)
    vocabulary = sorted({w for r in references for w in r.words})
    place = {w: i for i, w in enumerate(vocabulary)}
    lists = [normal_words(t) for t in texts]
    total = np.array([[len(x)] for x in lists], np.int64)
    at = [np.array([place[w] for w in x if w in place], np.int64) + i * len(vocabulary) for i, x in enumerate(lists)]
    counts = np.bincount(np.concatenate(at), minlength=len(texts) * len(vocabulary)).reshape(len(texts), -1)
    each = []
    for r in references:
        own = counts[:, [place[w] for w in r.words]]
        each.append(distance(np.hstack([own, total - own.sum(1, keepdims=True)]), r.shares))
    return by_class, np.min(each, axis=0), by_plain


_DOCS, _WORDS, _WORD = len(CLASSES), len(CLASSES) + 1, len(CLASSES) + 2  # kinds of counts beside the classes


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, word, n): characters by class, documents, words, and each word."""
    counts: dict[str, tuple[np.ndarray, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (totals, words) in counts.items():
            n = len(totals) + len(words)
            kind = [*range(len(totals)), *[_WORD] * len(words)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(kind, pa.int32()), pa.array([b""] * len(totals) + list(words), pa.binary()), pa.array([*totals.tolist(), *words.values()], pa.int64())], names=["lang", "kind", "word", "n"])

    for batch in K.sliced(batches, "text"):
        texts = K.texts_of(batch.column("text"))
        for text, lang, classes in zip(texts, batch.column("lang").to_pylist(), class_counts(texts), strict=True):
            if lang not in counts:
                counts[lang] = np.zeros(_WORD, np.int64), Counter()
            totals, words = counts[lang]
            own = normal_words(text)
            totals += [*classes, 1, len(own)]
            words.update(own)
        if sum(len(words) for _, words in counts.values()) > KNOWN_WORDS:
            yield from rows()
            counts.clear()
    yield from rows()


def references(docs: DataFrame) -> list[Reference]:
    """The languages' references, counted over all documents that have one. COMMON + 9 rows of each language that has a reference come to the driver."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = labelled.mapInArrow(_counted, "lang string, kind int, word binary, n long").groupBy("lang", "kind", "word").agg(F.sum("n").alias("n"))
    # the common words are found in each partition before any are dealt by language
    place = F.row_number().over(Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "word"))
    few = counts.withColumn("place", place).where(F.col("place") <= COMMON)
    of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("n"))).over(Window.partitionBy("lang"))
    enough = few.withColumns({"docs": of(_DOCS), "total": of(_WORDS)}).where((F.col("docs") >= MIN_DOCS) & (F.col("total") >= MIN_REFERENCE_WORDS))
    table: dict[str, dict] = {}
    for lang, kind, word, n, total, at in enough.orderBy("lang", "kind", "place").select("lang", "kind", "word", "n", "total", "place").collect():
        have = table.setdefault(lang, {"classes": np.zeros(len(CLASSES)), "words": [], "n": [], "total": total})
        if kind < len(CLASSES):
            have["classes"][kind] = n
        elif kind == _WORD:
            have["words"].append(bytes(word))
            have["n"].append(n)
    out = []
    for lang, x in table.items():
        shares = np.array([*x["n"], x["total"] - sum(x["n"])]) / x["total"]
        out.append(Reference(lang, x["classes"] / x["classes"].sum(), tuple(x["words"]), shares))
    return out


def repeated_words(words: K.Words, window: int = REPEAT_WINDOW) -> np.ndarray:
    """For each document of a chunk: words in windows that stand twice or more in it."""
    doc = words.doc()
    covered = np.zeros(len(words) + 1, np.int64)
    n = len(words) - window + 1
    if n > 0:
        at = np.flatnonzero(doc[:n] == doc[window - 1 :])
        key = K.grams(words.hashes(), window)[at] + K.mix(doc[at].astype(K.U64))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        at = at[twice]
        np.add.at(covered, at, 1)
        np.add.at(covered, at + window, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(covered[:-1]) > 0)])
    return total[words.first[1:]] - total[words.first[:-1]]


_BREAK = re.compile(rb"[^ \t\n\x0b\x0c\r]")


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if _BREAK.search(x)]
    return len(lines) - len(set(lines))


FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("class_distance", pa.float64()), ("word_distance", pa.float64())]
DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"


def _judge(names: list[str], text: str, refs: list[Reference]):
    known = {None, *(r.lang for r in refs)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.sliced(batches, text):
            texts = K.texts_of(batch.column(text))
            words = K.Words([t.split() for t in texts])
            n = words.counts
            chars = [len(t.decode("utf-8", "replace")) - len(t) + len(t.translate(None, K.SPACE)) for t in texts]
            symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            repeats = repeated_words(words)
            failed = (n < MIN_WORDS) | (100 * repeats > MAX_REPEAT_PERCENT * n)
            by_class, by_word, by_plain = nearest(texts, refs)
            root = 1 / np.sqrt(np.maximum(n, 1))
            odd = (n >= GUARD_CLASS) & (by_class > CLASS_DISTANCE + CLASS_SCATTER * root)
            odd |= (n >= GUARD_WORDS) & (by_word > WORD_DISTANCE + WORD_SCATTER * root)
            if "lang" in batch.schema.names:
                rare = np.array([x not in known for x in batch.column("lang").cast(pa.string()).to_pylist()], bool)
                odd = np.where(rare, (n >= GUARD_CLASS) & (by_plain > CLASS_DISTANCE + CLASS_SCATTER * root), odd)
            values = [n, chars, symbols, [repeated_lines(t) for t in texts], repeats, failed, ~failed & ~odd, by_class, by_word]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(v, k) for v, (_, k) in zip(values, FIELDS, strict=True))], names=[*batch.schema.names, *names])

    return run


def judged(docs: DataFrame, reference: DataFrame | None = None) -> tuple[DataFrame, dict[str, str]]:
    """docs with the measures of FIELDS appended under names that do not clash; the names by measure.

    `reference` (docs itself if not given) has the texts and languages that the references come from.
    """
    refs = references(docs if reference is None else reference)
    names: dict[str, str] = {}
    for field, _ in FIELDS:
        names[field] = fresh([*docs.columns, *names.values()], field)
    schema = T.StructType(docs.schema.fields + [T.StructField(names[f.name], f.dataType) for f in T._parse_datatype_string(DDL).fields])
    return docs.mapInArrow(_judge(list(names.values()), "text", refs), schema), names


def measured(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and the measures, `kept` among them."""
    rows = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    out, names = judged(rows, docs)
    return out.select("doc_id", *[F.col(v).alias(k) for k, v in names.items()])


def kept(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with their columns unchanged."""
    out, names = judged(docs)
    return out.where(F.col(names["kept"])).select(*[F.col(f"`{x}`") for x in docs.columns])
