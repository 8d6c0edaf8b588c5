"""Generated rows (S7, S8): row i of a generator has template i modulo their number. The texts are this package's own."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import formatters
from millrace.sources.tables import templated

CHAPTERS = [
    "# Sorting\n\n## Definition\nA list is sorted if no element is larger than the next one. Therefore any two neighbours can be compared alone.\n\n## For example\nMerging two sorted lists takes one pass, because the smallest element left is always in front.\n",
    "# Graphs\n\n## Concept\nA graph has vertices, and edges that join two of them. A path is a list of edges that follow each other.\n\n## Algorithm\nTo find a shortest path, visit vertices in the order of their distance. In summary, each edge is looked at once.\n",
    "# Probability\n\n## Definition\nTwo events are independent if the probability of both is the product of each. Therefore knowing one says nothing of the other.\n\n## For example\nTwo throws of a die are independent; a throw and the sum of both are not.\n",
    "# Memory\n\n## Concept\nA cache keeps what was used last, because it is likely to be used again. A function that walks an array in order meets few misses.\n\n## In summary\nThe order of access matters as much as their number.\n",
    "# Recursion\n\n## Definition\nA function is recursive if it calls itself on a smaller case. The proof that it ends is by induction on that size.\n\n## For example\nThe depth of a tree is one more than that of its deepest branch.\n",
]

PROOFS = [
    ("Number Theory", "3", "Show that the sum of two odd numbers is even.", "1. Let the numbers be 2a + 1 and 2b + 1.\n2. Their sum is 2(a + b + 1).\n3. That is twice a whole number."),
    ("Algebra", "2", "Show that (a + b)^2 - (a - b)^2 = 4ab.", "1. Expand both squares.\n2. The terms a^2 and b^2 cancel.\n3. What is left is 2ab + 2ab."),
    ("Logic", "4", "Show that if A implies B, then not B implies not A.", "1. Suppose not B, and suppose A.\n2. Then B, a contradiction.\n3. So not A."),
    ("Combinatorics", "3", "Show that a set of n elements has 2^n subsets.", "1. Each element is in a subset or not.\n2. The choices are independent.\n3. There are n of them, so 2^n in all."),
]

CODE = [
    "def largest(values):\n    best = values[0]\n    for v in values[1:]:\n        if v > best:\n            best = v\n    return best",
    "class Stack:\n    def __init__(self):\n        self.items = []\n\n    def push(self, item):\n        self.items.append(item)\n\n    def pop(self):\n        return self.items.pop()",
    "def gcd(a, b):\n    while b:\n        a, b = b, a % b\n    return a",
    "def flatten(tree):\n    if not isinstance(tree, list):\n        return [tree]\n    return [x for part in tree for x in flatten(part)]",
    "def counts(words):\n    out = {}\n    for w in words:\n        out[w] = out.get(w, 0) + 1\n    return out",
]

#: prompt, thought, tool, arguments, result, reflection, answer
TRACES = [
    ("How many days have 37 hours?", "I divide 37 by 24 with the calculator.", "calculator", {"expression": "37 / 24"}, {"output": 1.5417}, "The quotient is plausible.", "37 hours are about 1.54 days."),
    ("What is the longest word of 'a quick brown fox'?", "I let Python compare the lengths.", "python", {"code": "max('a quick brown fox'.split(), key=len)"}, {"stdout": "quick\n"}, "quick and brown have five letters; the first one counts.", "The longest word is quick."),
    ("Which file mentions retries?", "I search the notes for the word.", "search", {"query": "retries", "limit": 3}, {"files": ["client.md"]}, "", "The file client.md does."),
]

PROMPTS = [
    "User: Show that the product of two odd numbers is odd.\n", "User: Write a python solution for: reverse the words of a sentence.\n",
    "User: Which tool tells the time in another zone? Use it for Lima.\n", "User: Solve the following math problem step-by-step:\nWhat is 17 * 23?\n",
    "User: Write a python solution for: find the two numbers of a list that add up to ten.\n", "User: Look up the boiling point of ethanol.\n",
    "User: Solve the following math problem step-by-step:\nHow many diagonals has a hexagon?\n", "User: Write a python solution for: check whether brackets match.\n",
]


def chapters(spark: SparkSession, count: int) -> DataFrame:
    return templated(spark, CHAPTERS, count)


def proofs(spark: SparkSession, count: int) -> DataFrame:
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(PROOFS)], "template int, subject string, level string, problem string, solution string")
    text = formatters.proof(*map(F.col, ("subject", "level", "problem", "solution")))
    return _cycled(spark, rows, len(PROOFS), count, text)


def code_pairs(spark: SparkSession, count: int) -> DataFrame:
    return templated(spark, [formatters.code_pair_text(c) for c in CODE], count)


def traces(spark: SparkSession, count: int) -> DataFrame:
    names = ("prompt", "thought", "tool", "args", "result", "reflection", "answer")
    rows = [(i, *(json.dumps(x) if isinstance(x, dict) else x for x in t)) for i, t in enumerate(TRACES)]
    rows = spark.createDataFrame(rows, "template int, " + ", ".join(f"{n} string" for n in names))
    return _cycled(spark, rows, len(TRACES), count, formatters.interaction(*map(F.col, names)))


def prompts(spark: SparkSession, count: int) -> DataFrame:
    return templated(spark, PROMPTS, count)


def _cycled(spark: SparkSession, rows: DataFrame, n: int, count: int, text: Column) -> DataFrame:
    written = rows.select("template", text.alias("text"))
    return spark.range(count).withColumn("template", (F.col("id") % n).cast("int")).join(F.broadcast(written), "template").select(F.col("id").alias("ord"), "text")


GENERATORS = {"chapters": chapters, "code": code_pairs, "proofs": proofs, "traces": traces}
