"""The corpus pipeline: quality rules, line and near-duplicate removal, decontamination, encoding.

STAGES lists (name, function). A function takes (spark, docs, sf_dir) and returns a DataFrame; all but
the last return the columns of docs. `run` applies them to the table documents, writing what each
stage returns as Parquet in the folder that all executors share and reading it again. What a stage
returned is deleted when the next one's is written; the last stays, since the result is read from it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import files
from millrace.functions.checkpoints import shared_folder
from millrace.llm import decontaminate, jaccard_join, line_dedup, quality_rules, unigram

VOCABULARY = "piece_bpe_32k.model"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.kept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted; documents left without a line go."""
    return line_dedup.without_repeats(docs, words=line_dedup.WORDS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays (five-word shingles, similarity 0.8 or more)."""
    return jaccard_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and whether they decode to its text."""
    path = str(public_tokenizers.path(VOCABULARY))
    rows, ids, back = unigram.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    same = F.col(back) == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "lang", "source", F.size(ids).cast("long").alias("n_ids"), F.col(ids).alias("ids"), same.alias("round_trip"))


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("jaccard_join", near_duplicates),
    ("decontaminate", benchmark),
    ("sentencepiece", tokens),
]

#: The quality rules' references and the pieces' log scores are not in SQL's reach.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(at := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(at)
            if before:
                files.delete(spark, before)
            before = at
    return docs
