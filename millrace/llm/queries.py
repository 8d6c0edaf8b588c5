"""Queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.spread import spread
from millrace.llm import bin_packing, decontaminate, jaccard_join, language_id, license_scan, line_dedup, oracles, quality_rules, spelling, substring_dedup, suffix_dedup, token_counts, turn_repair, unigram


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), limit=1024)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_file("piece_bpe_32k.model")
    rows, ids, back = unigram.round_trip(documents(spark, sf_dir).select("doc_id", "text"), path)
    return rows.select(
        "doc_id",
        F.size(ids).cast("long").alias("n_ids"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " "), 256).alias("ids_sha256"),
        (F.col(back) == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identified(documents(spark, sf_dir))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), shingle=4, percent=85)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.licenses(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(documents(spark, sf_dir), words=line_dedup.WORDS)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.size("hit_words").cast("long")
    return out.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.measured(documents(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bin_packing.digests(bin_packing.packed(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json")))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return turn_repair.summaries(turn_repair.damaged(conversations), conversations)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_language_id": op3_language_id,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_license_scan": op5_license_scan,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontaminate": op8_decontaminate,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_packing": op11_packing,
    "op12_turn_repair": op12_turn_repair,
    "op13_spelling": op13_spelling,
}

ORACLES = oracles.ORACLES
