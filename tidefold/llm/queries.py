"""The queries of this subpackage: thin wrappers that derive the contracted columns from the operators' results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import cotraining, decontamination, license_scan, line_dedup, packing, pfp_dedup, quality_rules, sharding, simhash, toxicity
from tidefold.sources import table


def op1_hierarchical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = license_scan.licences(docs, license_scan.train(docs))
    return found.select(
        F.col("key").alias("doc_id"),
        "paragraphs",
        F.size("found").cast("bigint").alias("licensed_paragraphs"),
        F.array_join(F.array_sort(F.array_distinct("found.family")), ",").alias("families"),
        F.array_max("found.probability").alias("probability"),
        F.array_max("found.similarity").alias("similarity"),
    )


def op3_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = toxicity.train(docs, labels.where(~held_out))
    return toxicity.score(docs, model).select(F.col("key").alias("doc_id"), F.crc32(F.col("key").cast("string").cast("binary")).alias("c"), "score").select(
        "doc_id", (F.col("c") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        F.col("key").alias("doc_id"),
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op5_rule_bitmask_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = quality_rules.ledger(table(spark, sf_dir, "documents"))
    failed = F.col("failed").bitwiseAND(quality_rules.POLICIES["base"]) != 0
    return ledger.select(
        F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), quality_rules.kept("v1").alias("kept"), F.col("failed").alias("failed_rules")
    )


def op6_hypergeometric_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    data = F.coalesce("text", F.lit("")).cast("binary")
    return sharding.hypergeometric_shuffle(docs, 40, seed=6).select(
        "doc_id",
        (F.octet_length(data) + 16).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_segment_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.near_duplicate_lines(table(spark, sf_dir, "documents"), equal_least=1)
    return found.select(
        F.col("key").alias("doc_id"),
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"),
        F.size("exact").cast("bigint").alias("n_equal"),
        F.size("near").cast("bigint").alias("n_near"),
        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"),
    )


def op8_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    known = cotraining.features(docs, ("source", "lang", "n_chars"))
    model = cotraining.train(docs, table(spark, sf_dir, "labels"), known=known)
    return cotraining.score(docs, model, known=known).select(F.col("key").alias("doc_id"), "score", "p_content", "p_metadata", (F.col("score") >= 0.5).alias("kept"))


def op9_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op10_prefix_free_parsing_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pfp_dedup.repeated_substrings(table(spark, sf_dir, "documents"))
    size = F.octet_length("text").cast("bigint")
    return cut.select(F.col("key").alias("doc_id"), size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("starts").cast("bigint").alias("n_spans"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_hierarchical_packing,
            op2_license_scan,
            op3_counterfactual_toxicity,
            op4_benchmark_decontamination,
            op5_rule_bitmask_ledger,
            op6_hypergeometric_sharding,
            op7_segment_line_dedup,
            op8_cotraining_quality,
            op9_simhash_near_duplicates,
            op10_prefix_free_parsing_dedup,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_rule_bitmask_ledger": quality_rules.ORACLE_SQL}
