"""The queries of this subpackage, each over its whole table, and the SQL that some must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (
    decontam, dedup, html, infill, labelled, language, mixing, negatives, oracles, pii, quality, rules, sharding,
    simhash, toxicity,
)
from tessera.session import table


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    model = html.fit(labelled.labelled_pages(spark))
    return html.extract(table(spark, sf_dir, "pages"), model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    documents = table(spark, sf_dir, "documents")
    return toxicity.score(documents, toxicity.fit(documents, table(spark, sf_dir, "labels")))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; a source is a host, and a language in it a path."""
    return quality.hierarchical_quality(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang")
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy difference of every document; the documents labelled good and not toxic are the target."""
    labels = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return language.cross_entropy_difference(table(spark, sf_dir, "documents"), labels)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of near-duplicates of every document."""
    return dedup.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition measures and verdict of every document."""
    judged = rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    rule = F.col("rules")
    size = rules.RuleConfig().repeat_size
    return judged.select(
        "doc_id", rule["n_words"].alias("n_words"), rule["word_chars"].alias("word_chars"),
        rule["n_symbols"].alias("n_symbols"), rule["n_dup_lines"].alias("n_dup_lines"),
        rule[f"n{size}_words"].alias("n_repeat_words"), "base_failed", "kept",
    )


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document."""
    return decontam.contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    ).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts and digest of the base, all spans."""
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slot and shard of every document."""
    return sharding.place(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document cut and rearranged; digests of the output and of the text rebuilt from it."""
    infilled = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    cut = F.col("infill")
    return infilled.select(
        "doc_id", cut["n"].alias("n"), cut["form"].alias("form"), cut["prefix_chars"].alias("prefix_chars"),
        cut["middle_chars"].alias("middle_chars"), F.sha2(cut["output"], 256).alias("output_sha256"),
        F.sha2(infill.restored(cut["output"], cut["form"]), 256).alias("restored_sha256"),
    )


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of near-duplicates of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector; every seventh has its label moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(
        table(spark, sf_dir, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0
    )


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_toxicity": op2_toxicity,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_quality_rules": op6_quality_rules,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_personal_data": op8_personal_data,
    "op9_sharding": op9_sharding,
    "op10_source_mixing": op10_source_mixing,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_simhash_near_dedup": op13_simhash_near_dedup,
}

ORACLES = oracles.ORACLES
