"""Registered queries of the operators: thin wrappers that apply one operator
to its whole table and derive the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblytics.llm import (decontamination, fill_in_middle, html_text, language_id, licences, near_duplicates,
                           packing, prefix_trie, quality, repeated_passages, sharding, token_files, toxicity)
from weblytics.llm.common import crc32_of_id, table
from weblytics.llm.oracle import oracle_sql  # noqa: F401  (read by the registry)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs, keep_text=False).select(
        "doc_id", *quality.COUNTS, "base_failed", "kept", *quality.RATES)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.find(table(spark, sf_dir, "documents"), opt=near_duplicates.NearOptions(width=4))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.find(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_of_id() % 3
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs.filter(fold != 1).select("doc_id", "text", "lang"))
    return language_id.predict(docs.select("doc_id", "text"), model, keep_text=False).select(
        "doc_id", (fold == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = crc32_of_id() % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(docs.filter(fold != 1), labels)
    return toxicity.predict(docs, model, keep_text=False).select(
        "doc_id", (fold == 1).alias("held_out"), "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeated_passages.remove(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return licences.scan(docs, keep_text=False).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files, code = token_files.write_files(table(spark, sf_dir, "documents"))
    return token_files.read_files(files, code).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "padded_length")


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fill_in_middle.transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(fill_in_middle.restored().cast("binary"), 256).alias("restored_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.build(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_language_id": op2_language_id,
        "op3_toxicity": op3_toxicity,
        "op4_sharding": op4_sharding,
        "op5_repeated_passages": op5_repeated_passages,
        "op6_licence_scan": op6_licence_scan,
        "op7_token_files": op7_token_files,
        "op8_packing": op8_packing,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_decontamination": op10_decontamination,
        "op11_html_extraction": op11_html_extraction,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_conversation_trie": op13_conversation_trie,
    }
