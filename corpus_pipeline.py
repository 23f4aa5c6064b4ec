"""Corpus preparation in five stages.

1. ``quality``       rejects documents by rules with adaptive thresholds
2. ``near_duplicates``  keeps one document of each near-duplicate group
3. ``repeated_passages``  removes passages that start anywhere else too
4. ``decontamination``  drops documents that hold a benchmark window
5. ``packing``       packs what is left into token sequences

Every stage works on all rows of the one before; all but the last return the
columns of their input.  Each operator's module states what it does with NULLs,
empty and long texts, ties, repeated rows, empty tables and clashing names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weblytics.llm import decontamination, near_duplicates, packing, quality, repeated_passages
from weblytics.llm.common import store, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    judged = quality.judge(quality.packed(docs), keep_text=False)
    return judged.filter("kept").select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_duplicates.keep_one(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return repeated_passages.clean(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset", "padded_length")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: the tokenizer of the last stage is beyond SQL; tests compare with plain Python
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared work
    folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
