"""The pipeline, stage by stage, against plain Python."""

import hashlib

from pyspark.sql import functions as F

import brute
from llm_cases import edge, empty  # noqa: F401  (fixtures)
import corpus_pipeline
from weblytics.llm import quality
from weblytics.llm.common import store

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, results = docs.columns, {"input": docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SF), name)
        assert name == "packing" or docs.columns == columns
        results[name] = docs.collect()
    assert {r.doc_id for r in results["quality"]} == kept
    assert kept <= {r.doc_id for r in results["input"] if not brute.quality(r.text)["base_failed"]}
    first = results["quality"]
    ids = [r.doc_id for r in first]
    alone = {i for i, c in zip(ids, brute.components(ids, [brute.shingles(r.text) for r in first])) if i == c}
    second = results["near_duplicates"]
    assert {r.doc_id for r in second} == alone
    third = {r.doc_id: r.text for r in results["repeated_passages"]}
    for r, (words, covered) in zip(second, brute.repeats([r.text for r in second])):
        want = r.text if not covered else " ".join(w for k, w in enumerate(words) if k not in covered)
        assert third[r.doc_id] == want
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hit = brute.benchmark_hits(list(third.values()), items)
    clean = {i for i, h in zip(third, hit) if not h[1]}
    assert {r.doc_id for r in results["decontamination"]} == clean
    packed = results["packing"]
    assert {r.doc_id for r in packed} == clean
    total = {}
    for r in packed:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert all(total[r.doc_id] == r.doc_tokens for r in packed)


def test_empty_and_odd_tables(spark, empty, edge):
    for docs, n in ((empty.select("doc_id", "text", "lang", "source", "n_chars"), 0), (edge, None)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, SF), f"odd-{name}")
            assert name == "packing" or docs.columns == columns
        assert n is None or docs.count() == n


def test_run_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert hashlib.sha256(b"").hexdigest() and corpus_pipeline.ORACLE_SQL is None
    assert corpus_pipeline.run(spark, SF).select(F.sum("length")).first()[0] > 0
