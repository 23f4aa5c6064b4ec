"""Every operator on the edge table, on an empty table, and against plain
Python on the small test tables."""

import hashlib
import json
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import brute
from llm_cases import SCHEMA, edge, edge_rows, empty  # noqa: F401  (fixtures)
from weblytics.llm import (decontamination, language_id, licences, near_duplicates, packing, quality,
                           repeated_passages, sharding, token_files, tokens, toxicity)
from weblytics.llm.common import store
from weblytics.llm.oracle import oracle_sql
from weblytics.llm.queries import queries

SF = "/root/testdata/sf0.001"
ROWS = edge_rows()
KEYS = [(r[0] is None, r[0] or 0, r[1] or "") for r in ROWS]


def ordered(df, columns):
    """Rows as tuples in the edge table's (id, text) order."""
    rows = df.select("doc_id", "text", *columns).collect()
    assert len(rows) == len(ROWS)
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.text or ""))
    return [tuple(r[2:]) for r in rows]


SORTED = [r for _, r in sorted(zip(KEYS, ROWS), key=lambda x: x[0])]
TEXTS = [r[1] for r in SORTED]


# -- 1 quality ------------------------------------------------------------------

def test_quality_counts(edge):
    got = ordered(quality.judge(edge), [*quality.COUNTS, "base_failed"])
    assert got == [tuple(brute.quality(t).values()) for t in TEXTS]


def test_quality_thresholds_follow_their_group(spark):
    def doc(i, n_symbols, source):
        return (i, " ".join(f"w{i}x{k}" for k in range(100)) + " " + "#" * n_symbols, "en", source)

    rows = [doc(i, 0, "clean") for i in range(200)] + [doc(1000 + i, 200, "code") for i in range(200)]
    rows += [doc(5000, 200, "clean"), doc(5001, 200, "new")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = {r.doc_id: r.kept for r in quality.judge(df).select("doc_id", "kept").collect()}
    assert all(kept[i] for i in range(200)) and all(kept[1000 + i] for i in range(200))
    assert not kept[5000]          # far outside its source
    assert kept[5001]              # few rows: judged by the language's thresholds


def test_quality_limits_differ_by_source_and_every_rule_rejects(spark):
    """Two sources with other habits: each of the four rates has two limits, and a
    document that is normal in one source is rejected in the other."""
    import random

    rng = random.Random(1)

    def doc(i, source, length=4, symbols=0, twice=0, lines=0):
        words = [f"{rng.randrange(16 ** length):0{length}x}" for _ in range(200)]
        words += words[:3] * twice
        text = " ".join(words) + " " + "#" * symbols + "\n" + "\n".join([f"l{k}" for k in range(20)] + [f"l{k}" for k in reversed(range(lines))])
        return (i, text, "en", source)

    rows = [doc(k, "prose", 4 + k % 2, k % 3, k % 2, k % 2) for k in range(300)]
    rows += [doc(1000 + k, "code", 9 + k % 5, 100 + k % 100, 5 + k % 10, 8 + k % 6) for k in range(300)]
    odd = {"word_length": dict(length=13), "symbol_rate": dict(symbols=150), "dup_line_rate": dict(lines=10),
           "repeat_rate": dict(twice=14)}
    normal = {"prose": dict(length=5), "code": dict(length=11, symbols=150, twice=10, lines=8)}
    for n, (rate, other) in enumerate(odd.items()):
        rows.append(doc(5000 + n, "prose", **{**normal["prose"], **other}))
        rows.append(doc(6000 + n, "code", **{**normal["code"], **other}))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    counted = quality.with_counts(df)
    limits = {r.source: r for r in quality.thresholds(quality.sketches(counted)).collect()}
    for rate in quality.RATES:
        assert limits["prose"][f"high_{rate}"] < limits["code"][f"high_{rate}"]
    found = {r.doc_id: r for r in quality.judge(df).collect()}
    for n, rate in enumerate(odd):
        r = found[5000 + n]
        beyond = [x for x in quality.RATES if r[x] > limits["prose"][f"high_{x}"]]
        assert not r.base_failed and beyond == [rate] and not r.kept
        assert found[6000 + n].kept
    assert sum(not found[k].kept for k in range(300)) <= 3


def test_quality_sketch_buckets(spark):
    values = [0, 1, 63, 64, 65, 127, 128, 1000, 99_999, 10 ** 12]
    df = spark.createDataFrame([(v,) for v in values], "v long").withColumn("b", quality.bucket_of(F.col("v")))
    rows = df.withColumn("low", quality.value_of(F.col("b"))).orderBy("v").collect()
    assert [r.b for r in rows] == sorted(r.b for r in rows)
    assert all(r.low <= r.v <= r.low * 33 / 32 + 1 for r in rows)


# -- 2 language, 3 toxicity -------------------------------------------------------

def test_language_edges_and_empty(edge, empty):
    docs = edge.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.lit("en")).otherwise(F.lit("de")))
    model = language_id.fit(docs)
    got = ordered(language_id.predict(edge, model), ["lang_pred", "score", "rejected"])
    for text, (lang, score, rejected) in zip(TEXTS, got):
        letter = any(c.isalpha() for c in text or "")
        assert lang in (("en", "de") if letter else ("und",)) and 0 <= score <= 1
        assert letter or rejected
    assert language_id.predict(empty, model).count() == 0
    nothing = language_id.fit(empty)
    assert {r.lang_pred for r in language_id.predict(edge, nothing).collect()} == {"und"}


def test_language_score_ignores_neighbours_and_batches(spark, monkeypatch):
    import pyarrow as pa

    rows = [(("en", "the cat and the hat"), ("de", "der hund und die katze"))[i % 2] for i in range(40)]
    opt = language_id.LanguageOptions(bucket_bits=10)
    df = spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language_id.train(language_id.sample_features(df, "doc_id", "text", "lang", opt), opt)
    texts = ["the cat", "der hund", "", "x", "die katze und the hat " * 50]
    together = model.score(pa.array(texts))
    alone = [model.score(pa.array([t])) for t in texts]
    assert together[0] == [a[0][0] for a in alone]
    assert all(abs(together[1][i] - a[1][0]) < 1e-9 for i, a in enumerate(alone))
    monkeypatch.setattr(language_id, "SEGMENT_BYTES", 64)
    pieces = model.score(pa.array([texts[-1]]))
    assert abs(pieces[1][0] - alone[-1][1][0]) < 1e-9


def test_language_held_out_accuracy(spark):
    rows = queries()["op2_language_id"](spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and held
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.97 * len(held)


def toxic_rows(n, start):
    import random

    rng = random.Random(start)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(start, start + n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = int(i % 10 == 0)
        for k in range(4 if toxic else 0):
            text.insert(rng.randrange(len(text)), f"bad{rng.randrange(8)}")
        rows.append((i, " ".join(text), toxic))
    return rows


def test_toxicity_learns_planted_words(spark, edge, empty):
    train, test = toxic_rows(1500, 0), toxic_rows(400, 10_000)
    docs = spark.createDataFrame(train, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert len(model.index) < 3000      # L1 leaves few weights
    scored = {r.doc_id: r for r in toxicity.predict(
        spark.createDataFrame(test, "doc_id long, text string, toxic int"), model).collect()}
    right = sum(scored[i].predicted == y for i, _, y in test)
    assert right >= 0.98 * len(test)
    assert not any(scored[i].predicted for i, _, y in test if not y)
    got = ordered(toxicity.predict(edge, model), ["score", "predicted"])
    assert all(0 <= s <= 1 and p == int(s >= 0.7) for s, p in got)
    assert toxicity.predict(empty, model).count() == 0
    unlabelled = toxicity.fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic").limit(0))
    assert {r.score for r in toxicity.predict(edge, unlabelled).collect()} == {0.5}


# -- 4 sharding -------------------------------------------------------------------

def test_shards(spark, edge, empty):
    docs = edge.withColumn("shard", F.lit("old")).withColumn("Slot", F.lit("old"))
    out = sharding.shard(docs, shards=4)
    rows = out.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r[0], r[1]) for r in ROWS)
    sizes = Counter(r.shard for r in rows)
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    again = sharding.shard(docs.repartition(7), shards=4).collect()
    place = lambda rs: sorted((str(r.doc_id), str(r.text), r.shard, r.slot) for r in rs)
    assert place(again) == place(rows)
    assert sharding.shard(empty).count() == 0
    assert sharding.shard(edge.limit(3), shards=8).count() == 3


def test_fisher_yates_is_a_fair_shuffle():
    seen = Counter(tuple(sharding.fisher_yates(3, (1, i))) for i in range(3000))
    assert len(seen) == 6 and min(seen.values()) > 400
    assert sharding.fisher_yates(0, (1,)).tolist() == [] and sharding.fisher_yates(1, (1,)).tolist() == [0]


def test_sharding_spreads_rows_without_id_and_copies(spark):
    """A third of the rows has no id, a third is one row: no bucket stands out, every
    row stays, names of inner columns are kept."""
    rows = [(None, f"text {i} " * 9, "p", "c", 1) for i in range(1300)] + [(None, "same", "p", "c", 2)] * 1300
    rows += [(i, f"other {i}", "p", "c", 3) for i in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `__pos` string, `row` string, bucket int")
    packed = sharding.packed_rows(df, hot_rows=100)
    sizes = [r.n for r in packed.groupBy(sharding.bucket_of(17, 64).alias("b")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 3900 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    out = sharding.shard(df, shards=4, hot_rows=100)
    assert out.columns[:5] == df.columns
    assert Counter(map(tuple, out.select(*[f"`{c}`" for c in df.columns]).collect())) == Counter(rows)
    for k in range(4):
        assert sorted(r.slot for r in out.where(F.col("shard") == k).collect()) == list(range(975))


def test_token_files_and_packing_split_rows_without_id(spark):
    from weblytics.llm.common import in_key_order
    rows = [(None, f"text {i % 900}") for i in range(1300)] + [(None, "same")] * 1300 + [(i, f"other {i}") for i in range(1300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(coalesce)
    spark.conf.set(coalesce, "false")
    try:
        placed = store(in_key_order(df, "doc_id", "text").withColumn("part", F.spark_partition_id()), "ordered")
    finally:
        spark.conf.set(coalesce, old)
    sizes = [r["count"] for r in placed.groupBy("part").count().collect()]
    assert sum(sizes) == 3900 and len(sizes) > 4 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    ids = [r.doc_id for r in in_key_order(df, "doc_id", "text").collect()]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))


def test_codes_for_more_than_65536_ids():
    import numpy as np
    rng = np.random.default_rng(5)
    counts = rng.integers(1, 9, 70_000)
    bits = token_files.code_lengths(counts, token_files.bit_limit(len(counts)))
    assert bits.max() <= 18 and abs(sum(2.0 ** -int(b) for b in bits) - 1) < 1e-9
    ids = np.concatenate([np.arange(70_000), rng.integers(0, 70_000, 5000)])
    sizes = np.array([70_000, 0, 5000])
    payload = token_files.encode_block(sizes, ids, bits, token_files.canonical_codes(bits), 256)
    got_sizes, got = token_files.decode_block(payload, *token_files.decode_table(bits))
    assert got.tolist() == ids.tolist() and got_sizes.tolist() == sizes.tolist()


def test_samples_have_a_hard_bound(spark):
    rows = [(None, f"text of {i} words", "en" if i % 3 else "de") for i in range(3000)]
    rows += [(None, "one text", "en")] * 3000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for seed in (1, 3, 5):
        found = language_id.sample_features(df, "doc_id", "text", "lang", language_id.LanguageOptions(max_rows=300, seed=seed))
        assert 200 < len(found) <= 300 and {r[0] for r in found} == {"de", "en"}
    labels = spark.createDataFrame([(7, 0)] * 50 + [(8, 1)] * 50, "doc_id long, toxic int")
    docs = spark.createDataFrame([(7 + i % 2, f"text {i}") for i in range(2000)] + [(8, "text")] * 500, "doc_id long, text string")
    chosen, share = toxicity.sample_features(docs, labels, "doc_id", "text", "toxic", toxicity.ToxicityOptions(max_rows=100))
    assert 60 < len(chosen) <= 100 and 0.5 < share < 0.7


def test_decontamination_keeps_columns_with_inner_names(spark):
    benchmark = spark.createDataFrame([("i", " ".join(f"b{k}" for k in range(12)))], "item_id string, text string")
    names = ["__key", "__hit", "__all", "key", "row", "hit", "words", "n_hit"]
    rows = [(i, f"a{i} " + (" ".join(f"b{k}" for k in range(12)) if i == 1 else "z"), *[f"{n} {i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    kept = decontamination.clean(df, benchmark)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    cut = decontamination.clean(df, benchmark, remove="spans")
    assert cut.columns == df.columns
    assert sorted(map(tuple, cut.collect())) == [rows[0], (1, "a1", *rows[1][2:]), rows[2]]
    found = decontamination.find(df, benchmark).collect()
    assert sorted((r.doc_id, r.n_hit, r.row) for r in found) == [(0, 0, "row 0"), (1, 12, "row 1"), (2, 0, "row 2")]


# -- 5 repeated passages ------------------------------------------------------------

def test_passages_with_colliding_hashes_are_decided_by_words(spark, edge):
    """Hashes of few bits: nearly every window is suspected; words decide."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(120)) + (" " + " ".join(f"p{k}" for k in range(40)) if i % 5 == 0 else ""))
            for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bits in (1, 6):
        opt = repeated_passages.PassageOptions(hash_bits=bits)
        got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_passages.remove(df, opt=opt).collect()}
        assert got == {i: (160, 40) if i % 5 == 0 else (120, 0) for i in range(40)}
    few = ordered(repeated_passages.remove(edge, opt=repeated_passages.PassageOptions(hash_bits=4)), ["n_words", "n_removed"])
    assert few == ordered(repeated_passages.remove(edge), ["n_words", "n_removed"])


def test_passages_of_rows_that_repeat_a_thousand_times(spark):
    """A third of the rows agree in key (none) and text: looked at twice, all judged."""
    text = " ".join(f"h{k}" for k in range(50)) + " tail"
    rows = [(None, text, n) for n in range(1000)] + [(i, f"{i} " * 60 + text if i % 9 == 0 else f"t{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    got = repeated_passages.remove(df).collect()
    assert sorted((r.n_words, r.n_removed) for r in got if r.doc_id is None) == [(51, 51)] * 1000
    assert sorted(r.n for r in got if r.doc_id is None) == list(range(1000))
    assert all((r.n_words, r.n_removed) == ((111, 111) if r.doc_id % 9 == 0 else (1, 0)) for r in got if r.doc_id is not None)


def test_clean_keeps_columns_with_the_names_of_results(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    names = ["n_words", "n_removed", "passages", "kept_text", "__bucket", "__h1", "row", "key", "input", "bucket"]
    rows = [(i, f"a{i} {passage}", *[f"{n} {i}" for n in names]) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    got = repeated_passages.clean(df)
    assert got.columns == df.columns
    assert sorted(map(tuple, got.collect())) == [(i, f"a{i}", *r[2:]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("opt", [repeated_passages.PassageOptions(),
                                 repeated_passages.PassageOptions(automaton_words=50, bucket_bytes=1000)])
def test_passages(edge, empty, opt):
    done = repeated_passages.remove(edge, opt=opt)
    got = ordered(done.withColumn("sha", F.sha2(F.col("kept_text").cast("binary"), 256)),
                  ["n_words", "n_removed", "sha"])
    assert got == brute.repeats_digest(TEXTS)
    assert repeated_passages.remove(empty, opt=opt).count() == 0
    spans = {r.doc_id: r.passages for r in done.select("doc_id", "passages").collect()}
    assert [(s.start, s.stop) for s in spans[11]] == [(0, 60)]
    cleaned = {r.doc_id: r.text for r in repeated_passages.clean(edge, opt=opt).collect()}
    assert cleaned[11] == "" and cleaned[14] == ROWS[14][1] and cleaned[0] is None


def test_passages_of_one_repeated_word(spark):
    texts = ["a " * n for n in (34, 35, 36, 70, 71, 200, 1000)] + ["b " * 35, "c " + "b " * 35]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeated_passages.remove(df).collect()}
    assert [got[i] for i in range(len(texts))] == [x[:2] for x in brute.repeats_digest(texts)]


# -- 6 licences ---------------------------------------------------------------------

def test_licences(spark, empty):
    mit = next(t for label, t, _ in licences.TEMPLATES if label == "mit" and "hereby" in t)
    texts = [None, "", "MIT License", "the mit-license; CC BY, cc  by", "x " * 100 + mit + " y" * 50,
             mit.replace("merge", "purge"), " ".join(mit.split()[:10]), "gnu general public license",
             "This work is licensed under the GNU General Public License, version 3.", "cc", "apache license " * 3]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, labels string")
    rows = {r.doc_id: r for r in licences.scan(df).collect()}
    for i, t in enumerate(texts):
        want = brute.licences(t)
        assert {k: rows[i][k] for k in want} == want, t
        assert set(filter(None, want["base_labels"].split(","))) <= set(rows[i].labels.split(","))
    assert rows[4].labels == "mit" and rows[4].score == 1.0 and rows[4].matches[0].word == 100
    assert rows[5].labels == "mit" and 0.9 < rows[5].score < 1
    assert rows[6].labels == "" and rows[6].score == 0
    assert rows[8].labels == "gpl,gpl-3.0"
    assert licences.scan(empty).count() == 0


def plain_labels(text, opt=licences.LicenceOptions()):
    """Base labels, and every template whose words stand in order, by share, in some
    stretch of the text of its length plus the drift; mandatory phrases likewise."""
    import re

    def words(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)

    def common(x, y):
        row = [0] * (len(y) + 1)
        for w in x:
            last = 0
            for j, v in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if w == v else max(row[j], row[j - 1])
        return row[-1]

    own, out = words(text), set(filter(None, brute.licences(text)["base_labels"].split(",")))
    for label, template, keys in licences.TEMPLATES:
        t = words(template)
        for s in range(len(own)):
            part = own[s:s + len(t) + opt.drift]
            if own[s] in t and common(part, t) >= opt.share * len(t) and all(any(
                    common(part[k:k + len(words(key)) + 2], words(key)) == len(words(key)) for k in range(len(part)))
                    for key in keys):
                out.add(label)
                break
    return ",".join(sorted(out))


def test_licences_with_words_put_in_left_out_or_before_each_line(spark):
    def changed(words, how):
        half = len(words) // 2
        return {"same": words, "put in": [*words[:half], "Inc", *words[half:]], "left out": words[:-6] + words[-5:],
                "lines": [w for k, w in enumerate(words) for w in (["dnl", w] if k % 9 == 0 else [w])],
                "other": [w if k % 2 else f"x{k}" for k, w in enumerate(words)]}[how]

    long = [(label, t) for label, t, _ in licences.TEMPLATES if len(t.split()) > 18]
    rows, sure = [], []
    for n, (label, t) in enumerate(long):
        for how in ("same", "put in", "left out", "lines", "other"):
            rows.append((len(rows), "intro " * (n % 3) + " ".join(changed(t.split(), how)) + " and then code", how, label))
    gpl = next(t for label, t in long if label == "gpl-3.0+")
    rows.append((len(rows), gpl.replace("Foundation,", "Foundation, Inc.,"), "Inc.", "gpl-3.0+"))
    df = spark.createDataFrame(rows, "doc_id long, text string, how string, label string")
    for r in licences.scan(df).collect():
        assert r.labels == plain_labels(r.text), (r.how, r.label)
        assert r.how == "other" or r.label in r.labels.split(","), (r.how, r.label)
        assert r.how != "other" or r.label not in r.labels.split(",")


def test_licences_of_the_edge_table(spark, edge):
    got = licences.scan(edge)
    assert got.columns[:3] == ["doc_id", "text", "lang"] and got.count() == len(ROWS)
    for r in got.collect():
        assert (r.base_labels, r.labels, r.score) == ("", "", 0.0)
    twice = spark.createDataFrame([(None, "the MIT License")] * 3 + [(4, None)], "doc_id long, text string")
    assert [r.labels for r in licences.scan(twice).orderBy(F.col("doc_id").asc_nulls_first()).collect()] == ["mit"] * 3 + [""]


def test_licence_query_equals_plain_python(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in queries()["op6_licence_scan"](spark, SF).collect():
        want = brute.licences(docs[r.doc_id])
        assert {k: r[k] for k in want} == want


# -- 7 token files, 8 packing ---------------------------------------------------------

def encoded(texts, end):
    tokenizer = tokens.load(tokens.tokenizer_path())
    return [e.ids + [end] for e in tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def key_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))


@pytest.mark.parametrize("opt", [token_files.FileOptions(), token_files.FileOptions(block_tokens=500, checkpoint=7)])
def test_token_files_round_trip(edge, empty, opt):
    import numpy as np

    files, code = token_files.write_files(edge, options=opt)
    rows = token_files.read_files(files, code).orderBy("start").collect()
    want = encoded([r[1] for r in key_order(ROWS)], opt.end_id)
    assert [r.doc_id for r in rows] == [r[0] for r in key_order(ROWS)]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in rows] == want
    at = 0
    for r, ids in zip(rows, want):
        assert r.start == at and r.n_tokens == len(ids)
        at += len(ids)
    files, code = token_files.write_files(empty, options=opt)
    assert token_files.read_files(files, code).count() == 0


def test_huffman_lengths_are_limited_and_good():
    import numpy as np

    counts = np.array([2 ** i for i in range(30)] + [0, 5], dtype=np.int64)
    bits = token_files.code_lengths(counts, 16)
    assert bits.max() <= 16 and bits[30] == 0
    assert sum(2.0 ** -int(b) for b in bits if b) <= 1
    free = token_files.code_lengths(np.array([5, 9, 12, 13, 16, 45]), 16)
    assert sorted(free.tolist()) == [1, 3, 3, 3, 4, 4]
    assert token_files.code_lengths(np.array([0, 7])).tolist() == [0, 1]


def check_packing(rows, docs, length=2048):
    import numpy as np

    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= length
        assert rs[0].padded_length == (at if at & (at - 1) == 0 else length)
    for doc, ids in docs.items():
        at = 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert np.frombuffer(r.ids, "<u4").tolist() == ids[at:at + r.length]
            at += r.length
        assert at == len(ids)
    used = sum(len(d) for d in docs.values())
    return used / sum(rs[0].padded_length for rs in sequences.values())


@pytest.mark.parametrize("opt", [packing.PackOptions(), packing.PackOptions(chunk_tokens=5000)])
def test_packing(spark, empty, opt):
    rows = [r for r in edge_rows()[:21]]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    docs = dict(zip([r[0] for r in rows], encoded([r[1] for r in rows], 1)))
    assert check_packing(packing.pack(df, options=opt).collect(), docs) > 0.97
    assert packing.pack(empty, options=opt).count() == 0


def test_packing_keeps_repeated_and_null_keys(edge):
    rows = packing.pack(edge).collect()
    assert sum(r.length for r in rows) == sum(map(len, encoded([r[1] for r in ROWS], 1)))


def test_cuts_are_the_cheapest():
    """Against a plain quadratic dynamic programme."""
    import numpy as np

    rng = np.random.default_rng(4)
    opt = packing.PackOptions(length=32, smallest_power=2, hard_every=5)
    for _ in range(30):
        at = np.unique(np.concatenate([[0, 300], np.arange(0, 300, 20), rng.integers(1, 300, 40)]))
        penalty = rng.integers(0, 9, len(at))
        penalty[[0, -1]] = 0

        def cost(size):
            return opt.per_sequence + (0 if size & (size - 1) == 0 and size >= 4 else opt.length - size)

        best = [0] + [10 ** 9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(int(at[j] - at[i])) for i in range(j) if at[j] - at[i] <= 32) + int(penalty[j])
        ends = packing.best_cuts(at, penalty, opt)
        total = sum(cost(b - a) for a, b in zip([0] + ends, ends)) + sum(
            int(penalty[np.searchsorted(at, e)]) for e in ends)
        assert ends[-1] == 300 and total == best[-1]


def test_packing_query_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([r.doc_id for r in docs], encoded([r.text for r in docs], 1)))
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert check_packing(packing.pack(df).collect(), ids) > 0.97


# -- 9 near duplicates ----------------------------------------------------------------

@pytest.mark.parametrize("opt", [near_duplicates.NearOptions(), near_duplicates.NearOptions(width=4),
                                 near_duplicates.NearOptions(block_classes=2, cluster_blocks=1)])
def test_near_duplicates(edge, empty, opt):
    def shingles(text):
        return brute.shingles(text, opt.width)

    rows = near_duplicates.find(edge, opt=opt).collect()
    assert len(rows) == len(ROWS)
    known = [r for r in ROWS if r[0] is not None]
    want = dict(zip([r[0] for r in known], brute.components([r[0] for r in known], [shingles(r[1]) for r in known])))
    for r in rows:
        if r.doc_id is not None:
            assert (r.component_id, r.kept) == (want[r.doc_id], r.doc_id == want[r.doc_id])
            assert r.n_shingles == len(shingles(next(x[1] for x in known if x[0] == r.doc_id)))
    unknown = sorted((r.n_shingles, r.component_id or -1, r.kept) for r in rows if r.doc_id is None)
    assert unknown == [(0, -1, True), (71 - opt.width, -1, True), (201 - opt.width, 5, False)]
    assert near_duplicates.find(empty, opt=opt).count() == 0
    kept = near_duplicates.keep_one(edge, opt=opt)
    assert kept.columns == edge.columns


def test_keep_one_decides_per_row(spark, edge):
    """Rows that share an id, or have none, are in different groups; copies
    have the same id, or none."""
    base, own = [r[1] for r in ROWS[5:7]], " ".join(f"own{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(3, base[0], "a"), (5, base[0], "a"), (5, own, "a"), (7, own, "a"), (7, own + " end", "a"),
            (7, None, "a"), (None, base[0], "a"), (None, other, "b"), (None, other, "a"), (None, other, None),
            (None, other + " end", "a"), (None, " ".join(f"last{i}" for i in range(80)), "a"), (None, None, "a"),
            (None, "", "a"), (9, " ".join(f"nine{i}" for i in range(80)), "z"),
            (9, " ".join(f"nine{i}" for i in range(80)), "z")]
    for df, table in ((spark.createDataFrame(rows, "doc_id long, text string, source string"), rows),
                      (edge, [(r[0], r[1], r[3]) for r in ROWS])):
        group = brute.components(list(range(len(table))), [brute.shingles(r[1]) for r in table])
        least = {}
        for g, r in zip(group, table):
            if brute.shingles(r[1]):
                least[g] = min(least.get(g, (True, 0)), (r[0] is None, r[0] or 0))
        kept = [tuple(r) for r in near_duplicates.keep_one(df).select("doc_id", "text", "source").collect()]
        place = {r[1]: g for g, r in zip(group, table)}
        with_words = [r for r in kept if brute.shingles(r[1])]
        # every group once, by its smallest id
        assert sorted(place[r[1]] for r in with_words) == sorted(least)
        assert all((r[0] is None, r[0] or 0) == least[place[r[1]]] for r in with_words)
        assert Counter(r for r in kept if not brute.shingles(r[1])) == \
            Counter(r for r in table if not brute.shingles(r[1]))
        assert not Counter(kept) - Counter(table)


def chain(n, words=120, step=6):
    """Texts of which only neighbours are near: a moving window of edits."""
    import random

    rng = random.Random(1)
    text = [f"b{i}" for i in range(words)]
    out = []
    for i in range(n):
        out.append((i, " ".join(text)))
        for _ in range(step // 4 + 1):
            text[rng.randrange(words)] = f"e{i}x{rng.randrange(10 ** 6)}"
    return out


@pytest.mark.parametrize("opt", [near_duplicates.NearOptions(),
                                 near_duplicates.NearOptions(block_classes=16),
                                 near_duplicates.NearOptions(block_classes=16, cluster_blocks=2)])
def test_near_duplicate_chains(spark, opt):
    rows = chain(150)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates.find(df, opt=opt).collect()}
    want = brute.components([i for i, _ in rows], [brute.shingles(t) for _, t in rows])
    assert [got[i] for i, _ in rows] == want
    assert len(set(want)) < 20


def test_register_estimate_is_unbiased():
    import numpy as np

    rng = np.random.default_rng(2)
    errors = []
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2 ** 64, 1200, dtype=np.uint64))
        a, b = np.sort(pool[:1000]), np.sort(pool[100:1100])
        regs = np.stack([near_duplicates.registers(a), near_duplicates.registers(b)])
        errors.append(((regs[0] == regs[1]) & (regs[0] > 0)).sum() / (regs > 0).any(axis=0).sum() - 900 / 1100)
    assert abs(np.mean(errors)) < 0.03


# -- 10 decontamination -----------------------------------------------------------------

ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "Short Item"), (3, None),
         (4, "..."), (None, "no id here"), (1, "second text of the first item")]
DOCS = [None, "", "nothing", "ALPHA beta, gamma-delta epsilon zeta eta theta iota kappa!", "a short item b short  item",
        "x no id here y", "beta gamma delta epsilon zeta eta theta iota kappa lambda mu and beta",
        "second text of the first item"]


def test_decontamination(spark, edge, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(DOCS)], "doc_id long, text string, n_hit string")
    rows = {r.doc_id: r for r in decontamination.find(docs, items).collect()}
    want = brute.benchmark_hits(DOCS, [("" if i is None else i, t) for i, t in ITEMS])
    assert [(rows[i].n_words, rows[i].n_hit, rows[i]["items"]) for i in range(len(DOCS))] == want
    left = {r.doc_id for r in decontamination.clean(docs, items).collect()}
    assert left == {i for i, w in enumerate(want) if w[1] == 0}
    spans = {r.doc_id: r.text for r in decontamination.clean(docs, items, remove="spans").collect()}
    assert spans[4] == "a b" and spans[5] == "x y" and spans[2] == "nothing" and spans[3] == "" and spans[0] is None
    assert decontamination.find(empty, items).count() == 0
    none = decontamination.find(edge, items.limit(0))
    assert none.count() == len(ROWS) and not any(r.contaminated for r in none.collect())


def test_decontamination_beyond_the_broadcast_limit(spark, monkeypatch):
    """The lookup by shuffle finds the same, and shuffles windows, not texts."""
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = DOCS + [" ".join(f"w{k}" for k in range(3000)) + " " + ITEMS[0][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    columns = ["doc_id", "n_words", "n_hit", "items", "contaminated"]
    want = decontamination.find(df, items).select(*columns).orderBy("doc_id").collect()
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert decontamination.find(df, items).select(*columns).orderBy("doc_id").collect() == want
        windows = store(decontamination.item_windows(items), "windows")
        plan = decontamination.document_hits(df, windows)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    lines = plan.split("\n")
    at = next(k for k, line in enumerate(lines) if "Join LeftSemi" in line)
    assert "Project" in lines[at + 1] and "slice(" in lines[at + 1]


# -- registered queries --------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    rows = sorted(json.dumps(r.asDict(), sort_keys=True) for r in df.collect())
    res = duck.execute(oracle_sql()[name])
    columns = [d[0] for d in res.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows == sorted(json.dumps(dict(zip(columns, r)), sort_keys=True) for r in res.fetchall())


def test_native_queries_run_no_python(spark):
    for name in ("op1_quality_rules", "op10_decontamination"):
        text = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert not any(w in text for w in ("Python", "Pandas", "Arrow"))


def test_sharding_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries()["op4_sharding"](spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_little_text_is_written_by_few_tasks(spark):
    """Shards of little text have no file for each shuffle partition, and whole rows."""
    keys = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    docs = spark.createDataFrame([(i, f"text {i % 700}") for i in range(2000)], "doc_id long, text string")
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = sharding.shard(docs)
        # two tasks per core, each with rows of every shard at most
        assert len(found.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism * 8 < 96
        rows = found.collect()
        assert sorted((r.doc_id, r.text) for r in rows) == [(i, f"text {i % 700}") for i in range(2000)]
        assert sorted((r.shard, r.slot) for r in rows) == [(s, k) for s in range(8) for k in range(250)]
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_token_file_query(spark):
    docs = key_order([(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()])
    rows = sorted(queries()["op7_token_files"](spark, SF).collect(), key=lambda r: r.doc_id)
    at = 0
    for r, ids in zip(rows, encoded([t for _, t in docs], 2)):
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), brute.crc_ids(ids))
        at += len(ids)


def test_passage_digest_of_nothing():
    assert brute.repeats_digest([""])[0][2] == hashlib.sha256(b"").hexdigest()


def test_connected_components(spark):
    from weblytics.llm.graph import connected_components

    path = [(i, i + 1) for i in range(100, 160)]
    star = [(7, i) for i in range(1000, 1100)]
    ring = [(-5, -4), (-4, -3), (-3, -5), (2, 2)]
    df = spark.createDataFrame(path + star + ring + path[:5], "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in (7, *range(1000, 1100))} | {i: -5 for i in (-5, -4, -3)}
    assert got == want
    assert connected_components(df.limit(0)).count() == 0


def test_components_of_few_edges_take_few_tasks(spark):
    """A round over few edges does not take a task for each shuffle partition."""
    from weblytics.llm import graph

    keys = {"spark.sql.shuffle.partitions": "96", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in keys}
    edges = spark.createDataFrame([(i, i + 1 + i % 3) for i in range(0, 900, 3)], "a long, b long")
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        found = graph.connected_components(edges)
        few = 2 * spark.sparkContext.defaultParallelism
        # the stored last round has a file for each task that held edges
        assert len(found.inputFiles()) <= few < 96
        assert found.count() == found.select("node").distinct().count() == 600
        assert graph.tasks_for(edges, 300) == few and graph.tasks_for(edges, 10 ** 9) == 96
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_toxicity_cross_validation_stays_inside_its_rows():
    """Each row is judged by a model that has not seen it, options are comparable."""
    import numpy as np
    rng = np.random.default_rng(3)
    rows = []
    for i in range(300):
        label = int(i % 4 == 0)
        words = rng.integers(0, 900, 20)
        rows.append((label, np.unique(np.concatenate([words, [1000 + rng.integers(0, 4)] if label else [1]]).astype(np.int64))))
    options = [toxicity.ToxicityOptions(bucket_bits=12, epochs=e, l1=l) for e, l in ((4, 1.0), (1, 500.0))]
    good, blind = toxicity.cross_validate(rows, 1 / 4, options)
    assert good["loss"] < blind["loss"] and good["recall"] > 0.9 and good["false_positives"] < 0.05
    noise = [(int(rng.integers(0, 2)), index) for _, index in rows]
    assert toxicity.cross_validate(noise, 0.5, options[:1])[0]["loss"] > 0.6
