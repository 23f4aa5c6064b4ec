"""Toxicity scores by FTRL-proximal logistic regression.

A text is the set of its hashed features: words, pairs of neighbours and pairs
with one word between them (A-Z folded, words are runs of ASCII letters, digits
and other characters' bytes).  The per-coordinate learning rates and the L1
term of FTRL-proximal leave few weights different from zero; only those are
broadcast.

The classifier is fitted in numpy on a sample of labelled rows, ``max_rows`` at
most, half of them of each label where there are enough (a hash of key and text
decides); the intercept is then corrected for the labels' true shares.

Edge cases: NULL and empty texts have no features and get the score of the
intercept; rows without a label are scored but never learnt from; a document
with several labels counts once for each; without labelled rows every
score is 0.5; an empty table gives no rows; repeated rows score alike.  Input
columns named like output columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, extended, map_arrow, store
from weblytics.llm.hashing import FOLD_AZ, Words, batches_of, mix, text_buffer, word_class, words_of


@dataclass(frozen=True)
class ToxicityOptions:
    bucket_bits: int = 20
    max_rows: int = 12_000
    epochs: int = 6
    alpha: float = 3.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    threshold: float = 0.7
    seed: int = 5


def features(words: Words, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word position) of every feature of a batch of documents."""
    h = words.hashes
    shift = np.uint64(64 - bits)
    buckets, places = [(h >> shift)], [np.arange(len(h))]
    # last word of each position's document
    last = np.repeat(words.first[1:], np.diff(words.first)) - 1
    for step, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        if len(h) <= step:
            continue
        both = mix(h[:-step] * np.uint64(salt) + h[step:])
        inside = np.flatnonzero(np.arange(len(h) - step) + step <= last[:-step])
        buckets.append(both[inside] >> shift)
        places.append(inside)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(places)


@dataclass
class ToxicityModel:
    index: np.ndarray
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, column) -> np.ndarray:
        dense = np.zeros(1 << self.bits, dtype=np.float64)
        dense[self.index] = self.weights
        out = np.full(len(column), self.bias)
        for a, b in batches_of(column, 2 << 20):
            words = words_of(*text_buffer(column.slice(a, b - a)), word_class("alnum"), FOLD_AZ)
            bucket, place = features(words, self.bits)
            hit = np.flatnonzero(dense[bucket] != 0)
            if len(hit):
                doc = np.searchsorted(words.first, place[hit], side="right") - 1
                # a feature counts once per document
                pair = np.unique(doc << self.bits | bucket[hit])
                np.add.at(out, a + (pair >> self.bits), dense[pair & ((1 << self.bits) - 1)])
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def sample_features(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, opt: ToxicityOptions):
    """(sampled rows as (label, buckets), share of label 1 among all rows).

    Keys and labels are joined and drawn first, without the texts but with their
    hashes; the rows drawn, ``max_rows`` at most, then meet the documents."""
    ids = docs.select(F.col(f"`{key}`").alias("__id"), F.xxhash64(F.col(f"`{text}`")).alias("__text"))
    right = labels.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{label}`").cast("int").alias("label"))
    # a label that is there several times counts once
    right = right.filter(F.col("label").isin(0, 1)).distinct()
    eligible = ids.join(right, F.col("__id") == F.col("__key"))
    counts = {r[0]: r[1] for r in eligible.groupBy("label").count().collect()}
    if not counts:
        return [], 0.5
    limit = F.when(F.col("label") == 1, F.lit(min(1.0, opt.max_rows / 2 / counts.get(1, 1)))).otherwise(
        F.lit(min(1.0, opt.max_rows / 2 / counts.get(0, 1))))
    draw = F.pmod(F.xxhash64(F.lit(opt.seed), "__id", "__text"), F.lit(1 << 30)) / float(1 << 30)
    # rows that agree in all of this are one row of the sample, with their number
    chosen = store(eligible.filter(draw < limit).groupBy("__id", "__text", "label", (draw / limit).alias("draw"))
                   .agg(F.count(F.lit(1)).alias("n")).orderBy("draw", "label", "__id", "__text").limit(opt.max_rows),
                   "labelled-sample")
    # at most max_rows rows
    sample = (docs.select(F.col(f"`{key}`").alias("__doc"), F.xxhash64(F.col(f"`{text}`")).alias("__hash"),
                          F.col(f"`{text}`").alias("text"))
              .join(F.broadcast(chosen), (F.col("__doc") == F.col("__id")) & F.col("__hash").eqNullSafe(F.col("__text")))
              .select("draw", "label", "text", "__id", "__text").dropDuplicates(["draw", "label", "__id", "__text"])
              .select("draw", "label", "text"))

    def run(batches):
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                words = words_of(*text_buffer(batch.column(2).slice(i, 1)), word_class("alnum"), FOLD_AZ)
                rows.append(np.unique(features(words, opt.bucket_bits)[0]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["draw", "label", "buckets"])

    rows = map_arrow(sample, run, "draw double, label int, buckets binary").collect()
    rows.sort(key=lambda r: (r["draw"], r["label"], r["buckets"]))
    share = counts.get(1, 0) / sum(counts.values())
    return [(r["label"], np.frombuffer(r["buckets"], "<u4").astype(np.int64)) for r in rows], share


def train(rows: list, share: float, opt: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """FTRL-proximal over the rows, the last coordinate is the intercept."""
    size = 1 << opt.bucket_bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    own = np.array([size])

    def weights(zi: np.ndarray, ni: np.ndarray, free: np.ndarray) -> np.ndarray:
        l1 = np.where(free, 0.0, opt.l1)
        l2 = np.where(free, 0.0, opt.l2)
        w = -(zi - np.sign(zi) * l1) / ((opt.beta + np.sqrt(ni)) / opt.alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    rng = np.random.default_rng(opt.seed)
    for _ in range(opt.epochs):
        for i in rng.permutation(len(rows)).tolist():
            label, index = rows[i]
            index = np.concatenate([index, own])
            zi, ni = z[index], n[index]
            w = weights(zi, ni, index == size)
            error = 1 / (1 + np.exp(-np.clip(w.sum(), -60, 60))) - label
            grown = ni + error * error
            z[index] = zi + error - (np.sqrt(grown) - np.sqrt(ni)) / opt.alpha * w
            n[index] = grown
    w = weights(z, n, np.arange(size + 1) == size)
    bias = float(w[size])
    seen = sum(label for label, _ in rows)
    if 0 < seen < len(rows) and 0 < share < 1:
        bias += np.log(share / (1 - share)) - np.log(seen / (len(rows) - seen))
    used = np.flatnonzero(w[:size])
    return ToxicityModel(used, w[used], float(bias), opt.bucket_bits)


def cross_validate(rows: list, share: float, options: list[ToxicityOptions], folds: int = 3) -> list[dict]:
    """For each set of options, over folds of the learning rows alone: mean log loss (rows
    weighted to the labels' true shares), recall and false positive rate at the
    threshold.  The defaults were chosen by the least loss of a grid."""
    out = []
    for opt in options:
        loss, weight, hit, wrong, count = 0.0, 0.0, 0, 0, [0, 0]
        for k in range(folds):
            model = train([r for i, r in enumerate(rows) if i % folds != k], share, opt)
            dense = np.zeros(1 << opt.bucket_bits)
            dense[model.index] = model.weights
            held = rows[k::folds]
            ones = sum(label for label, _ in held)
            each = {1: share / max(ones, 1), 0: (1 - share) / max(len(held) - ones, 1)}
            for label, index in held:
                p = 1 / (1 + np.exp(-np.clip(model.bias + dense[index].sum(), -60, 60)))
                loss -= each[label] * np.log(max(p if label else 1 - p, 1e-12))
                weight += each[label]
                count[label] += 1
                hit += int(label == 1 and p >= opt.threshold)
                wrong += int(label == 0 and p >= opt.threshold)
        out.append({"options": opt, "loss": float(loss / max(weight, 1e-12)), "recall": hit / max(count[1], 1),
                    "false_positives": wrong / max(count[0], 1)})
    return out


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
        opt: ToxicityOptions = ToxicityOptions()) -> ToxicityModel:
    """Fit on the documents that have a label."""
    return train(*sample_features(docs, labels, key, text, label, opt), opt)


def predict(docs: DataFrame, model: ToxicityModel, text: str = "text", keep_text: bool = True,
            opt: ToxicityOptions = ToxicityOptions()) -> DataFrame:
    """``docs`` plus ``score`` and ``predicted`` (1 from ``threshold`` on)."""
    docs = drop_names(docs, ("score", "predicted"))
    # at most 2^bucket_bits weights
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        for batch in batches:
            score = shared.value.score(batch.column(batch.schema.get_field_index(text)))
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(score), pa.array((score >= opt.threshold).astype(np.int32))],
                [*kept, "score", "predicted"])

    return map_arrow(docs, run, extended(docs.select(*[F.col(f"`{c}`") for c in kept]),
                                         "score double, predicted int"))
