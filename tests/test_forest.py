"""Penalised forests against a brute-force tree, early stopping, storing."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from weblytics.plans import forest as R
from weblytics.plans import ml
from weblytics.plans.catalogue import feature_set
from weblytics.sources import versions


def table(spark, n, noise=False, seed=5):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, os = rng.random(), rng.gauss(0, 1), rng.choice(["a", "b", "c", None])
        p = 0.5 if noise else 1 / (1 + math.exp(-(6 * x - 3 + (os == "a") - y)))
        rows.append((f"s{i}", int(rng.random() < p), x, None if i % 11 == 0 else y, i % 5, os))
    return spark.createDataFrame(rows, "unique_session_id string, label long, x double, y double, hits long, os string")


def plain_tree(bins, labels, use, opt, depth=0):
    """(leaf weights by row) of the best-first-by-gain tree, by trying every split."""
    n, pos = int(use.sum()), int(labels[use].sum())

    def s(n, pos):
        g, h = 0.5 * n - pos, 0.25 * n
        return max(abs(g) - opt.l1, 0) ** 2 / (h + opt.l2)

    g = 0.5 * n - pos
    weight = -math.copysign(max(abs(g) - opt.l1, 0), g) / (0.25 * n + opt.l2)
    out = np.zeros(len(labels))
    best = None
    if depth < opt.max_depth:
        for f in range(bins.shape[1]):
            for b in sorted(set(bins[use, f].tolist())):
                left = use & (bins[:, f] <= b)
                nl, pl = int(left.sum()), int(labels[left].sum())
                if 0.25 * nl < opt.min_child_weight or 0.25 * (n - nl) < opt.min_child_weight:
                    continue
                gain = (s(nl, pl) + s(n - nl, pos - pl) - s(n, pos)) / 2
                if gain > opt.min_split_loss and (best is None or round(gain, 9) > best[0]):
                    best = (round(gain, 9), f, b)
    if best is None:
        out[use] = weight
        return out
    left = use & (bins[:, best[1]] <= best[2])
    return plain_tree(bins, labels, left, opt, depth + 1) + plain_tree(bins, labels, use & ~left, opt, depth + 1)


@pytest.mark.parametrize("opt", [R.ForestOptions(max_depth=4, subsample=0.8, l1=0.4, l2=0.7, max_bins=16),
                                 R.ForestOptions(max_depth=3, subsample=1.0, l1=0.0, l2=0.0, min_split_loss=1.5, max_bins=8)])
def test_leaf_weights_equal_a_brute_force_tree(spark, opt):
    df = table(spark, 500).select("unique_session_id", "label", "x", "y", F.col("hits").cast("double").alias("h"))
    names = ["x", "y", "h"]
    wide = df.select(F.xxhash64("unique_session_id").alias("row"), "label", F.array(*names).alias("values")).repartition(5)
    cuts = R.cut_points(df, names, opt.max_bins)
    rows = R.binned(wide, cuts, ["row", "label"]).persist()
    trees = R.grow(rows, 0, 3, 3, opt)
    data = rows.collect()
    bins = np.array([list(r.bins) for r in data], np.uint8)
    values = {r.row: r["values"] for r in wide.collect()}
    for r, b in zip(data, bins):       # a bin holds the values up to its cut; 0 is missing
        for v, k, c in zip(values[r.row], b, cuts):
            assert (k == 0) == (v is None)
            assert v is None or (k == 1 or c[k - 2] < v) and (k == len(c) + 1 or v <= c[k - 1])
    labels = np.array([r.label for r in data])
    ids = np.array([r.row for r in data], np.int64)
    for t, tree in trees.items():
        use = R._drawn(ids, t, opt)
        assert 0.7 * 500 < use.sum() <= 500
        want = plain_tree(bins, labels, use, opt)
        got = np.asarray(tree.weight)[tree.leaf_of(bins)]
        assert np.allclose(got[use], want[use], atol=1e-12)
    rows.unpersist()


def test_rounds_stop_and_learn(spark):
    opt = R.ForestOptions(max_trees=30, trees_per_round=5, max_depth=4)
    fitted, rounds = R.fit(table(spark, 3000), opt)
    losses = [r[2] for r in rounds]
    assert losses[0] == pytest.approx(math.log(2)) and losses[1] < 0.62
    assert len(rounds) < 8 and rounds[-1][3] < opt.min_rel_progress         # stopped by its own rule
    scored = R.score(fitted, table(spark, 1000, seed=9))
    from weblytics.operators import evaluation
    assert evaluation.evaluate(scored).first().roc_auc > 0.75
    all_rounds = R.fit(table(spark, 600), R.ForestOptions(max_trees=15, trees_per_round=5, max_depth=2, early_stop=False))[1]
    assert [r[1] for r in all_rounds] == [0, 5, 10, 15]


def test_noise_labels_stop_at_once(spark):
    fitted, rounds = R.fit(table(spark, 1500, noise=True), R.ForestOptions(trees_per_round=5, max_depth=4))
    assert len(rounds) <= 3 and not rounds[-1][4] or abs(rounds[-1][2] - math.log(2)) < 0.03
    assert len(fitted.trees) <= 10


def test_stored_forest_scores_alike_and_rows_stay(spark, store):
    opt = R.ForestOptions(max_trees=4, trees_per_round=2, max_depth=5)
    fitted, _ = R.fit(feature_set(store, "history", "train"), opt)
    path = f"{R.model_path(spark, 'test', 'history')}-{uuid.uuid4().hex}"
    R.save(fitted, spark, path, replace_present=False)
    with pytest.raises(versions.AlreadyPresent):
        R.save(fitted, spark, path, replace_present=False)
    test = feature_set(store, "history", "test", for_scoring=True)
    a = R.score(fitted, test)
    b = R.score(R.load(spark, path), test)
    assert a.columns == [*test.columns, "predicted_label_probs", "predicted_probability", "predicted_label"]
    key = ["fullVisitorId", "visitId", "predicted_probability"]
    assert a.count() == test.count()
    assert sorted(map(tuple, a.select(*key).collect()), key=str) == sorted(map(tuple, b.select(*key).collect()), key=str)


def test_same_trees_whatever_the_partitions(spark):
    opt = R.ForestOptions(max_depth=5)
    df = table(spark, 800).select(F.xxhash64("unique_session_id").alias("row"), "label",
                                  F.array("x", "y", F.col("hits").cast("double")).alias("values"))
    cuts = [[k / 20 for k in range(20)], [-1.0, 0.0, 1.0], [0.0, 1.0, 2.0, 3.0]]
    rows = R.binned(df, cuts, ["row", "label"])
    one, two = (R.grow(rows.repartition(n), 0, 3, 3, opt) for n in (1, 7))
    assert one == two


def test_empty_and_single_class(spark):
    df = table(spark, 300)
    none, rounds = R.fit(df.limit(0), R.ForestOptions(max_depth=2, max_trees=2, trees_per_round=2))
    assert len(rounds) >= 1
    assert R.score(none, df).count() == 300
    ones, _ = R.fit(df.withColumn("label", F.lit(1).cast("long")), R.ForestOptions(max_depth=2, max_trees=2, trees_per_round=2))
    assert R.score(ones, df).agg(F.min("predicted_label")).first()[0] == 1
    assert ml.FOLDS == 5


def test_many_arrow_batches_are_counted_together(monkeypatch):
    import pyarrow as pa
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 65, (1000, 4)).astype(np.uint8)
    whole = pa.RecordBatch.from_arrays([pa.array(np.arange(1000)), pa.array(np.arange(1000) % 2),
                                        pa.array([b.tobytes() for b in bins], pa.binary())], ["row", "label", "bins"])
    batches = [whole.slice(k, 10) for k in range(0, 1000, 10)]
    assert len(list(R._chunks(iter(batches), 4))) == 1
    monkeypatch.setattr(R, "CHUNK_ROWS", 300)
    chunks = list(R._chunks(iter(batches), 4))
    assert [len(c[0]) for c in chunks] == [300, 300, 300, 100]
    assert np.array_equal(np.concatenate([c[0] for c in chunks]), bins)
    assert np.concatenate([c[1] for c in chunks]).tolist() == list(range(1000))
    # an uneven tree: every row ends where a walk of its own ends
    tree = R.Tree()
    for node in (0, 1, 4):
        tree.divide(node, node % 4, 30)

    def walk(row, at=0):
        while tree.feature[at] >= 0:
            at = (tree.left if row[tree.feature[at]] <= tree.split[at] else tree.right)[at]
        return at

    assert tree.leaf_of(bins).tolist() == [walk(b) for b in bins]
    assert tree.leaf_of(bins[:0]).tolist() == []
