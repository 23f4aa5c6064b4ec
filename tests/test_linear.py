"""Line-search logistic regression: optimum, gradient, penalties, scores."""

import math
import random
import uuid

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from weblytics.plans import linear as L
from weblytics.sources import versions


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(2)
    rows = []
    for i in range(500):
        os, x, y = rng.choice(["a", "b", "", None]), rng.gauss(3, 2), rng.random()
        p = 1 / (1 + math.exp(-(x - 3 + 1.5 * (os == "a") - 2 * y)))
        rows.append((f"s{i}", int(rng.random() < p), x, None if i % 9 == 0 else y, i % 2 == 0, os))
    return spark.createDataFrame(rows, "unique_session_id string, label long, x double, y double, flag boolean, os string").repartition(4)


def matrix(d):
    rows = d.rows.collect()
    x = np.zeros((len(rows), d.size))
    x[:, 0] = 1
    for i, r in enumerate(rows):
        x[i, 1:1 + len(d.numbers)] = r.numbers
        x[i, r.places] = 1
    return x, np.array([r.label for r in rows])


def test_loss_and_gradient_equal_plain_numpy(spark, table):
    d = L.design(table)
    x, y = matrix(d)
    points = np.random.default_rng(1).normal(size=(3, d.size))
    n, loss, gradient = L.losses(d, points)
    assert n == 500
    for w, lo, gr in zip(points, loss, gradient):
        p = 1 / (1 + np.exp(-x @ w))
        assert lo == pytest.approx(-np.sum(y * np.log(p) + (1 - y) * np.log(1 - p)))
        assert np.allclose(gr, x.T @ (p - y))


@pytest.mark.parametrize("penalty", ["mean", "sum"])
def test_penalised_gradient_vanishes(spark, table, penalty):
    opt = L.LineSearchOptions(penalty=penalty, max_iter=200)
    fitted = L.fit(table, opt)
    assert fitted.rounds[-1][3] <= 1e-6
    objective = [r[2] for r in fitted.rounds]
    assert objective[-1] <= min(objective) + 1e-9 and fitted.rounds[1][1] <= opt.start
    # against the optimum's conditions in plain numpy
    x, y = matrix(fitted.design)
    n, w = len(y), fitted.weights
    l1, l2 = (v / n if penalty == "sum" else v for v in (opt.l1, opt.l2))
    g = x.T @ (1 / (1 + np.exp(-x @ w)) - y) / n
    assert abs(g[0]) < 2e-6
    for k in range(1, len(w)):
        if w[k]:
            assert abs(g[k] + l2 * w[k] + l1 * np.sign(w[k])) < 2e-6
        else:
            assert abs(g[k]) <= l1 + 2e-6
    if penalty == "mean":
        assert (w[1:] == 0).sum() > (L.fit(table, L.LineSearchOptions(penalty="sum", max_iter=60)).weights[1:] == 0).sum()


def test_the_mean_scale_is_that_of_spark_ml(spark, table):
    """Literal penalties on the mean loss: the mapping ``regParam = l1 + l2``."""
    opt = L.LineSearchOptions(max_iter=200)
    fitted = L.fit(table, opt)
    d = fitted.design
    x, y = matrix(d)
    df = spark.createDataFrame([(float(b), [float(v) for v in a[1:]]) for a, b in zip(x, y)], "label double, v array<double>")
    reg = opt.l1 + opt.l2
    model = LogisticRegression(regParam=reg, elasticNetParam=opt.l1 / reg, standardization=False, maxIter=500, tol=1e-12).fit(
        df.select("label", array_to_vector("v").alias("features")))
    assert np.allclose(model.coefficients.toArray(), fitted.weights[1:], atol=1e-4)
    assert model.intercept == pytest.approx(fitted.weights[0], abs=1e-4)


def test_scores_by_joins_equal_the_design(spark, table):
    fitted = L.fit(table, L.LineSearchOptions(max_iter=30))
    path = f"{L.model_path(spark, 'test', 'x', L.LineSearchOptions())}-{uuid.uuid4().hex}"
    L.save(L.coefficients(spark, fitted), path, replace=False)
    with pytest.raises(versions.AlreadyPresent):
        L.save(L.coefficients(spark, fitted), path, replace=False)
    stored = L.load(spark, path)
    x, y = matrix(fitted.design)
    want = sorted(np.round(1 / (1 + np.exp(-x @ fitted.weights)), 9).tolist())
    got = sorted(round(r.p, 9) for r in L.probabilities(stored, table).select("p").collect())
    assert np.allclose(got, want, atol=2e-9)
    new = table.withColumn("os", F.lit("never seen")).withColumn("x", F.lit(None).cast("double"))
    assert L.score(stored, new).where(F.col("predicted_probability").isNull()).count() == 0


def test_empty_table_and_unknown_penalty(spark, table):
    assert L.fit(table.limit(0)).rounds == []
    with pytest.raises(ValueError):
        L.fit(table, L.LineSearchOptions(penalty="both"))
