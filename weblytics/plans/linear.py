"""Logistic regression with L1 and L2 by proximal gradient and line search.

The tuned logistic model names its search (a line search that starts at 0.01) and
both penalties.  The fit minimises

    mean log loss  +  l1 |w|_1  +  l2 / 2 |w|_2^2

over standardised numbers and one weight per category value (no penalty on the
intercept); ``penalty="sum"`` adds the penalties to the summed loss instead, that is
divides both by the number of rows.

An iteration proposes several steps at once along the proximal gradient: the
spectral step of the last move (at first ``start``) and fractions of it.  One
aggregate over all rows gives loss and gradient at every proposal; the longest
step is taken that stays sufficiently below the worst of the last ``memory``
objectives (a spectral step may rise for a moment).  The fit ends when no
coordinate of the penalised gradient (the smallest subgradient) exceeds
``tolerance``; the point with the least objective is kept.

Rows stay in a stored table of category positions and numbers; a pass adds up per
task and then per coordinate.  The driver holds one number per kept category
value, as any logistic model does.  Weights are stored in the category
dictionary, so scoring is joins and arithmetic on the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluation
from ..operators.features import CATEGORICAL
from ..session import materialise, ship, work_dir
from ..sources import versions
from . import ml


@dataclass(frozen=True)
class LineSearchOptions:
    l1: float = fixed.EXTENDED_L1
    l2: float = fixed.EXTENDED_L2
    penalty: str = "mean"               # or "sum"
    max_iter: int = fixed.EXTENDED_MAX_ITER
    start: float = fixed.LINE_SEARCH_START
    tolerance: float = 1e-6
    fractions: tuple[float, ...] = (1.0, 0.25, 1 / 16, 1 / 256, 1 / 4096)
    memory: int = 8


# ---------------------------------------------------------------------------
# design rows
# ---------------------------------------------------------------------------
@dataclass
class Design:
    """Stored rows (label, numbers, places) and what their coordinates mean:
    0 is the intercept, then the numbers, then category values."""

    rows: DataFrame
    numbers: list[str]
    means: list[float]
    scales: list[float]
    cats: list[str]
    offsets: dict[str, int]
    size: int
    words: DataFrame | None


def numbers_of(df: DataFrame, names: list[str]) -> dict:
    kinds, out = dict(df.dtypes), {}
    for name in names:
        if name in CATEGORICAL:
            continue
        if kinds[name] == "date":
            for part, of in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("weekday", F.dayofweek)):
                out[f"{name}__{part}"] = of(F.col(name)).cast("double")
        else:
            out[name] = F.col(name).cast("double")
    return out


def _standardised(columns: dict, means: list[float], scales: list[float]):
    """A missing number counts as the mean."""
    return F.array(*[F.coalesce((c - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, m, s in zip(columns.values(), means, scales)]
                   ).cast("array<double>")


def design(fit_rows: DataFrame) -> Design:
    # read several times: statistics, dictionary, rows
    fit_rows = materialise(fit_rows, "fit-rows")
    names = ml.feature_columns(fit_rows)
    cats = sorted(c for c in names if c in CATEGORICAL)
    columns = numbers_of(fit_rows, names)
    words = materialise(ml.dictionary(fit_rows, cats), "categories") if cats else None
    means, scales = [], []
    if columns:
        r = fit_rows.agg(*[x for n, c in columns.items() for x in (F.avg(c).alias(f"m_{n}"), F.stddev_pop(c).alias(f"s_{n}"))]).first()
        means = [r[f"m_{n}"] or 0.0 for n in columns]
        scales = [r[f"s_{n}"] or 1.0 for n in columns]
    offsets, size = {}, 1 + len(columns)
    if words is not None:
        # one row per categorical feature
        longest = {r.feature: r.n for r in words.groupBy("feature").agg(F.max("idx").alias("n")).collect()}
        for c in cats:
            offsets[c] = size
            size += longest[c] + 1
    known = ml.Classifier(None, words).prepared(fit_rows)
    places = F.array(*[(F.lit(offsets[c]) + F.col(f"{c}__idx")).cast("int") for c in cats]).cast("array<int>")
    rows = materialise(known.select(F.col("label").cast("double").alias("label"),
                                    _standardised(columns, means, scales).alias("numbers"), places.alias("places")), "design")
    return Design(rows, list(columns), means, scales, cats, offsets, size, words)


# ---------------------------------------------------------------------------
# loss and gradient
# ---------------------------------------------------------------------------
def losses(d: Design, points: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(rows, summed log loss per point, summed gradient per point) in one pass."""
    ship(d.rows.sparkSession)
    n_numbers, n_cats, size = len(d.numbers), len(d.cats), d.size
    shared = d.rows.sparkSession.sparkContext.broadcast(points)

    def run(batches):
        w = shared.value
        loss, gradient, n = np.zeros(len(w)), np.zeros((len(w), size)), 0
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in ("label", "numbers", "places")}
            y = column["label"].to_numpy()
            x = column["numbers"].flatten().to_numpy().reshape(len(y), n_numbers)
            at = column["places"].flatten().to_numpy().reshape(len(y), n_cats)
            n += len(y)
            for k in range(len(w)):
                margin = w[k, 0] + x @ w[k, 1:1 + n_numbers] + w[k][at].sum(axis=1)
                loss[k] += float(np.sum(np.logaddexp(0.0, margin) - y * margin))
                rest = 1 / (1 + np.exp(-margin)) - y
                gradient[k, 0] += rest.sum()
                gradient[k, 1:1 + n_numbers] += x.T @ rest
                if n_cats:
                    gradient[k] += np.bincount(at.ravel(), weights=np.repeat(rest, n_cats), minlength=size)
        # coordinate -1 carries the loss, -2 the rows
        for k in range(len(w)):
            used = np.flatnonzero(gradient[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(used) + 2, k)), pa.array(np.concatenate([used, [-1, -2]])),
                 pa.array(np.concatenate([gradient[k][used], [loss[k], float(n)]]))], ["point", "at", "value"])

    summed = d.rows.mapInArrow(run, "point long, at long, value double").groupBy("point", "at").agg(F.sum("value").alias("value"))
    loss, gradient, n = np.zeros(len(points)), np.zeros((len(points), size)), 0.0
    for r in summed.collect():
        if r.at == -1:
            loss[r.point] = r.value
        elif r.at == -2:
            n = r.value
        else:
            gradient[r.point, r.at] = r.value
    return n, loss, gradient


def subgradient(w: np.ndarray, gradient: np.ndarray, l1: float) -> np.ndarray:
    """The smallest subgradient of the penalised loss, given the smooth part's."""
    out = gradient + l1 * np.sign(w)
    flat = w == 0
    out[flat] = np.sign(gradient[flat]) * np.maximum(np.abs(gradient[flat]) - l1, 0)
    out[0] = gradient[0]
    return out


@dataclass
class Fitted:
    design: Design
    weights: np.ndarray
    rounds: list[tuple]                 # (iteration, step, objective, penalised gradient)


ROUNDS = "iteration int, step double, objective double, penalised_gradient double"


def fit(fit_rows: DataFrame, opt: LineSearchOptions = LineSearchOptions()) -> Fitted:
    if opt.penalty not in ("mean", "sum"):
        raise ValueError("penalty must be 'mean' or 'sum'")
    d = design(fit_rows)
    w = np.zeros(d.size)
    n, loss, gradient = losses(d, w[None, :])
    if not n:
        return Fitted(d, w, [])
    l1, l2 = (p / n if opt.penalty == "sum" else p for p in (opt.l1, opt.l2))
    free = np.ones(d.size)
    free[0] = 0.0                       # the intercept bears no penalty

    def smooth(w_, loss_, gradient_):
        return loss_ / n + l2 / 2 * float((free * w_) @ w_), gradient_ / n + l2 * free * w_

    f, g = smooth(w, loss[0], gradient[0])
    step, rounds = opt.start, []

    def objective(w_, f_):
        return float(f_ + l1 * np.abs(free * w_).sum())

    rounds.append((0, None, objective(w, f), float(np.abs(subgradient(w, g, l1)).max())))
    least = (rounds[0][2], w)
    while len(rounds) <= opt.max_iter and rounds[-1][3] > opt.tolerance:
        steps = [step * k for k in opt.fractions]
        moved = [w - t * g for t in steps]
        points = np.array([np.where(free > 0, np.sign(m) * np.maximum(np.abs(m) - t * l1, 0), m) for m, t in zip(moved, steps)])
        _, loss, gradient = losses(d, points)
        taken = None
        for t, z, lo, gr in zip(steps, points, loss, gradient):
            fz, gz = smooth(z, lo, gr)
            worst = max(r[2] for r in rounds[-opt.memory:])
            if objective(z, fz) <= worst - 0.01 / (2 * t) * float((z - w) @ (z - w)) + 1e-14:
                taken = (t, z, fz, gz)
                break
        if taken is None:
            step = steps[-1] / 4
            if step < 1e-12:
                break
            continue
        t, z, fz, gz = taken
        s, change = z - w, gz - g
        curvature = float(s @ change)
        step = float(s @ s) / curvature if curvature > 0 else t
        w, f, g = z, fz, gz
        rounds.append((len(rounds), t, objective(w, f), float(np.abs(subgradient(w, g, l1)).max())))
        least = min(least, (rounds[-1][2], w), key=lambda x: x[0])
    return Fitted(d, least[1], rounds)


# ---------------------------------------------------------------------------
# coefficients, scores, store
# ---------------------------------------------------------------------------
COEFFICIENTS = "key string, feature string, value string, mean double, scale double, weight double"


def coefficients(spark: SparkSession, fitted: Fitted, weights: np.ndarray | None = None) -> DataFrame:
    """(key, feature, value, mean, scale, weight): the intercept (no key, feature
    ``(intercept)``), numbers (no key) and category values."""
    d, w = fitted.design, fitted.weights if weights is None else weights
    rows = [(None, "(intercept)", None, 0.0, 1.0, float(w[0]))]
    rows += [(None, n, None, float(m), float(s), float(v)) for n, m, s, v in zip(d.numbers, d.means, d.scales, w[1:])]
    own = spark.createDataFrame(rows, COEFFICIENTS)
    if d.words is None:
        return own
    at = spark.createDataFrame([(c, o) for c, o in d.offsets.items()], "feature string, first long")
    flat = spark.createDataFrame([(int(k), float(v)) for k, v in enumerate(w)], "at long, weight double")
    known = (d.words.where(F.col("key").isNotNull()).join(F.broadcast(at), "feature")
             .withColumn("at", F.col("first") + F.col("idx")).join(flat, "at")
             .select("key", "feature", "value", F.lit(0.0).alias("mean"), F.lit(1.0).alias("scale"), "weight"))
    return own.unionByName(known)


def probabilities(table: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` plus ``p`` by a stored coefficient table.  Unseen values weigh nothing."""
    # one row per number of the feature set
    own = {r.feature: r for r in table.where(F.col("key").isNull()).collect()}
    names = ml.feature_columns(df)
    cats = sorted(c for c in names if c in CATEGORICAL)
    margin = F.lit(own["(intercept)"].weight)
    for name, c in numbers_of(df, names).items():
        if name in own:
            r = own[name]
            margin = margin + F.coalesce((c - F.lit(r["mean"])) / F.lit(r.scale), F.lit(0.0)) * F.lit(r.weight)
    out = df.withColumn("_margin", margin)
    values = table.where(F.col("key").isNotNull()).select(F.col("key").alias("_key"), F.col("weight").alias("_weight"))
    for c in cats:
        out = (out.join(values, ml.value_key(c, F.col(c).cast("string")) == F.col("_key"), "left")
               .withColumn("_margin", F.col("_margin") + F.coalesce("_weight", F.lit(0.0))).drop("_key", "_weight"))
    return out.withColumn("p", 1 / (1 + F.exp(-F.col("_margin")))).drop("_margin")


def score(table: DataFrame, df: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    return (probabilities(table, df).withColumnRenamed("p", "predicted_probability")
            .withColumn("predicted_label", evaluation.predict_at("predicted_probability", threshold)))


def model_path(spark: SparkSession, key: str, name: str, opt: LineSearchOptions) -> str:
    return f"{work_dir(spark)}/weblytics/models/{key}/linear-{name}-{ml.code_version()}-{ml.digest_of(opt, __file__)}"


def save(table: DataFrame, path: str, replace: bool = True) -> None:
    spark = table.sparkSession
    folder = versions.new_folder(path)
    table.write.parquet(f"{folder}/coefficients")
    versions.commit(spark, path, folder, replace)


def load(spark: SparkSession, path: str) -> DataFrame:
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no model at {path}")
    return spark.read.schema(COEFFICIENTS).parquet(f"{folder}/coefficients")


def load_or_fit(spark: SparkSession, fit_rows: DataFrame, name: str, key: str,
                opt: LineSearchOptions = LineSearchOptions()) -> DataFrame:
    path = model_path(spark, key, name, opt)
    if versions.current(spark, path) is None:
        save(coefficients(spark, fit(fit_rows, opt)), path)
    return load(spark, path)
