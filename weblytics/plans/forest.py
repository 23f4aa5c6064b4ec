"""Forests with penalised leaves, grown in rounds until the loss stops falling.

The options Spark ML's forest lacks: L1 and L2 on the leaf weights, a minimum
split loss, and early stopping by relative progress.

Every tree fits the loss's gradient at the constant score ``base``: with ``n``
rows and ``pos`` positives in a node, ``G = base n - pos`` and
``H = base (1 - base) n``; a leaf weighs ``-soft(G, l1) / (H + l2)`` and a split
gains ``(s(left) + s(right) - s(node)) / 2`` with ``s = soft(G, l1)^2 / (H + l2)``.
The forest's log odds are the mean of its trees' leaves plus those of ``base``.

One job per level grows all trees of a round:

1. features become bins (quantiles of the fit part, one byte each; bin 0 is a
   missing value), stored once with the label and a hash of the row;
2. each task walks its rows down the trees so far and counts rows and positives
   per (tree, node, feature, bin) with numpy: integers, so partial histograms
   merge exactly, in any order;
3. the merged histograms give running sums over bins and the best split per
   node, by window and aggregate.  What reaches the driver is one row per node.

A tree's sample is a hash of (row, tree), so retried tasks count the same rows.
After each round the held-out loss of the forest so far decides whether another
round is grown.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed
from ..functions.sampling import row_key
from ..operators import evaluation
from ..operators.features import CATEGORICAL, KEY
from ..session import materialise, path_exists, ship, work_dir
from ..sources import versions
from . import ml


@dataclass(frozen=True)
class ForestOptions:
    """``trees_per_round`` trees are grown at a time, at most ``max_trees``.
    Growing stops after the first round whose loss is not at least ``min_rel_progress``
    below the one before; a round that raised the loss is dropped."""

    max_trees: int = fixed.FOREST_TREES
    trees_per_round: int = 10
    max_depth: int = fixed.FOREST_DEPTH
    subsample: float = fixed.FOREST_SUBSAMPLE
    l1: float = fixed.FOREST_L1
    l2: float = fixed.FOREST_L2
    min_split_loss: float = fixed.FOREST_MIN_SPLIT_GAIN
    min_child_weight: float = 1.0
    early_stop: bool = True
    min_rel_progress: float = fixed.FOREST_MIN_REL_PROGRESS
    base: float = 0.5
    max_bins: int = 64
    eval_fraction: float = fixed.EVAL_FRACTION
    split_seed: int = 7
    seed: int = 42


# ---------------------------------------------------------------------------
# features
# ---------------------------------------------------------------------------
def numeric_columns(df: DataFrame, names: list[str]) -> dict[str, Column]:
    """Name -> double: numbers and flags, the parts of dates, the shares of
    categories (``ml.with_categories``)."""
    kinds, out = dict(df.dtypes), {}
    for name in names:
        if name in CATEGORICAL:
            out[f"{name}__share"] = F.col(f"{name}__share").cast("double")
        elif kinds[name] == "date":
            for part, of in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("weekday", F.dayofweek)):
                out[f"{name}__{part}"] = of(F.col(name)).cast("double")
        else:
            out[name] = F.col(name).cast("double")
    return out


def cut_points(df: DataFrame, columns: list[str], max_bins: int) -> list[list[float]]:
    """Distinct quantiles of every column: a value's bin is 1 + the cuts below it."""
    shares = [k / max_bins for k in range(1, max_bins)]
    found = df.approxQuantile(columns, shares, 1 / (4 * max_bins))
    return [sorted(set(x)) for x in found]


def _bins(values: np.ndarray, cuts: list[float]) -> np.ndarray:
    out = np.searchsorted(np.asarray(cuts, dtype=np.float64), values, side="left") + 1
    out[np.isnan(values)] = 0
    return out.astype(np.uint8)


def _matrix(batch: pa.RecordBatch, column: str, cuts: list[list[float]]) -> np.ndarray:
    """Bins of an array<double> column, rows x features; NULL is missing."""
    flat = batch.column(batch.schema.get_field_index(column)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(cuts))
    return np.column_stack([_bins(values[:, f], c) for f, c in enumerate(cuts)]) if cuts else values.astype(np.uint8)


def binned(df: DataFrame, cuts: list[list[float]], kept: list[str]) -> DataFrame:
    """``kept`` columns plus ``bins`` (one byte per feature) of rows that have
    ``values`` (array<double>)."""
    ship(df.sparkSession)
    schema = T.StructType([*df.select(*kept).schema.fields, T.StructField("bins", T.BinaryType())])

    def run(batches):
        for batch in batches:
            rows = _matrix(batch, "values", cuts)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
            bins = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(rows.tobytes())])
            yield pa.RecordBatch.from_arrays([*arrays, bins], [*kept, "bins"])

    return df.select(*kept, "values").mapInArrow(run, schema)


def _bin_matrix(batch: pa.RecordBatch, n_features: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("bins")).cast(pa.binary())
    size = len(column) * n_features
    if not size:
        return np.zeros((len(column), n_features), np.uint8)
    _, ends, raw = column.buffers()
    first = np.frombuffer(ends, np.int32)[column.offset]
    return np.frombuffer(raw, np.uint8, count=size, offset=int(first)).reshape(-1, n_features)


CHUNK_ROWS = 100_000   # rows whose bins a task counts at a time


def _chunks(batches, n_features: int):
    """(bins, row, label) of at most ``CHUNK_ROWS`` rows: a count over many rows
    costs one histogram per chunk, not one per Arrow batch."""
    held, n = [], 0

    def joined():
        return tuple(np.concatenate(parts) for parts in zip(*held))

    for batch in batches:
        row, label = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("row", "label"))
        if held and n + len(row) > CHUNK_ROWS:
            yield joined()
            held, n = [], 0
        held.append((_bin_matrix(batch, n_features), row, label.astype(np.int64)))
        n += len(row)
    if held:
        yield joined()


# ---------------------------------------------------------------------------
# trees
# ---------------------------------------------------------------------------
@dataclass
class Tree:
    """Nodes in order of creation; a leaf has ``feature`` -1.  Rows whose bin is
    at most ``split`` go left."""

    feature: list[int] = field(default_factory=lambda: [-1])
    split: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    weight: list[float] = field(default_factory=lambda: [0.0])

    def divide(self, node: int, feature: int, split: int) -> tuple[int, int]:
        self.feature[node], self.split[node] = feature, split
        self.left[node], self.right[node] = len(self.feature), len(self.feature) + 1
        for column, value in ((self.feature, -1), (self.split, 0), (self.left, 0), (self.right, 0), (self.weight, 0.0)):
            column.extend([value, value])
        return self.left[node], self.right[node]

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The node each row of a bin matrix ends in."""
        feature, split, left, right = (np.asarray(c) for c in (self.feature, self.split, self.left, self.right))
        at = np.zeros(len(bins), np.int64)
        flat = np.ascontiguousarray(bins).ravel()
        # the rows that still walk, their nodes, and where their bins begin
        rows, node = np.arange(len(bins)), np.zeros(len(bins), np.int64)
        while True:
            of = feature[node]
            inner = of >= 0
            if not inner.all():
                at[rows[~inner]] = node[~inner]
                rows, node, of = rows[inner], node[inner], of[inner]
            if not len(rows):
                return at
            node = np.where(flat[rows * bins.shape[1] + of] <= split[node], left[node], right[node])


def _drawn(row: np.ndarray, tree: int, opt: ForestOptions) -> np.ndarray:
    """Which rows are in a tree's sample: a hash of (row, tree, seed)."""
    x = row.view(np.uint64) ^ np.uint64(((tree + 1) * 0x9E3779B97F4A7C15 + opt.seed * 0xD6E8FEB86659FD95) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) < opt.subsample * 2.0 ** 53


def soft(g, l1: float):
    """Soft threshold of a gradient sum."""
    return math.copysign(max(abs(g) - l1, 0.0), g)


def leaf_weight(n: int, pos: int, opt: ForestOptions) -> float:
    g, h = opt.base * n - pos, opt.base * (1 - opt.base) * n
    return -soft(g, opt.l1) / (h + opt.l2) if h + opt.l2 > 0 else 0.0


def histograms(rows: DataFrame, trees: dict[int, Tree], open_nodes: dict[int, list[int]], n_features: int,
               opt: ForestOptions) -> DataFrame:
    """(tree, node, feature, bin, n, pos) of the rows of every open node."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast((trees, open_nodes, opt))
    width = opt.max_bins + 1

    def run(batches):
        trees_, open_, options = shared.value
        counts: dict[int, np.ndarray] = {}
        for bins, row, label in _chunks(batches, n_features):
            by_feature = np.ascontiguousarray(bins.T)
            for t, nodes in open_.items():
                place = np.full(len(trees_[t].feature), -1, np.int64)
                place[nodes] = np.arange(len(nodes))
                local = place[trees_[t].leaf_of(bins)]
                use = np.flatnonzero((local >= 0) & _drawn(row, t, options))
                # one cell per (feature, node, bin, label); a feature's cells at a time
                cell = local[use] * (width * 2) + label[use]
                if t not in counts:
                    counts[t] = np.zeros((n_features, len(nodes) * width * 2), np.int64)
                for f in range(n_features):
                    counts[t][f] += np.bincount(cell + by_feature[f][use].astype(np.int64) * 2, minlength=len(nodes) * width * 2)
        for t, flat in counts.items():
            shaped = flat.reshape(n_features, len(open_[t]), width, 2)
            feature, node, bin_ = np.nonzero(shaped.sum(axis=3))
            cells = shaped[feature, node, bin_]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(node), t)), pa.array(np.asarray(open_[t])[node]), pa.array(feature), pa.array(bin_),
                 pa.array(cells.sum(axis=1)), pa.array(cells[:, 1])],
                ["tree", "node", "feature", "bin", "n", "pos"])

    emitted = rows.mapInArrow(run, "tree long, node long, feature long, bin long, n long, pos long")
    return emitted.groupBy("tree", "node", "feature", "bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))


def best_splits(hist: DataFrame, opt: ForestOptions) -> DataFrame:
    """One row per (tree, node): its rows and positives, and the best split (gain
    NULL if none is allowed).  Ties go to the smaller feature, then bin."""
    group = Window.partitionBy("tree", "node", "feature")
    upto = group.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = hist.select("tree", "node", "feature", "bin", F.sum("n").over(upto).alias("nl"), F.sum("pos").over(upto).alias("pl"),
                       F.sum("n").over(group).alias("n"), F.sum("pos").over(group).alias("pos"))

    def h(n: Column) -> Column:
        return F.lit(opt.base * (1 - opt.base)) * n

    def score(n: Column, pos: Column) -> Column:
        g = F.abs(F.lit(opt.base) * n - pos)
        return F.pow(F.greatest(g - F.lit(opt.l1), F.lit(0.0)), F.lit(2.0)) / (h(n) + F.lit(opt.l2))

    n, pos, nl, pl = (F.col(c) for c in ("n", "pos", "nl", "pl"))
    gain = (score(nl, pl) + score(n - nl, pos - pl) - score(n, pos)) / 2
    allowed = (h(nl) >= opt.min_child_weight) & (h(n - nl) >= opt.min_child_weight) & (gain > opt.min_split_loss)
    ranked = sums.withColumn("gain", F.when(allowed, F.round(gain, 9)))
    best = F.max_by(F.struct("feature", "bin", "gain", "nl", "pl"),
                    F.struct(F.coalesce("gain", F.lit(-1.0)), -F.col("feature"), -F.col("bin")))
    return ranked.groupBy("tree", "node").agg(F.max("n").alias("n"), F.max("pos").alias("pos"), best.alias("best")).select(
        "tree", "node", "n", "pos", "best.*")


def grow(rows: DataFrame, first: int, count: int, n_features: int, opt: ForestOptions) -> dict[int, Tree]:
    """Trees ``first`` .. ``first + count - 1`` over binned rows (row, label, bins)."""
    trees = {t: Tree() for t in range(first, first + count)}
    open_nodes = {t: [0] for t in trees}
    for depth in range(opt.max_depth + 1):
        if not open_nodes:
            break
        following: dict[int, list[int]] = {}
        # one row per open node; nodes are numbered in this order, whatever the tasks' was
        found = best_splits(histograms(rows, trees, open_nodes, n_features, opt), opt).collect()
        for r in sorted(found, key=lambda r: (r.tree, r.node)):
            tree = trees[r.tree]
            tree.weight[r.node] = leaf_weight(r.n, r.pos, opt)
            if depth < opt.max_depth and r.gain is not None:
                left, right = tree.divide(r.node, r.feature, r.bin)
                following.setdefault(r.tree, []).extend([left, right])
        open_nodes = {t: sorted(nodes) for t, nodes in following.items()}
    return trees


# ---------------------------------------------------------------------------
# the forest
# ---------------------------------------------------------------------------
@dataclass
class Forest:
    """Trees, the cuts of their features, and the category dictionary."""

    trees: list[Tree]
    names: list[str]
    inputs: list[str]
    cuts: list[list[float]]
    base: float
    words: DataFrame | None = None

    def values(self, df: DataFrame, fold: str | None = None) -> DataFrame:
        """``df`` plus ``values``, the numeric features in order."""
        prepared = ml.Classifier(None, self.words).prepared(df, fold)
        columns = numeric_columns(prepared, self.inputs)
        return prepared.select(*[F.col(f"`{c}`") for c in df.columns], F.array(*columns.values()).alias("values"))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """``df`` plus ``p``, the probability of label 1."""
        ship(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.trees, self.cuts, self.base))
        source = self.values(df).select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("input"), "values")

        def run(batches):
            trees, cuts, base = shared.value
            for batch in batches:
                bins = _matrix(batch, "values", cuts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(forest_probability(trees, bins, base))], ["input", "p"])

        schema = T.StructType([source.schema["input"], T.StructField("p", T.DoubleType())])
        return source.mapInArrow(run, schema).select("input.*", "p")


def forest_probability(trees: list[Tree], bins: np.ndarray, base: float) -> np.ndarray:
    margin = np.full(len(bins), math.log(base / (1 - base)))
    if trees:
        margin += sum(np.asarray(t.weight)[t.leaf_of(bins)] for t in trees) / len(trees)
    return 1 / (1 + np.exp(-margin))


def held_out_loss(rows: DataFrame, trees: list[Tree], n_features: int, base: float) -> float:
    """Mean log loss of the trees' forest over binned rows (label, bins)."""
    ship(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        total, n = 0.0, 0
        for batch in batches:
            p = np.clip(forest_probability(shared.value, _bin_matrix(batch, n_features), base), evaluation.EPS, 1 - evaluation.EPS)
            y = batch.column(batch.schema.get_field_index("label")).to_numpy()
            total -= float(np.sum(np.where(y == 1, np.log(p), np.log(1 - p))))
            n += len(y)
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n])], ["loss", "n"])

    r = rows.mapInArrow(run, "loss double, n long").agg(F.sum("loss").alias("loss"), F.sum("n").alias("n")).first()
    return r.loss / r.n if r.n else 0.0


ROUNDS = "round int, trees long, loss double, rel_progress double, kept boolean"


def fit(features_df: DataFrame, opt: ForestOptions = ForestOptions()) -> tuple[Forest, list[tuple]]:
    """The forest of a feature set, and (round, trees, loss, relative progress, kept)
    of every round (round 0: the constant score)."""
    inputs = ml.feature_columns(features_df)
    spec = ml.ModelSpec("forest", "forest", eval_fraction=opt.eval_fraction, split_seed=opt.split_seed)
    keyed = (features_df.withColumn("_eval", ml.eval_part(features_df, spec))
             .withColumn("_row", F.xxhash64(row_key(KEY, features_df.columns))))
    data = materialise(keyed.withColumn("_fold", ml.fold_of(features_df)), "forest-data")
    fit_rows = data.where(~F.col("_eval"))
    cats = [c for c in inputs if c in CATEGORICAL]
    words = materialise(ml.dictionary(fit_rows.drop("_eval", "_row", "_fold"), cats), "categories") if cats else None

    forest = Forest([], [], inputs, [], opt.base, words)
    # fit rows take their shares from the other folds, held-out rows from all
    crossed = ml.Classifier(None, words).prepared(fit_rows, "_fold")
    plain = ml.Classifier(None, words).prepared(data.where("_eval"))
    numbers = numeric_columns(crossed, inputs)
    forest.names = list(numbers)
    wide = materialise(crossed.unionByName(plain).select(
        F.col("_row").alias("row"), F.col("label").cast("long").alias("label"), "_eval",
        *[c.alias(n) for n, c in numbers.items()]), "forest-values")
    forest.cuts = cut_points(wide.where(~F.col("_eval")), forest.names, opt.max_bins)
    rows = materialise(binned(wide.select("row", "label", "_eval", F.array(*[F.col(f"`{n}`") for n in forest.names]).alias("values")),
                              forest.cuts, ["row", "label", "_eval"]), "forest-bins")
    fitted, held = rows.where(~F.col("_eval")), rows.where("_eval")

    n = len(forest.names)
    before = held_out_loss(held, [], n, opt.base)
    rounds = [(0, 0, before, None, True)]
    while len(forest.trees) < opt.max_trees:
        count = min(opt.trees_per_round, opt.max_trees - len(forest.trees))
        more = grow(fitted, len(forest.trees), count, n, opt)
        grown = [*forest.trees, *more.values()]
        loss = held_out_loss(held, grown, n, opt.base)
        progress = (before - loss) / before if before > 0 else 0.0
        stop = opt.early_stop and progress < opt.min_rel_progress
        kept = not (stop and loss > before)
        rounds.append((len(rounds), len(grown), loss, progress, kept))
        if kept:
            forest.trees = grown
        if stop:
            break
        before = loss
    return forest, rounds


def score(forest: Forest, df: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """As ``ml.score``: input columns, ``predicted_label_probs`` (label 1 first),
    ``predicted_probability`` and ``predicted_label``."""
    pairs = F.array(F.struct(F.lit(1).cast("long").alias("label"), F.col("p").alias("prob")),
                    F.struct(F.lit(0).cast("long").alias("label"), (1 - F.col("p")).alias("prob")))
    return (forest.probabilities(df).withColumn("predicted_label_probs", pairs)
            .withColumn("predicted_probability", F.col("p")).drop("p")
            .withColumn("predicted_label", evaluation.predict_at("predicted_probability", threshold)))


# ---------------------------------------------------------------------------
# store
# ---------------------------------------------------------------------------
NODES = "tree long, node long, feature long, split long, left long, right long, weight double"
CUTS = "position long, name string, cuts array<double>"


def save(forest: Forest, spark: SparkSession, path: str, replace_present: bool = True) -> None:
    """A version of ``path`` with the nodes, the cuts and the dictionary."""
    folder = versions.new_folder(path)
    nodes = [(t, k, int(tree.feature[k]), int(tree.split[k]), int(tree.left[k]), int(tree.right[k]), float(tree.weight[k]))
             for t, tree in enumerate(forest.trees) for k in range(len(tree.feature))]
    spark.createDataFrame(nodes, NODES).write.parquet(f"{folder}/nodes")
    spark.createDataFrame(list(zip(range(len(forest.names)), forest.names, forest.cuts)), CUTS).write.parquet(f"{folder}/cuts")
    spark.createDataFrame([(forest.base, forest.inputs)], "base double, inputs array<string>").write.parquet(f"{folder}/forest")
    if forest.words is not None:
        forest.words.write.parquet(f"{folder}/categories")
    versions.commit(spark, path, folder, replace_present)


def load(spark: SparkSession, path: str) -> Forest:
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no forest at {path}")
    about = spark.read.parquet(f"{folder}/forest").first()
    cuts = spark.read.schema(CUTS).parquet(f"{folder}/cuts").orderBy("position").collect()
    trees: dict[int, Tree] = {}
    # at most max_trees x 2^(max_depth + 1) rows
    for r in spark.read.schema(NODES).parquet(f"{folder}/nodes").orderBy("tree", "node").collect():
        tree = trees.setdefault(r.tree, Tree([], [], [], [], []))
        for column, value in zip((tree.feature, tree.split, tree.left, tree.right, tree.weight),
                                 (r.feature, r.split, r.left, r.right, r.weight)):
            column.append(value)
    words = None
    if path_exists(spark, f"{folder}/categories/_SUCCESS"):
        words = spark.read.schema(ml.WORDS).parquet(f"{folder}/categories")
    return Forest(list(trees.values()), [c.name for c in cuts], list(about.inputs), [list(c.cuts) for c in cuts], about.base, words)


FORESTS = {"enriched": ForestOptions(), "history": replace(ForestOptions(), min_rel_progress=fixed.FOREST_DEFAULT_REL_PROGRESS)}


def model_path(spark: SparkSession, key: str, name: str) -> str:
    """Where the forest of feature set ``name`` is stored: the path carries the data,
    the code and the options."""
    return f"{work_dir(spark)}/weblytics/models/{key}/forest-{name}-{ml.code_version()}-{ml.digest_of(FORESTS[name], __file__)}"


def load_or_fit(spark: SparkSession, features_df: DataFrame, name: str, key: str) -> Forest:
    path = model_path(spark, key, name)
    if versions.current(spark, path) is None:
        save(fit(features_df, FORESTS[name])[0], spark, path)
    return load(spark, path)
