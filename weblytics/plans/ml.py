"""Training, storing, loading and scoring the four classifiers with Spark ML.

A stored model is a ``PipelineModel`` plus a category dictionary, so scoring
applies exactly what training learned:

1. the dictionary, one row per (feature, value) of the fit part with its index
   and shares of positives, made by distributed aggregation and kept as Parquet
   beside the pipeline.  One table keyed by feature and value serves the joins
   of all features, so a small one is broadcast once.  All values are kept;
   unseen, NULL and empty values have indices of their own.  A forest is fitted
   on cross-fitted shares: a row's share of a value counts the other folds
   only, never its own label;
2. ``SQLTransformer``: booleans and dates become numbers, nullable numbers get
   a ``_missing`` flag; ``Imputer`` (mean) for nullable numbers;
3. logistic regression: sparse one-hot vectors of the indices.  Forests: the
   share of positives of the value, an ordered number, so the number of bins
   does not follow the number of values;
4. ``VectorAssembler`` and the classifier.

Nothing collects values to the driver; what a logistic model holds there is
its coefficient vector, one entry per kept value.  The feature table is written
once (Parquet in the shared work folder) before fitting.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import columns, fixed, sampling
from ..functions.sampling import hash_hex8, in_eval_split, row_key
from ..operators import evaluation, features, history, metrics
from ..operators.features import CATEGORICAL, KEY
from ..session import app_id, materialise, path_exists, work_dir
from ..sources import versions

UNSEEN_INDEX, NULL_INDEX, EMPTY_INDEX, FIRST_INDEX = 0, 1, 2, 3
RANK_BUCKETS = 64
ROWS_PER_TASK = 200_000   # rows that one task of a fit holds
JOINS_TOGETHER = 4        # dictionary joins in one piece of generated code
FOLDS = 5            # folds of the cross-fitted shares
FOLD_SEED = 11
WORDS = "key string, feature string, value string, idx long, share double, fold_shares array<double>"
SMOOTHING = 20.0   # rows of the overall share that every value's share starts from


@dataclass
class ModelSpec:
    """What to train.  ``l1`` / ``l2`` are the penalty options of the
    original logistic model; they map to Spark's ``regParam = l1 + l2`` and
    ``elasticNetParam = l1 / (l1 + l2)``."""
    name: str
    kind: str                      # "logistic" or "forest"
    max_iter: int = fixed.LOGISTIC_MAX_ITER
    l1: float = 0.0
    l2: float = 0.0
    num_trees: int = fixed.FOREST_TREES
    max_depth: int = fixed.FOREST_DEPTH
    subsample: float = fixed.FOREST_SUBSAMPLE
    min_info_gain: float = fixed.FOREST_MIN_SPLIT_GAIN
    eval_fraction: float = fixed.EVAL_FRACTION
    seed: int = 42
    # the split draw must be independent of the class-balancing draw (which
    # uses seed 42 on the same session): with one seed, every kept negative would
    # also fall below the eval threshold and the fit part would hold no negative
    split_seed: int = 7
    extra: dict = field(default_factory=dict)


MODELS = {
    "basic": ModelSpec("basic", "logistic"),
    "extended": ModelSpec("extended", "logistic", max_iter=fixed.EXTENDED_MAX_ITER,
                          l1=fixed.EXTENDED_L1, l2=fixed.EXTENDED_L2),
    "enriched": ModelSpec("enriched", "forest"),
    "history": ModelSpec("history", "forest"),
}


# ---------------------------------------------------------------------------
# categories
# ---------------------------------------------------------------------------
def category_counts(df: DataFrame, cols: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """(feature, value, n_rows, positives) of every value of every categorical
    feature, NULL included: one job, partial aggregation in the scan tasks.
    ``by``: columns of ``df`` to count by as well."""
    pairs = df.select("label", *by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])).alias("p"))
    return pairs.groupBy("p.feature", "p.value", *by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"))


def fold_of(df: DataFrame) -> Column:
    """Fold (0 to ``FOLDS`` - 1) of a row, by its session id or, where that is
    NULL, by the whole row."""
    drawn = F.conv(hash_hex8(row_key(KEY, df.columns), FOLD_SEED), 16, 10).cast("long")
    return (drawn % FOLDS).cast("int")


def _smoothed(positives: Column, n_rows: Column, overall: float) -> Column:
    return (positives + SMOOTHING * overall) / (n_rows + SMOOTHING)


def fold_shares(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, value, fold, n_rows, positives, share): rows and positives of each
    value in a fold, and its smoothed share of positives in the other folds."""
    overall = df.agg(F.avg("label")).first()[0] or 0.0
    counts = category_counts(df.withColumn("fold", fold_of(df)), cols, by=("fold",))
    # at most FOLDS rows per value
    value = Window.partitionBy("feature", "value")
    others = [F.sum(c).over(value) - F.col(c) for c in ("positives", "n_rows")]
    return counts.withColumn("share", _smoothed(*others, overall))


def value_key(feature: str | Column, value: Column) -> Column:
    """The dictionary key of a value; NULL has one that no text has."""
    name = F.lit(feature) if isinstance(feature, str) else feature
    return F.concat(name, F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value)))


def dictionary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(key, feature, value, idx, share, fold_shares): dense indices per feature
    without a task that holds a whole feature (rank inside a hash bucket, plus the
    rows of the buckets before it), the smoothed share of positives over all
    folds, and for each fold that of the others.  The row of a feature's
    unseen values has no key."""
    overall = df.agg(F.avg("label")).first()[0] or 0.0
    folded = df.withColumn("fold", fold_of(df)) if KEY in df.columns else df.withColumn("fold", F.lit(0))
    by_fold = category_counts(folded, cols, by=("fold",))
    n, positives = F.sum("n_rows"), F.sum("positives")
    own = [(F.sum(F.when(F.col("fold") == k, F.col("positives")).otherwise(0)),
            F.sum(F.when(F.col("fold") == k, F.col("n_rows")).otherwise(0))) for k in range(FOLDS)]
    # read three times: ranks, bucket sizes, special values
    counts = materialise(by_fold.groupBy("feature", "value").agg(
        _smoothed(positives, n, overall).alias("share"),
        F.array(*[_smoothed(positives - p, n - m, overall) for p, m in own]).alias("fold_shares")), "category-counts")
    plain = counts.where(F.col("value").isNotNull() & (F.col("value") != "")).withColumn(
        "bucket", F.pmod(F.xxhash64("value"), F.lit(RANK_BUCKETS)))
    # at most RANK_BUCKETS rows per feature
    sizes = plain.groupBy("feature", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("feature").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("feature", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("feature", "bucket").orderBy("value")
    shares = ["share", "fold_shares"]
    ranked = plain.withColumn("rank", F.row_number().over(inside)).join(offsets, ["feature", "bucket"]).select(
        "feature", "value", (F.col("rank") + F.col("offset") + FIRST_INDEX - 1).cast("long").alias("idx"), *shares)
    special = counts.where(F.col("value").isNull() | (F.col("value") == "")).select(
        "feature", "value", F.when(F.col("value").isNull(), NULL_INDEX).otherwise(EMPTY_INDEX).cast("long").alias("idx"),
        *shares)
    unseen = df.sparkSession.createDataFrame([(c,) for c in cols], "feature string").select(
        F.lit(None).cast("string").alias("key"), "feature", F.lit(None).cast("string").alias("value"),
        F.lit(UNSEEN_INDEX).cast("long").alias("idx"), F.lit(float(overall)).alias("share"),
        F.array(*[F.lit(float(overall))] * FOLDS).alias("fold_shares"))
    known = ranked.unionByName(special).select(
        value_key(F.col("feature"), F.col("value")).alias("key"), "feature", "value", "idx", *shares)
    return known.unionByName(unseen)


def _apart(df: DataFrame) -> DataFrame:
    """The same rows; the code that Spark generates for the steps before does not
    run on into the steps after.  (Row counts are observed between the two, a step
    without generated code.)  The joins of all features and the pipeline in one
    method are over the 8,000 bytes that the JVM compiles, and run interpreted."""
    return df.observe(f"prepared-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("n_rows"))


def with_categories(df: DataFrame, words: DataFrame, cols: list[str], overall: float,
                    fold: str | None = None) -> DataFrame:
    """``df`` plus ``<feature>__idx`` and ``<feature>__share``.  ``fold``: a column
    with the fold of each row, whose share is then that of the other folds."""
    share = F.col("share") if fold is None else F.col("fold_shares")
    # the same right side for every feature: one exchange serves all joins
    own = words.where(F.col("key").isNotNull()).select(
        F.col("key").alias("_key"), F.col("idx").cast("double").alias("_idx"), share.alias("_share"))
    for i, c in enumerate(cols, start=1):
        value = F.col(c).cast("string")
        reserved: Column = F.when(value.isNull(), NULL_INDEX).when(value == "", EMPTY_INDEX).otherwise(UNSEEN_INDEX)
        known = F.col("_share") if fold is None else F.get("_share", F.col(fold))
        df = (df.join(own, value_key(c, value) == F.col("_key"), "left")
              .withColumn(f"{c}__idx", F.coalesce("_idx", reserved.cast("double")))
              .withColumn(f"{c}__share", F.coalesce(known, F.lit(overall)))
              .drop("_key", "_idx", "_share"))
        if i % JOINS_TOGETHER == 0 or i == len(cols):
            df = _apart(df)
    return df


# ---------------------------------------------------------------------------
# input preparation
# ---------------------------------------------------------------------------
def _q(name: str) -> str:
    return f"`{name}`"


def _prepare_sql(names: list[str], dtypes: dict[str, str], nullable_numeric: list[str],
                 all_null: set[str]) -> tuple[str, list[str]]:
    """SELECT statement of the SQLTransformer and the numeric columns it outputs."""
    sel, numeric = ["*"], []
    for f in names:
        t = dtypes[f]
        if f in CATEGORICAL:
            continue
        if t == "date":
            for part, fn in (("year", "year"), ("month", "month"), ("day", "dayofmonth"),
                             ("weekday", "dayofweek")):
                sel.append(f"CAST({fn}({_q(f)}) AS DOUBLE) AS {_q(f + '__' + part)}")
                numeric.append(f"{f}__{part}")
        else:
            expr = f"CAST({_q(f)} AS DOUBLE)"
            if f in all_null:
                expr = "CAST(0.0 AS DOUBLE)"
            sel.append(f"{expr} AS {_q(f + '__num')}")
            numeric.append(f"{f}__num")
            if f in nullable_numeric:
                sel.append(f"CAST(({_q(f)} IS NULL) AS DOUBLE) AS {_q(f + '__missing')}")
                numeric.append(f"{f}__missing")
    return f"SELECT {', '.join(sel)} FROM __THIS__", numeric


def build_pipeline(train: DataFrame, names: list[str], spec: ModelSpec) -> Pipeline:
    """Pipeline over rows that ``with_categories`` has prepared."""
    dtypes = dict(train.dtypes)
    cats = [f for f in names if f in CATEGORICAL]
    nums = [f for f in names if f not in CATEGORICAL and dtypes[f] != "date"]
    # one pass: NULL count of every numeric feature
    nulls = train.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in nums],
                      F.count(F.lit(1)).alias("__n")).first() if nums else None
    nullable = [f for f in nums if nulls and nulls[f] > 0]
    all_null = {f for f in nums if nulls and nulls[f] == nulls["__n"]}

    statement, numeric = _prepare_sql(names, dtypes, nullable, all_null)
    stages = [SQLTransformer(statement=statement)]
    impute = [f"{f}__num" for f in nullable if f not in all_null]
    if impute:
        stages.append(Imputer(strategy="mean", inputCols=impute,
                              outputCols=[c + "_imp" for c in impute]))
    numeric = [c + "_imp" if c in impute else c for c in numeric]
    if spec.kind == "logistic":
        ohe = [f"{f}__ohe" for f in cats]
        if cats:
            stages.append(OneHotEncoder(inputCols=[f"{f}__idx" for f in cats], outputCols=ohe,
                                        handleInvalid="keep", dropLast=True))
        stages.append(VectorAssembler(inputCols=numeric + ohe, outputCol="features"))
        reg = spec.l1 + spec.l2
        stages.append(LogisticRegression(
            featuresCol="features", labelCol="label", maxIter=spec.max_iter,
            regParam=reg, elasticNetParam=(spec.l1 / reg) if reg > 0 else 0.0,
            standardization=True, **spec.extra))
    else:
        stages.append(VectorAssembler(inputCols=numeric + [f"{f}__share" for f in cats], outputCol="features"))
        stages.append(RandomForestClassifier(
            featuresCol="features", labelCol="label", numTrees=spec.num_trees,
            maxDepth=spec.max_depth, minInfoGain=spec.min_info_gain,
            subsamplingRate=spec.subsample, seed=spec.seed,
            # deep trees: keep each row's node id cached between levels and
            # cut that lineage every 10 iterations (in the shared work folder)
            cacheNodeIds=True, checkpointInterval=10, **spec.extra))
    return Pipeline(stages=stages)


# ---------------------------------------------------------------------------
# train / score / store
# ---------------------------------------------------------------------------
class Classifier:
    """A fitted pipeline and the category dictionary it was fitted with."""

    def __init__(self, pipeline: PipelineModel, words: DataFrame | None = None):
        self.pipeline = pipeline
        self.words = words
        self.cats: list[str] = []
        self.overall = 0.0
        if words is not None:
            # one row per categorical feature
            rows = words.where(F.col("key").isNull()).select("feature", "share").collect()
            self.cats = sorted(r["feature"] for r in rows)
            self.overall = rows[0]["share"] if rows else 0.0

    def prepared(self, df: DataFrame, fold: str | None = None) -> DataFrame:
        return df if self.words is None else with_categories(df, self.words, self.cats, self.overall, fold)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.pipeline.transform(self.prepared(df))


def feature_columns(df: DataFrame) -> list[str]:
    skip = {KEY, "label", "fullVisitorId", "visitId"}
    return [c for c in df.columns if c not in skip]


def score(model: Classifier | PipelineModel, df: DataFrame, threshold: float = fixed.THRESHOLD) -> DataFrame:
    """Input columns plus ``predicted_label_probs`` (array of (label, prob),
    label 1 first), ``predicted_probability`` (its first element: the
    probability of label 1) and ``predicted_label``."""
    out = model.transform(df)
    probs = vector_to_array("probability")
    pairs = F.array(
        F.struct(F.lit(1).cast("long").alias("label"), probs[1].alias("prob")),
        F.struct(F.lit(0).cast("long").alias("label"), probs[0].alias("prob")),
    )
    return (out.select(*df.columns, pairs.alias("predicted_label_probs"))
            .withColumn("predicted_probability", F.col("predicted_label_probs")[0]["prob"])
            .withColumn("predicted_label", evaluation.predict_at("predicted_probability", threshold)))


@dataclass
class Trained:
    model: Classifier
    summary: DataFrame


def eval_part(df: DataFrame, spec: ModelSpec) -> Column:
    """Whether a row of a feature set is in the evaluation part: by its session
    id, or by the whole row where that is NULL.  Every row is in one part."""
    return in_eval_split(spec.eval_fraction, spec.split_seed, key=row_key(KEY, df.columns))


def in_tasks(df: DataFrame, n_rows: int) -> DataFrame:
    """``df`` of ``n_rows`` rows, dealt over more tasks where they are many: a few
    compressed files otherwise make a few tasks, whose vectors grow with the input."""
    if n_rows <= ROWS_PER_TASK:
        return df
    return df.repartition(max(-(-n_rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism))


def split_summary(df: DataFrame, spec: ModelSpec) -> DataFrame:
    """Rows and positives of both parts."""
    return df.groupBy(F.when(eval_part(df, spec), "eval").otherwise("fit").alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"))


def train(spark: SparkSession, features_df: DataFrame, spec: ModelSpec,
          threshold: float = fixed.THRESHOLD) -> Trained:
    """Random train / eval split (repeatable, by session key), fit on the
    train part, evaluate on the eval part."""
    names = feature_columns(features_df)
    data = materialise(features_df.withColumn("_eval", eval_part(features_df, spec)), "training")
    fit_rows = data.where(~F.col("_eval")).drop("_eval")
    eval_rows = data.where("_eval").drop("_eval")
    cats = [f for f in names if f in CATEGORICAL]
    words = materialise(dictionary(fit_rows, cats), "categories") if cats else None
    # rows to fit on take their shares from the other folds
    folded = fit_rows.withColumn("_fold", fold_of(fit_rows))
    prepared = in_tasks(Classifier(None, words).prepared(folded, "_fold").drop("_fold"), fit_rows.count())
    # read by the null counts and by several jobs of the fit
    prepared.persist(StorageLevel.MEMORY_AND_DISK)
    model = Classifier(build_pipeline(prepared, names, spec).fit(prepared), words)
    prepared.unpersist()
    metrics_row = evaluation.evaluate(score(model, eval_rows, threshold))
    counts = data.agg(F.count_if(~F.col("_eval")).alias("n_train"), F.count_if("_eval").alias("n_eval"))
    summary = counts.select(
        F.lit(spec.name).alias("model"), F.lit(spec.kind).alias("model_type"), "n_train", "n_eval",
        F.lit(len(names)).cast("long").alias("n_features"))
    m = metrics_row.first()
    for name in metrics_row.columns:
        summary = summary.withColumn(name, F.lit(m[name]).cast("double"))
    return Trained(model, summary)


def fixed_score_model(spark: SparkSession, df: DataFrame) -> Classifier:
    """A model-free ``PipelineModel`` whose probability of label 1 is
    ``(1 + hits) / (6 + hits)``: scoring and publishing can be checked by SQL."""
    stages = [SQLTransformer(statement="SELECT *, CAST(5 AS DOUBLE) / (hits + 6) AS `_p0`, "
                                       "CAST(hits + 1 AS DOUBLE) / (hits + 6) AS `_p1` FROM __THIS__"),
              VectorAssembler(inputCols=["_p0", "_p1"], outputCol="probability")]
    return Classifier(Pipeline(stages=stages).fit(df))


def code_version() -> str:
    """Digest of the code that stored models depend on."""
    text = "".join(inspect.getsource(m) for m in (columns, fixed, sampling, features, history, metrics))
    text += inspect.getsource(inspect.getmodule(code_version))
    return hashlib.sha1(text.encode()).hexdigest()[:10]


def digest_of(options, *files: str) -> str:
    """Digest of a model's options and of more code files it depends on."""
    text = repr(options) + "".join(open(f).read() for f in files)
    return hashlib.sha1(text.encode()).hexdigest()[:8]


def model_path(spark: SparkSession, key: str, name: str) -> str:
    """Where model ``name`` trained on data ``key`` is stored; the path also
    carries a digest of the code and one of the model's options."""
    spec = MODELS.get(name)
    digest = hashlib.sha1(repr(spec).encode()).hexdigest()[:8] if spec else "custom"
    return f"{work_dir(spark)}/weblytics/models/{key}/{name}-{code_version()}-{digest}"


# models loaded by this application, by path (a forest is many small files)
_LOADED: dict[tuple[str, str], Classifier] = {}


def _app() -> str:
    spark = SparkSession.getActiveSession()
    return app_id(spark) if spark is not None else ""


def save(model: Classifier, path: str, replace: bool = True) -> None:
    """``CREATE OR REPLACE MODEL`` (replace) / ``CREATE MODEL`` (``AlreadyPresent``
    if there is one).  The model is a version of ``path``: it is in force once its
    marker is written, and a writer that dies leaves the one before."""
    spark = SparkSession.getActiveSession()
    if not replace and versions.current(spark, path) is not None:
        raise versions.AlreadyPresent(path)
    folder = versions.new_folder(path)
    model.pipeline.write().save(f"{folder}/pipeline")
    if model.words is not None:
        model.words.select(*[f.name for f in T.StructType.fromDDL(WORDS)]).write.parquet(f"{folder}/categories")
    versions.commit(spark, path, folder, replace)


def load(path: str) -> Classifier:
    """The model in force at ``path``."""
    spark = SparkSession.getActiveSession()
    folder = versions.current(spark, path)
    if folder is None:
        raise FileNotFoundError(f"no model at {path}")
    key = (_app(), folder)
    if key not in _LOADED:
        words = None
        if path_exists(spark, f"{folder}/categories/_SUCCESS"):
            words = spark.read.schema(WORDS).parquet(f"{folder}/categories")
        _LOADED[key] = Classifier(PipelineModel.load(f"{folder}/pipeline"), words)
    return _LOADED[key]


def load_or_train(spark: SparkSession, features_df: DataFrame, spec: ModelSpec, key: str) -> Classifier:
    path = model_path(spark, key, spec.name)
    if versions.current(spark, path) is None:
        save(train(spark, features_df, spec).model, path)
    return load(path)
