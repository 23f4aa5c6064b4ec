"""Model training, storing, loading and scoring (no SQL oracle: properties)."""

import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from weblytics.operators.features import CATEGORICAL
from weblytics.plans import ml
from weblytics.plans.catalogue import feature_set
from weblytics.session import materialise


@pytest.fixture(scope="module")
def basic_model(spark, store):
    return ml.train(spark, feature_set(store, "basic", "train"), ml.MODELS["basic"])


def test_summary_row(basic_model):
    r = basic_model.summary.first()
    assert r.model == "basic" and r.n_train > 0 and r.n_eval > 0
    assert 0.0 <= r.roc_auc <= 1.0


def test_probabilities_valid_and_inputs_passed_through(basic_model, store):
    test = feature_set(store, "basic", "test")
    scored = ml.score(basic_model.model, test)
    assert set(test.columns) <= set(scored.columns)
    assert scored.count() == test.count()
    raw = basic_model.model.transform(test).select(vector_to_array("probability").alias("p"))
    bad = raw.where((F.abs(F.col("p")[0] + F.col("p")[1] - 1) > 1e-9)
                    | (F.col("p")[1] < 0) | (F.col("p")[1] > 1)).count()
    assert bad == 0


def test_save_load_same_scores(spark, basic_model, store):
    path = ml.model_path(spark, "test-" + store.key, "basic")
    ml.save(basic_model.model, path)
    loaded = ml.load(path)
    test = feature_set(store, "basic", "test")
    a = ml.score(basic_model.model, test).select("unique_session_id", "predicted_probability")
    b = ml.score(loaded, test).select("unique_session_id", F.col("predicted_probability").alias("q"))
    diff = a.join(b, "unique_session_id").where(F.abs(F.col("predicted_probability") - F.col("q")) > 1e-12)
    assert diff.count() == 0


def test_unseen_category_scores(spark, basic_model, store):
    test = feature_set(store, "basic", "test").withColumn("country", F.lit("NEVER_SEEN"))
    assert ml.score(basic_model.model, test).where(F.col("predicted_probability").isNull()).count() == 0


def test_forest_trains_with_nullable_and_date_features(spark, store):
    spec = ml.ModelSpec("history_small", "forest", num_trees=5, max_depth=4)
    trained = ml.train(spark, feature_set(store, "history", "train"), spec)
    scored = ml.score(trained.model, feature_set(store, "history", "test", for_scoring=True))
    assert scored.where(F.col("predicted_probability").between(0, 1)).count() == scored.count()


def test_deterministic_for_a_seed(spark, store):
    spec = ml.ModelSpec("det", "forest", num_trees=3, max_depth=3)
    data = feature_set(store, "enriched", "train")
    a = ml.train(spark, data, spec).summary.first().roc_auc
    b = ml.train(spark, data, spec).summary.first().roc_auc
    assert a == b


def test_dictionary_keeps_every_value(spark):
    rows = [(f"v{i % 300}", ["", None, "x"][i % 3], i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "os string, browser string, label long")
    words = ml.dictionary(df, ["os", "browser"])
    own = words.where("feature = 'os' AND value IS NOT NULL")
    assert own.count() == own.select("idx").distinct().count() == 300
    assert sorted(r.idx for r in own.collect()) == list(range(ml.FIRST_INDEX, ml.FIRST_INDEX + 300))
    got = ml.with_categories(spark.createDataFrame(
        [("v1", None), ("new", ""), (None, "x")], "os string, browser string"), words, ["os", "browser"], 0.5)
    idx = {(r.os, r.browser): (r.os__idx, r.browser__idx) for r in got.collect()}
    assert idx[("new", "")][0] == ml.UNSEEN_INDEX and idx[("new", "")][1] == ml.EMPTY_INDEX
    assert idx[(None, "x")][0] == ml.NULL_INDEX and idx[("v1", None)][1] == ml.NULL_INDEX
    assert idx[("v1", None)][0] >= ml.FIRST_INDEX


def test_split_holds_every_row(spark, store):
    data = feature_set(store, "basic", "train")
    data = data.withColumn("unique_session_id", F.when(F.rand(3) < 0.5, F.col("unique_session_id")))
    parts = {r.part: r.n_rows for r in ml.split_summary(data, ml.MODELS["basic"]).collect()}
    assert sum(parts.values()) == data.count() and min(parts.values()) > 0


def test_fixed_score_model_round_trip(spark, store):
    import uuid
    scoring = feature_set(store, "history", "test", for_scoring=True)
    path = f"{ml.model_path(spark, 'test', 'history')}-{uuid.uuid4().hex}"
    ml.save(ml.fixed_score_model(spark, scoring), path, replace=False)
    scored = ml.score(ml.load(path), scoring)
    assert scored.where(F.abs(F.col("predicted_probability") - (F.col("hits") + 1) / (F.col("hits") + 6)) > 1e-12
                        ).count() == 0


def test_logistic_gradient_is_small(spark, store):
    """The unpenalised fit ends where the mean gradient of the loss is small."""
    spec = ml.ModelSpec("grad", "logistic", max_iter=200)
    data = feature_set(store, "basic", "train")
    model = ml.train(spark, data, spec).model
    rows = ml.score(model, data.where(~ml.eval_part(data, spec)))
    r = rows.agg(F.avg(F.col("predicted_probability") - F.col("label")).alias("g"),
                 F.avg((F.col("predicted_probability") - F.col("label")) * F.col("pageviews")).alias("gp")).first()
    assert abs(r.g) < 1e-3 and abs(r.gp) < 1e-2


def test_confusion_totals_are_the_label_counts(spark, store, basic_model):
    from weblytics.operators import evaluation
    test = feature_set(store, "basic", "test")
    totals = {r.expected_label: r.predicted_0 + r.predicted_1
              for r in evaluation.confusion(ml.score(basic_model.model, test)).collect()}
    assert totals == {r.label: r["count"] for r in test.groupBy("label").count().collect()}


def test_save_without_replace_fails_if_present(spark, basic_model, store):
    import uuid
    path = f"{ml.model_path(spark, 'test-' + store.key, 'basic')}-{uuid.uuid4().hex}"
    ml.save(basic_model.model, path, replace=False)
    with pytest.raises(Exception):
        ml.save(basic_model.model, path, replace=False)
    ml.save(basic_model.model, path, replace=True)  # CREATE OR REPLACE


def test_label_probs_array(basic_model, store):
    scored = ml.score(basic_model.model, feature_set(store, "basic", "test"))
    r = scored.select("predicted_label_probs", "predicted_probability").first()
    assert [p["label"] for p in r.predicted_label_probs] == [1, 0]
    assert r.predicted_label_probs[0]["prob"] == r.predicted_probability
    assert abs(sum(p["prob"] for p in r.predicted_label_probs) - 1) < 1e-9


def test_a_category_named_like_null_multiplies_no_row(spark):
    rows = [(None, 0), ("__null__", 1), ("__null__", 0), ("", 1), ("=", 1)]
    df = spark.createDataFrame(rows, "os string, label long")
    words = ml.dictionary(df, ["os"])
    got = ml.with_categories(df, words, ["os"], 0.5).collect()
    assert len(got) == len(rows)
    idx = {r.os: r.os__idx for r in got}
    assert idx[None] == ml.NULL_INDEX and idx[""] == ml.EMPTY_INDEX
    assert len(set(idx.values())) == 4 and min(idx["__null__"], idx["="]) >= ml.FIRST_INDEX


def test_unique_values_have_no_power_on_the_fit_part(spark):
    """Cross-fitted shares: a value that occurs once carries nothing of its label,
    while a real category keeps its difference."""
    rows = [(f"s{i}", f"u{i}", "good" if i % 3 == 0 else "bad", int(i % 3 == 0 or i % 7 == 0)) for i in range(2000)]
    df = spark.createDataFrame(rows, "unique_session_id string, campaign string, os string, label long")
    words = ml.dictionary(df, ["campaign", "os"])
    folded = df.withColumn("_fold", ml.fold_of(df))
    overall = df.agg({"label": "avg"}).first()[0]
    crossed = ml.with_categories(folded, words, ["campaign", "os"], overall, "_fold")
    plain = ml.with_categories(df, words, ["campaign", "os"], overall)

    def spread(frame, column):
        by = {r.label: r.m for r in frame.groupBy("label").agg(F.avg(column).alias("m")).collect()}
        return by[1] - by[0]

    assert abs(spread(crossed, "campaign__share")) < 1e-12 < 0.02 < spread(plain, "campaign__share")
    assert spread(crossed, "os__share") > 0.4
    shares = {(r.value, r.fold): r for r in ml.fold_shares(df, ["os"]).collect()}
    own = {(r.os, r._fold): r.os__share for r in crossed.select("os", "_fold", "os__share").distinct().collect()}
    assert own == {k: r.share for k, r in shares.items()}


def test_one_exchange_serves_all_category_joins(spark, store):
    from weblytics.session import materialise
    data = materialise(feature_set(store, "extended", "train"), "test")
    cats = [c for c in data.columns if c in ml.CATEGORICAL]
    words = materialise(ml.dictionary(data, cats), "test")
    joined = ml.with_categories(data, words, cats, 0.5)
    joined.write.format("noop").mode("overwrite").save()
    joined.collect()
    plan = joined._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("BroadcastHashJoin") == len(cats)
    assert plan.count("ReusedExchange") == len(cats) - 1


def test_a_killed_writer_leaves_the_model_before_it(spark, basic_model, store):
    import uuid

    from weblytics.session import file_system
    from weblytics.sources import versions
    path = f"{ml.model_path(spark, 'test-' + store.key, 'basic')}-{uuid.uuid4().hex}"
    ml.save(basic_model.model, path, replace=False)
    before = ml.load(path)
    # a writer that died after its pipeline, one that died while making its marker
    basic_model.model.pipeline.write().save(f"{versions.new_folder(path)}/pipeline")
    fs, marker = file_system(spark, f"{path}/markers/{2:010d}")
    fs.create(marker, False).close()
    ml._LOADED.clear()
    after = ml.load(path)
    assert after.cats == before.cats
    test = feature_set(store, "basic", "test")
    total = [ml.score(m, test).agg(F.sum("predicted_probability")).first()[0] for m in (before, after)]
    assert abs(total[0] - total[1]) < 1e-9
    with pytest.raises(versions.AlreadyPresent):
        ml.save(basic_model.model, path, replace=False)
    folder = versions.current(spark, path)
    ml.save(basic_model.model, path)            # passes over the dead marker
    assert versions.numbers(spark, path) == [1, 2, 3] and versions.current(spark, path) != folder


def test_scores_are_evaluated_once(spark, store, basic_model):
    """evaluate() reads the model's scores in one job only."""
    from weblytics.operators import evaluation
    test = feature_set(store, "basic", "test")
    scored = ml.score(basic_model.model, test)
    plan = evaluation.evaluate(scored)._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRelation" in plan or "Relation [" in plan
    assert "UDF" not in plan and "predicted_probability" not in plan


def test_many_rows_are_fitted_in_tasks_of_bounded_size(spark, monkeypatch):
    """Every row once, in tasks of at most about ``ROWS_PER_TASK`` rows; few rows stay as they lie."""
    from weblytics.plans import ml
    monkeypatch.setattr(ml, "ROWS_PER_TASK", 100)
    df = spark.range(2000, numPartitions=2)
    dealt = ml.in_tasks(df, 2000)
    sizes = dealt.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 2000 and max(sizes) <= 200 and dealt.distinct().count() == 2000
    assert ml.in_tasks(df, 100) is df


def _largest_method(spark, df, capsys):
    """Bytes of the largest method that Spark generates for ``df``."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        capsys.readouterr()
        df.explain("codegen")
        return max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_joins_of_all_categories_stay_compilable(spark, capsys):
    # the JVM never compiles a method over 8,000 bytes
    cats = sorted(CATEGORICAL)
    numbers = [f"n{i}" for i in range(15)]
    df = spark.range(40).select(
        F.col("id").cast("string").alias("unique_session_id"), (F.col("id") % 2).alias("label"),
        *[F.concat(F.lit("v"), F.col("id") % (i + 2)).alias(c) for i, c in enumerate(cats)],
        *[(F.col("id") * i).alias(c) for i, c in enumerate(numbers)])
    words = materialise(ml.dictionary(df, cats), "test-words")
    got = ml.with_categories(df, words, cats, 0.5)
    assert _largest_method(spark, got, capsys) <= 8000
    assert got.count() == 40 and got.where(F.col("os__idx") < ml.FIRST_INDEX).count() == 0
