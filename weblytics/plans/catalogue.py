"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the exported session table of ``sf_dir`` (derived by Spark
from the test tables, see ``sources.fixture``) over its whole period.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.fixed import SAMPLE_EXTENDED, SAMPLE_HISTORY
from ..operators import evaluation, explore, features, history, metrics, reports
from ..sources import published, versions
from ..operators.visitor_state import VisitorState
from ..session import work_dir
from ..sources.fixture import session_store
from . import forest, linear, ml, publish
from .periods import PERIODS

Query = Callable[[SparkSession, str], DataFrame]


def _period(spark: SparkSession, sf_dir: str, period: str) -> DataFrame:
    start, end = PERIODS[period]
    store = session_store(spark, sf_dir)
    store.require(start, end)
    return store.between(start, end)


def _report(fn, period: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(_period(spark, sf_dir, period))
    run.__name__ = fn.__name__
    return run


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {}
    # descriptive reports
    q["an_tx_by_device_browser"] = _report(reports.tx_by_device_browser, "month")
    q["an_bounce_by_source"] = _report(reports.bounce_by_source, "month")
    q["an_conversion_by_os_device_browser"] = _report(reports.conversion_by_os_device_browser, "two_month")
    q["an_purchaser_share"] = _report(reports.purchaser_share, "month")
    q["an_revenue_by_source_medium"] = _report(reports.revenue_by_source_medium, "two_month")
    q["an_top_bounce_countries"] = _report(reports.top_bounce_countries, "two_month")
    q["an_time_by_device"] = _report(reports.time_by_device, "two_month")
    q["an_campaigns"] = _report(reports.campaigns, "two_month")
    q["an_pageviews_by_browser"] = _report(reports.pageviews_by_browser, "two_month")
    q["an_sessions_by_weekday"] = _report(reports.sessions_by_weekday, "two_month")

    # exploration
    q["pre_preview_shard"] = _preview_query
    q["pre_scan_range_known_visitor"] = _known_visitors_query
    q["pre_scan_known_visitor_hits"] = _known_visitor_hits_query
    q["pre_unnest_hits"] = _unnest_query

    # metric tables, training and hold-out periods
    metric_fns = {
        "met_traffic_all": lambda s: metrics.traffic(s),
        "met_traffic_nonnull": lambda s: metrics.traffic(s, rate_over_non_null=True),
        "met_device": metrics.device,
        "met_temporal": metrics.temporal,
        "met_user": metrics.users,
        "met_conversion": metrics.conversion,
    }
    for name, fn in metric_fns.items():
        q[name] = _report(fn, "train")
        q[f"{name}_test"] = _report(fn, "test")

    # visitor history over all shards, class-balancing sample alone
    q["hist_prior_days"] = lambda spark, sf: history.prior_days(session_store(spark, sf).all())
    q["hist_day_by_day"] = _day_by_day_query
    q["sample_keep_positives_p10"] = _report(lambda s: features.sampled(s, SAMPLE_EXTENDED), "train")
    q["sample_keep_positives_p05"] = _report(lambda s: features.sampled(s, SAMPLE_HISTORY), "train")

    # feature sets
    for period in ("train", "test"):
        q[f"feat_basic_{period}"] = _report(features.basic, period)
        q[f"feat_extended_{period}"] = _report(features.extended, period)
        q[f"feat_enriched_{period}"] = _report(features.enriched, period)
        q[f"feat_history_{period}"] = _history_query(period)
    q["feat_history_score"] = _history_query("test", for_scoring=True)
    for period in ("train", "test"):
        q[f"feat_main_dataset_{period}"] = _main_dataset_query(period)

    # evaluation operators on a fixed, model-free score (all sessions)
    q["ml_evaluate_fixed_score"] = lambda spark, sf: evaluation.evaluate(
        evaluation.fixed_score(session_store(spark, sf).all()))
    q["ml_confusion_fixed_score"] = lambda spark, sf: evaluation.confusion(
        evaluation.fixed_score(session_store(spark, sf).all()))

    # the four models: train (and store), evaluate and confusion on the hold-out
    for name in ml.MODELS:
        q[f"ml_split_{name}"] = _split_query(name)
        q[f"ml_categories_{name}"] = _categories_query(name)
        q[f"ml_category_folds_{name}"] = _folds_query(name)
        q[f"ml_train_{name}"] = _train_query(name)
        q[f"ml_evaluate_{name}"] = _holdout_query(name, evaluation.evaluate)
        q[f"ml_confusion_{name}"] = _holdout_query(name, evaluation.confusion)

    # the tuned logistic model by line search
    q["ml_first_gradient_extended"] = _first_gradient_query
    q["ml_line_search_extended"] = _line_search_query
    q["ml_line_search_evaluate_extended"] = _linear_query(evaluation.evaluate)
    q["ml_line_search_confusion_extended"] = _linear_query(evaluation.confusion)

    # forests with penalised leaves and early stopping
    for name in forest.FORESTS:
        q[f"ml_forest_rounds_{name}"] = _rounds_query(name)
        q[f"ml_forest_evaluate_{name}"] = _forest_query(name, evaluation.evaluate)
        q[f"ml_forest_confusion_{name}"] = _forest_query(name, evaluation.confusion)

    # scoring and publishing with the history model
    q["ml_predict_sessions"] = _predict_query
    q["pub_daily_predictions"] = _publish_query
    # the same path with a model whose score SQL can state
    q["pub_fixed_score"] = _publish_fixed_query(RUN_DATE)
    q["pub_fixed_score_today"] = _publish_fixed_query(None)
    # stored models and tables: create, replace, append
    q["ml_model_store"] = _model_store_query
    q["pub_create_or_replace"] = _replace_query
    q["pub_append_runs"] = _append_query
    return q


PREVIEW_ROWS = 100


def _preview_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 sessions of one shard, whole rows (hits arrays assembled for the
    100 previewed sessions only)."""
    store = session_store(spark, sf_dir)
    day = PERIODS["shard"][0]
    rows = explore.preview(store.shard(day), PREVIEW_ROWS)
    return explore.flat(store.with_hits(rows, day, day, max_sessions=PREVIEW_ROWS))


def _known_visitors_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = session_store(spark, sf_dir)
    start, end = PERIODS["known_visitor"]
    return explore.flat(explore.known_visitors(store.between(start, end)))


def _known_visitor_hits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.known_visitor_hits(session_store(spark, sf_dir), *PERIODS["known_visitor"])


def _unnest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explore.unnest_hits(session_store(spark, sf_dir), *PERIODS["month"])


def _main_dataset_query(period: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        start, end = PERIODS[period]
        main = features.main_dataset(store.between(start, end))
        return explore.flat(explore.star(main))
    return run


LAST_DAYS = 4               # days that the registered daily history enters one by one
RUN_DATE = "2024-01-31"     # fixed prediction date of the registered publish run
NEXT_DATE = "2024-02-01"    # and of the run after it


def feature_set(store, name: str, period: str, for_scoring: bool = False) -> DataFrame:
    """Feature set ``name`` of a registered period (see ``periods``)."""
    start, end = PERIODS[period]
    store.require(start, end)
    return features.for_model(store, name, start, end, for_scoring)


def _model(spark: SparkSession, store, name: str):
    return ml.load_or_train(spark, feature_set(store, name, "train"), ml.MODELS[name], store.key)


def _fit_rows(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    data = feature_set(session_store(spark, sf_dir), name, "train")
    return data.where(~ml.eval_part(data, ml.MODELS[name]))


def _split_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return ml.split_summary(feature_set(session_store(spark, sf_dir), name, "train"), ml.MODELS[name])
    return run


def _categories_query(name: str) -> Query:
    """Rows and positives of every category value of the fit part."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _fit_rows(spark, sf_dir, name)
        return ml.category_counts(rows, [c for c in rows.columns if c in features.CATEGORICAL])
    return run


def _folds_query(name: str) -> Query:
    """Cross-fitted shares of positives: per value and fold, of the other folds."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _fit_rows(spark, sf_dir, name)
        shares = ml.fold_shares(rows, [c for c in rows.columns if c in features.CATEGORICAL])
        return shares.withColumns({"share": F.round("share", 9), "fold": F.col("fold").cast("long")})
    return run


def _train_query(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        trained = ml.train(spark, feature_set(store, name, "train"), ml.MODELS[name])
        ml.save(trained.model, ml.model_path(spark, store.key, name), replace=True)
        return trained.summary
    return run


def _holdout_query(name: str, metric) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        model = _model(spark, store, name)
        return metric(ml.score(model, feature_set(store, name, "test")))
    return run


def _first_gradient_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient of the mean log loss at zero weights, per coordinate of the tuned
    logistic model: the direction of its first step."""
    d = linear.design(_fit_rows(spark, sf_dir, "extended"))
    n, _, gradient = linear.losses(d, linear.np.zeros((1, d.size)))
    table = linear.coefficients(spark, linear.Fitted(d, gradient[0] / max(n, 1.0), []))
    return table.select("feature", "value", F.round("weight", 9).alias("gradient"))


def _line_search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step, objective and penalised gradient of every iteration; fits and stores."""
    store = session_store(spark, sf_dir)
    opt = linear.LineSearchOptions()
    fitted = linear.fit(_fit_rows(spark, sf_dir, "extended"), opt)
    linear.save(linear.coefficients(spark, fitted), linear.model_path(spark, store.key, "extended", opt))
    return spark.createDataFrame(fitted.rounds, linear.ROUNDS)


def _linear_query(metric) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        table = linear.load_or_fit(spark, _fit_rows(spark, sf_dir, "extended"), "extended", store.key)
        return metric(linear.score(table, feature_set(store, "extended", "test")))
    return run


def _rounds_query(name: str) -> Query:
    """Loss after every round of trees; fits and stores the forest."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        fitted, rounds = forest.fit(feature_set(store, name, "train"), forest.FORESTS[name])
        forest.save(fitted, spark, forest.model_path(spark, store.key, name))
        return spark.createDataFrame(rounds, forest.ROUNDS)
    return run


def _forest_query(name: str, metric) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        fitted = forest.load_or_fit(spark, feature_set(store, name, "train"), name, store.key)
        scored = forest.score(fitted, feature_set(store, name, "test"))
        return metric(scored)
    return run


def _predict_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = session_store(spark, sf_dir)
    model = _model(spark, store, "history")
    return publish.predictions(model, feature_set(store, "history", "test", for_scoring=True))


def _publish_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = session_store(spark, sf_dir)
    scored = _predict_query(spark, sf_dir)
    path = f"{work_dir(spark)}/weblytics/published/{store.key}/daily_predictions"
    publish.publish(scored, path, RUN_DATE)
    return published.read(spark, path, RUN_DATE)


def _publish_fixed_query(run_date: str | None) -> Query:
    """Save, load, score and publish with the model-free score."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = session_store(spark, sf_dir)
        scoring = feature_set(store, "history", "test", for_scoring=True)
        path = f"{work_dir(spark)}/weblytics/models/{store.key}/fixed-score-{uuid.uuid4().hex}"
        ml.save(ml.fixed_score_model(spark, scoring), path, replace=False)
        table = f"{work_dir(spark)}/weblytics/published/{store.key}/fixed-score-{uuid.uuid4().hex}"
        publish.publish(publish.predictions(ml.load(path), scoring), table, run_date)
        return published.read(spark, table, run_date)
    return run


def _model_store_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE MODEL, again (an error: one is present), CREATE OR REPLACE MODEL: the
    outcome of each step and what the model in force then scores."""
    store = session_store(spark, sf_dir)
    scoring = feature_set(store, "history", "test", for_scoring=True)
    path = f"{work_dir(spark)}/weblytics/models/{store.key}/store-{uuid.uuid4().hex}"
    model, out = ml.fixed_score_model(spark, scoring), None
    for step, (name, replace) in enumerate([("create", False), ("create", False), ("create or replace", True)], 1):
        try:
            ml.save(model, path, replace=replace)
            outcome = "stored"
        except versions.AlreadyPresent:
            outcome = "present"
        row = ml.score(ml.load(path), scoring).agg(
            F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("predicted_probability"), 6).alias("mean_probability"),
            F.sum("predicted_label").alias("n_predicted")).select(
            F.lit(step).cast("long").alias("step"), F.lit(name).alias("statement"), F.lit(outcome).alias("outcome"), "*",
            F.lit(len(versions.numbers(spark, path))).cast("long").alias("n_versions"))
        out = row if out is None else out.unionByName(row)
    return out


def _daily_rows(spark: SparkSession, sf_dir: str, date: str) -> DataFrame:
    """The hold-out scored by the fixed score, as published for a date."""
    scoring = feature_set(session_store(spark, sf_dir), "history", "test", for_scoring=True)
    return publish.daily_table(publish.predictions(ml.fixed_score_model(spark, scoring), scoring), date)


def _counted(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy("predictionDate").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives")).select(
        F.lit(label).alias("reader"), "*")


def _replace_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CREATE OR REPLACE TABLE under an open reader: it ends with the old rows."""
    rows = _daily_rows(spark, sf_dir, RUN_DATE)
    root = f"{work_dir(spark)}/weblytics/published/tables/{uuid.uuid4().hex}"
    published.create_or_replace(rows, root, replace=False)
    before = published.open_table(spark, root)
    published.create_or_replace(rows.where("label = 1").withColumn("predictionDate", F.to_date(F.lit(NEXT_DATE))), root)
    return _counted(before, "opened before").unionByName(_counted(published.open_table(spark, root), "opened after"))


def _append_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INSERT of three runs, the first of them repeated."""
    rows = _daily_rows(spark, sf_dir, RUN_DATE)
    root = f"{work_dir(spark)}/weblytics/published/runs/{uuid.uuid4().hex}"
    later = rows.withColumn("predictionDate", F.to_date(F.lit(NEXT_DATE)))
    for run, df in (("run 1", rows), ("run 1", rows), ("run 2", rows.where("label = 0")), ("run 3", later)):
        published.append_run(df, root, run)
    return _counted(published.read_runs(spark, root), "all runs")


def _day_by_day_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visitor history of the last days from daily snapshots: the state starts
    from all days before, one of the last days arrives late."""
    store = session_store(spark, sf_dir)
    days = store.shards()
    last = days[-LAST_DAYS:]
    state = VisitorState(spark, f"{work_dir(spark)}/weblytics/visitor-state/{uuid.uuid4().hex}")
    state.seed(days[-LAST_DAYS - 1], store.between(days[0], days[-LAST_DAYS - 1]))
    for day in [*last[:1], *last[2:], last[1]]:
        state.enter(day, store.shard(day))
    out = None
    for day in last:
        rows = state.history(day, store.shard(day)).select(
            "fullVisitorId", "visitId", "visit_date", "visit_frequency", "total_transaction_value")
        out = rows if out is None else out.unionByName(rows)
    return out


def _history_query(period: str, for_scoring: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return feature_set(session_store(spark, sf_dir), "history", period, for_scoring)
    return run
