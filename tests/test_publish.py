"""The published daily-predictions table."""

import uuid

from pyspark.sql import functions as F

from weblytics import schema as S
from weblytics.plans import ml, publish
from weblytics.plans.catalogue import feature_set
from weblytics.session import work_dir
from weblytics.sources import published


def _scored(spark, store):
    spec = ml.ModelSpec("pub_small", "forest", num_trees=3, max_depth=3)
    model = ml.train(spark, feature_set(store, "history", "train"), spec).model
    return publish.predictions(model, feature_set(store, "history", "test", for_scoring=True))


def test_columns_types_and_rerun(spark, store):
    path = f"{work_dir(spark)}/test-published/{uuid.uuid4().hex}"
    scored = _scored(spark, store)
    n = scored.count()
    publish.publish(scored, path, "2024-01-31")
    publish.publish(scored, path, "2024-02-01")
    df = published.read(spark, path)
    assert df.schema == S.PUBLISHED
    assert [f.name for f in df.schema.fields] == [f.name for f in S.PUBLISHED.fields]
    assert df.count() == 2 * n
    # re-running one date replaces only that date
    publish.publish(scored.limit(5), path, "2024-01-31")
    df = published.read(spark, path)  # fresh listing of the rewritten table
    counts = {r[0].isoformat(): r[1] for r in df.groupBy("predictionDate").count().collect()}
    assert counts == {"2024-01-31": 5, "2024-02-01": n}


def test_date_read_is_pruned(spark, store):
    path = f"{work_dir(spark)}/test-published/{uuid.uuid4().hex}"
    publish.publish(_scored(spark, store), path, "2024-01-31")
    plan = published.read(spark, path, "2024-01-31")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(predictionDate" in plan


def test_unique_session_id_propagates_null(spark):
    df = spark.createDataFrame([(None, 5)], "fullVisitorId string, visitId long")
    from weblytics.functions.columns import session_key
    assert df.select(session_key().alias("k")).first().k is None
    assert df.select(F.concat_ws("-", "fullVisitorId", "visitId")).first()[0] == "5"


def test_append_mode_adds_rows(spark, store):
    path = f"{work_dir(spark)}/test-published/{uuid.uuid4().hex}"
    scored = _scored(spark, store).limit(10)
    publish.publish(scored, path, "2024-01-31", mode="append")
    publish.publish(scored, path, "2024-01-31", mode="append")
    assert published.read(spark, path, "2024-01-31").count() == 20
