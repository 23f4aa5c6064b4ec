"""Keys of the hits, periods, the work folder and visitor joins under skew."""

import pytest
from pyspark.sql import functions as F

from conftest import session_rows
from weblytics import schema as S
from weblytics.operators.metrics import join_stored, users
from weblytics.session import file_stamp, work_dir
from weblytics.sources import SessionStore


def test_midnight_split_and_null_visitor_keep_their_own_hits(spark, tmp_path):
    rows = [dict(fullVisitorId=v, visitId=7, visitStartTime=t, date=d)
            for v, t, d in (("a", 7, "20240101"), ("a", 8, "20240102"), (None, 7, "20240101"))]
    sessions = session_rows(spark, rows).drop("hits")
    root = str(tmp_path)
    sessions.write.partitionBy("_table_suffix").parquet(f"{root}/sessions")
    hit = F.from_json(F.lit('{"hitNumber": 1}'), S.HIT)
    (sessions.select("fullVisitorId", "visitId", hit.alias("hit"), "_table_suffix")
     .write.partitionBy("_table_suffix").parquet(f"{root}/hits"))
    store = SessionStore(spark, root)
    nested = store.with_hits(store.all())
    assert [len(r.hits) for r in nested.collect()] == [1, 1, 1]
    few = store.with_hits(store.all(), max_sessions=3)
    assert [len(r.hits) for r in few.collect()] == [1, 1, 1]


def test_empty_period_is_an_error(store):
    with pytest.raises(ValueError):
        store.require("20300101", "20300131")
    store.require("20240101", "20240131")


def test_store_keys_differ_by_the_whole_path(spark):
    assert SessionStore(spark, "/a/sessions").key != SessionStore(spark, "/b/sessions").key


def test_unreadable_input_is_an_error(spark):
    with pytest.raises(Exception):
        file_stamp(spark, "/no/such/file.parquet")


def test_cluster_without_work_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError):
        work_dir(Session())


def test_visitor_join_under_skew(spark):
    """One visitor with half of the sessions, and NULL with a quarter: the join
    is split, and the NULL sessions do not share a task."""
    n = 40_000
    visitor = (F.when(F.col("id") % 4 < 2, F.lit("hot")).when(F.col("id") % 4 == 2, F.lit(None))
               .otherwise(F.concat(F.lit("v"), (F.col("id") % 4000).cast("string"))))
    sessions = spark.range(n).select(
        visitor.alias("fullVisitorId"), F.col("id").alias("visitId"), F.col("id").alias("visitStartTime"),
        F.lit("20240101").alias("date"), F.sha2(F.col("id").cast("string"), 512).alias("payload"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16",
                "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
                "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
                "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        joined = join_stored(sessions, users(sessions), {"fullVisitorId": "fullVisitorId"}).select("fullVisitorId", "visit_count", "payload")
        rows = joined.collect()
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
        assert len(rows) == n
        assert all(r.visit_count is None for r in rows if r.fullVisitorId is None)
        assert all(r.visit_count == n // 2 for r in rows if r.fullVisitorId == "hot")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
