"""One visitor holding a third of all events: the skew-safe paths stay exact.

The hot data set is derived from the sf0.01 test tables (every third event
reassigned to one user), and each result is compared with a brute-force form
(a plain window over the whole session, the literal correlated subqueries).
"""

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import SF_MID
from weblytics.operators import history, reports
from weblytics.session import work_dir
from weblytics.sources import fixture

HOT_USER = 7


@pytest.fixture(scope="module")
def hot(spark):
    base = f"{work_dir(spark)}/test-skew/{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{SF_MID}/events.parquet")
    ev = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(HOT_USER).cast("long"))
                       .otherwise(F.col("user_id")))
    ev.write.parquet(f"{base}/events.parquet")
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF_MID}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    store = fixture.export_sessions(spark, base, f"{base}/export")
    return base, store


def test_hot_user_holds_a_third(spark, hot):
    base, store = hot
    ev = spark.read.parquet(f"{base}/events.parquet")
    share = ev.where(F.col("user_id") == HOT_USER).count() / ev.count()
    assert share > 0.33


def test_hit_numbers_exact_under_skew(spark, hot):
    base, store = hot
    ev = spark.read.parquet(f"{base}/events.parquet")
    day, half = F.to_date("ts"), (F.hour("ts") >= 12).cast("int")
    session = Window.partitionBy("user_id", day, half)
    brute = ev.select(F.col("user_id").cast("string").alias("fullVisitorId"),
                      F.min(F.unix_timestamp("ts")).over(session).alias("visitId"),
                      F.row_number().over(session.orderBy("ts", "event_id")).cast("long").alias("hitNumber"),
                      F.col("event_id"))
    ours = store.hit_rows().select("fullVisitorId", "visitId", F.col("hit.hitNumber").alias("hitNumber"),
                                   F.col("hit.page.pagePath").alias("path"))
    b = brute.select("fullVisitorId", "visitId", "hitNumber")
    o = ours.select("fullVisitorId", "visitId", "hitNumber")
    assert o.exceptAll(b).count() == 0 and b.exceptAll(o).count() == 0
    # totals agree with the hit table for every session, the hot ones included
    totals = store.all().select("fullVisitorId", "visitId", F.col("totals.hits").alias("n"))
    counted = store.hit_rows().groupBy("fullVisitorId", "visitId").agg(F.count(F.lit(1)).alias("n"))
    assert totals.exceptAll(counted).count() == 0


def test_history_exact_under_skew(spark, hot):
    _, store = hot
    df = store.all()
    df.createOrReplaceTempView("hot_sessions")
    ours = history.prior_days(df).select("visitId", "fullVisitorId", "visit_frequency",
                                         "total_transaction_value")
    brute = spark.sql("""
        SELECT s.visitId, s.fullVisitorId,
          (SELECT COUNT(*) FROM hot_sessions i WHERE i.fullVisitorId = s.fullVisitorId
             AND to_date(i.date, 'yyyyMMdd') < to_date(s.date, 'yyyyMMdd')) AS visit_frequency,
          (SELECT SUM(i.totals.transactionRevenue) FROM hot_sessions i
            WHERE i.fullVisitorId = s.fullVisitorId
             AND to_date(i.date, 'yyyyMMdd') < to_date(s.date, 'yyyyMMdd')) AS total_transaction_value
        FROM hot_sessions s""")
    assert ours.exceptAll(brute).count() == 0 and brute.exceptAll(ours).count() == 0


def test_purchaser_share_under_skew(spark, hot):
    _, store = hot
    df = store.all()
    r = reports.purchaser_share(df).first()
    assert r.total_visitors == df.select("fullVisitorId").distinct().count()
    assert r.total_purchasers == df.where("totals.transactions IS NOT NULL") \
        .select("fullVisitorId").distinct().count()
