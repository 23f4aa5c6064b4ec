"""Derived feature expressions on edge rows."""

from pyspark.sql import functions as F

from conftest import session_rows
from weblytics.functions import columns as X
from weblytics.operators import features


def test_hour_buckets_and_evening(spark):
    base = 1704067200  # 2024-01-01 00:00:00 UTC
    hours = [0, 5, 6, 11, 12, 17, 18, 23]
    df = spark.createDataFrame([(base + h * 3600 + 59,) for h in hours], "t long")
    rows = df.select(X.utc_hour("t").alias("h"), X.time_of_day(X.utc_hour("t")).alias("b"),
                     X.evening_visit(X.utc_hour("t")).alias("e")).collect()
    assert [r.h for r in rows] == hours
    assert [r.b for r in rows] == ["night", "night", "morning", "morning", "afternoon",
                                   "afternoon", "evening", "evening"]
    assert [r.e for r in rows] == [0, 0, 0, 0, 0, 0, 1, 1]


def test_utc_hour_ignores_session_time_zone(spark):
    df = spark.createDataFrame([(1704067200 + 5 * 3600,)], "t long")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert df.select(X.utc_hour("t")).first()[0] == 5
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_time_on_site_categories(spark):
    values = [None, 0, 59, 60, 179, 180, 599, 600]
    df = spark.createDataFrame([(v,) for v in values], "t long")
    got = [r[0] for r in df.select(X.time_on_site_category(F.col("t"))).collect()]
    assert got == ["no_time", "no_time", "very_short", "short", "short", "medium", "medium", "long"]


def test_per_unit_guards_zero_and_null(spark):
    df = spark.createDataFrame([(100, None), (100, 0), (100, 3), (None, 4)], "t long, p long")
    got = [r[0] for r in df.select(X.per_unit(F.col("t"), F.col("p"), 2)).collect()]
    assert got == [100.0, 100.0, 33.33, 0.0]


def test_feature_defaults_on_nulls(spark):
    df = session_rows(spark, [{"fullVisitorId": "a", "visitId": 1, "date": "20240106",
                               "visitStartTime": 1704567600}])  # a Saturday, 19:00 UTC
    r = features.extended(df, p=None).first()
    assert (r.os, r.country, r.region, r.traffic_medium, r.traffic_source, r.campaign) == ("",) * 6
    assert (r.pageviews, r.hits, r.time_on_site) == (0, 0, 0)
    assert (r.is_organic, r.evening_visit, r.visit_hour) == (0, 1, 19)
    assert r.label == 0 and r.avg_time_per_pageview == 0.0
    e = features.enriched(df, p=None).first()
    assert (e.day_of_week, e.is_weekend, e.day_of_month, e.month) == ("Saturday", 1, 6, 1)
    # crossed categories propagate NULL like CONCAT
    assert e.device_country is None and e.medium_timeofday is None and e.browser_os is None
    assert (e.total_visits_user, e.visits_day_of_week, e.sessions_by_device_type) == (1, 1, 0)


def test_organic_flag_null_medium(spark):
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "trafficSource.medium": "organic"},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101", "trafficSource.medium": None},
    ])
    got = {r.unique_session_id: r.is_organic for r in features.extended(df, p=None).collect()}
    assert got == {"a-1": 1, "a-2": 0}


def test_purchaser_share_equals_literal_cross_join(spark, store):
    """One-pass rewrite against the literal form with two one-row subqueries."""
    from weblytics.operators import reports
    df = store.between("20240111", "20240120")
    df.createOrReplaceTempView("p")
    literal = spark.sql("""
        SELECT total_visitors, total_purchasers,
               ROUND(total_purchasers / total_visitors * 100, 2) AS conversion_rate_pct
        FROM (SELECT COUNT(DISTINCT fullVisitorId) AS total_visitors FROM p) v
        CROSS JOIN (SELECT COUNT(DISTINCT fullVisitorId) AS total_purchasers FROM p
                    WHERE totals.transactions IS NOT NULL) q""").first()
    ours = reports.purchaser_share(df).first()
    assert tuple(ours) == tuple(literal)
