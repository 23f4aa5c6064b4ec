"""Visitor history (window rewrite) against the literal correlated form."""

from pyspark.sql import functions as F

from conftest import session_rows
from weblytics.operators import history

CORRELATED = """
SELECT s.fullVisitorId, s.visitId,
  (SELECT COUNT(*) FROM t i WHERE i.fullVisitorId = s.fullVisitorId
     AND to_date(i.date, 'yyyyMMdd') < to_date(s.date, 'yyyyMMdd')) AS visit_frequency,
  (SELECT SUM(i.totals.transactionRevenue) FROM t i WHERE i.fullVisitorId = s.fullVisitorId
     AND to_date(i.date, 'yyyyMMdd') < to_date(s.date, 'yyyyMMdd')) AS total_transaction_value
FROM t s
"""


def _both(spark, df):
    df.createOrReplaceTempView("t")
    a = sorted((tuple(r) for r in history.prior_days(df)
                .select("fullVisitorId", "visitId", "visit_frequency", "total_transaction_value")
                .collect()), key=repr)
    b = sorted((tuple(r) for r in spark.sql(CORRELATED).collect()), key=repr)
    return a, b


def test_edge_rows(spark):
    rows = [
        # two sessions on one day see the same (empty) history
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "totals.transactionRevenue": 5},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101"},
        # next day: both earlier sessions, revenue of the first only
        {"fullVisitorId": "a", "visitId": 3, "date": "20240102", "totals.transactionRevenue": 7},
        # a gap day
        {"fullVisitorId": "a", "visitId": 4, "date": "20240105"},
        # history of only NULL revenue stays NULL
        {"fullVisitorId": "b", "visitId": 5, "date": "20240101"},
        {"fullVisitorId": "b", "visitId": 6, "date": "20240103"},
        # NULL visitor: 0 sessions, NULL revenue (not grouped with other NULLs)
        {"fullVisitorId": None, "visitId": 7, "date": "20240101", "totals.transactionRevenue": 1},
        {"fullVisitorId": None, "visitId": 8, "date": "20240102"},
    ]
    a, b = _both(spark, session_rows(spark, rows))
    assert a == b
    got = {r[1]: (r[2], r[3]) for r in a}
    assert got[1] == (0, None) and got[2] == (0, None)
    assert got[3] == (2, 5) and got[4] == (3, 12)
    assert got[6] == (1, None)
    assert got[8] == (0, None)


def test_equals_correlated_on_fixture(spark, store):
    a, b = _both(spark, store.all())
    assert a == b


def test_no_fan_out(store):
    df = store.between("20240122", "20240130")
    out = history.with_history(df, store.all(), "20240122", "20240130")
    assert out.count() == df.count()


def test_window_partition_is_per_visitor_day(store):
    plan = history.visitor_days(store.all())._jdf.queryExecution().executedPlan().toString()
    # the window runs on the pre-aggregated (visitor, day) rows
    assert "Window" in plan and "HashAggregate" in plan
    days = history.visitor_days(store.all())
    assert days.count() == store.all().select("fullVisitorId", "date").distinct().count()
    assert days.where(F.col("visit_frequency") < 0).count() == 0
