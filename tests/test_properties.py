"""Property tests: the history rewrite and the hit numbering on random rows."""


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from conftest import session_rows
from weblytics.operators import history
from weblytics.session import cluster_settings

VISITORS = st.sampled_from(["a", "b", "c", None])
DAYS = st.integers(min_value=1, max_value=6)
REVENUE = st.one_of(st.none(), st.integers(min_value=0, max_value=1000))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(VISITORS, DAYS, REVENUE), min_size=1, max_size=25))
def test_history_window_equals_correlated_form(spark, rows):
    data = [{"fullVisitorId": v, "visitId": i, "date": f"202401{d:02d}",
             "totals.transactionRevenue": r} for i, (v, d, r) in enumerate(rows)]
    df = session_rows(spark, data)
    df.createOrReplaceTempView("hp")
    ours = sorted((tuple(r) for r in history.prior_days(df)
                   .select("visitId", "visit_frequency", "total_transaction_value").collect()))
    theirs = sorted(tuple(r) for r in spark.sql("""
        SELECT s.visitId,
          (SELECT COUNT(*) FROM hp i WHERE i.fullVisitorId = s.fullVisitorId
             AND to_date(i.date, 'yyyyMMdd') < to_date(s.date, 'yyyyMMdd')),
          (SELECT SUM(i.totals.transactionRevenue) FROM hp i WHERE i.fullVisitorId = s.fullVisitorId
             AND to_date(i.date, 'yyyyMMdd') < to_date(s.date, 'yyyyMMdd'))
        FROM hp s""").collect())
    assert ours == theirs


def test_cluster_settings_scale_with_input():
    small = cluster_settings(10 << 30, 4000)
    big = cluster_settings(100 << 40, 4000)
    assert int(small["spark.sql.shuffle.partitions"]) == 12000
    assert int(big["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
