"""Report semantics on hand-made rows (NULL groups, defaults, filters)."""

from conftest import session_rows
from weblytics.operators import reports


def test_bounce_by_source_null_source_gives_null_rate(spark):
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "trafficSource.source": None,
         "totals.bounces": 1},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101", "trafficSource.source": "google",
         "totals.bounces": 1},
        {"fullVisitorId": "a", "visitId": 3, "date": "20240101", "trafficSource.source": "google"},
    ])
    rows = {r.source: r for r in reports.bounce_by_source(df).collect()}
    assert rows[None].total_visits == 0 and rows[None].bounce_rate is None
    assert rows["google"].total_visits == 2 and rows["google"].bounce_rate == 50.0


def test_conversion_defaults_unknown_and_threshold(spark):
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "totals.transactions": 1},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101"},
        {"fullVisitorId": "b", "visitId": 3, "date": "20240101", "device.browser": "Edge"},
    ])
    rows = reports.conversion_by_os_device_browser(df).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.operating_system, r.device_category, r.browser) == ("Unknown", "Unknown", "Unknown")
    assert (r.total_sessions, r.total_transactions, r.conversion_rate_percentage) == (2, 1, 50.0)


def test_tx_by_device_browser_drops_groups_without_transactions(spark):
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "device.browser": "Edge",
         "totals.transactions": 2},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101", "device.browser": "Chrome"},
    ])
    rows = reports.tx_by_device_browser(df).collect()
    assert [(r.browser, r.total_transactions) for r in rows] == [("Edge", 2)]


def test_purchaser_share_counts_distinct_visitors(spark):
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "totals.transactions": 1},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101", "totals.transactions": 1},
        {"fullVisitorId": "b", "visitId": 3, "date": "20240101"},
        {"fullVisitorId": None, "visitId": 4, "date": "20240101", "totals.transactions": 1},
    ])
    r = reports.purchaser_share(df).first()
    assert (r.total_visitors, r.total_purchasers, r.conversion_rate_pct) == (2, 1, 50.0)


def test_campaigns_exclude_undefined(spark):
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240101", "trafficSource.campaign": "(not set)"},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240101", "trafficSource.campaign": None},
        {"fullVisitorId": "a", "visitId": 3, "date": "20240101", "trafficSource.campaign": "x",
         "totals.transactionRevenue": 2_500_000, "totals.transactions": 1},
    ])
    rows = reports.campaigns(df).collect()
    assert [(r.campaign, r.total_revenue_usd, r.conversion_rate_percentage) for r in rows] == [("x", 2.5, 100.0)]


def test_weekday_names(spark):
    # 2024-01-06 is a Saturday, 2024-01-07 a Sunday
    df = session_rows(spark, [
        {"fullVisitorId": "a", "visitId": 1, "date": "20240106"},
        {"fullVisitorId": "a", "visitId": 2, "date": "20240107"},
    ])
    assert {r.day_of_week for r in reports.sessions_by_weekday(df).collect()} == {"Saturday", "Sunday"}


def test_top_k_breaks_ties_by_country(spark):
    rows = []
    for i, country in enumerate(["B", "A", "C"]):
        for j in range(4):
            rows.append({"fullVisitorId": "v", "visitId": i * 10 + j, "date": "20240101",
                         "geoNetwork.country": country, "totals.bounces": 1 if j < 2 else None})
    out = reports.top_bounce_countries(session_rows(spark, rows), k=2, min_sessions=1).collect()
    assert [r.country for r in out] == ["A", "B"]


def _sorted_by(rows, key):
    return rows == sorted(rows, key=key)


def test_reports_keep_their_order(spark):
    """The order of each report (the oracle comparison ignores row order)."""
    from conftest import SF_MID
    from weblytics.sources.fixture import session_store
    st = session_store(spark, SF_MID)
    month, two = st.between("20240111", "20240120"), st.between("20240101", "20240130")
    none_first = lambda v: (v is not None, v or "")
    rows = reports.tx_by_device_browser(month).collect()
    assert _sorted_by(rows, lambda r: (none_first(r.deviceCategory), -r.total_transactions))
    rows = reports.bounce_by_source(month).collect()
    assert [r.source for r in rows] == sorted((r.source for r in rows), reverse=True)
    for fn, col in ((reports.conversion_by_os_device_browser, "conversion_rate_percentage"),
                    (reports.revenue_by_source_medium, "total_revenue_usd"),
                    (reports.time_by_device, "avg_time_on_site_seconds"),
                    (reports.campaigns, "total_revenue_usd"),
                    (reports.pageviews_by_browser, "avg_pageviews_per_session"),
                    (reports.sessions_by_weekday, "total_transactions")):
        values = [r[col] for r in fn(two).collect()]
        assert values == sorted(values, reverse=True), fn.__name__
    top = reports.top_bounce_countries(two).collect()
    assert _sorted_by(top, lambda r: (-r.bounce_rate_percentage, r.country))
