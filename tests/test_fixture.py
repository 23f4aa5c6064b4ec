"""The exported session table: schema, counts and invariants."""

from pyspark.sql import functions as F

from weblytics import schema as S


def test_schema_is_explicit(store):
    assert store.all().schema == S.SESSION_ROW_WITH_SUFFIX
    assert store.hit_rows().schema == S.HIT_ROW_WITH_SUFFIX
    nested = store.with_hits(store.all())
    assert nested.schema == S.SESSION_WITH_SUFFIX


def test_counts_match_fixture_spec(store):
    df = store.all()
    row = df.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct("fullVisitorId").alias("visitors"),
        F.count("totals.transactions").alias("with_tx"),
        F.count("totals.bounces").alias("bounces"),
    ).first()
    # sf0.001 figures of the fixture specification
    assert (row.sessions, row.visitors, row.with_tx, row.bounces) == (598, 15, 179, 305)


def test_session_key_unique(store):
    df = store.all()
    assert df.select("fullVisitorId", "visitId").distinct().count() == df.count()


def test_hits_array_matches_hit_count(store):
    nested = store.with_hits(store.all())
    bad = nested.where(F.size("hits") != F.col("totals.hits")).count()
    assert bad == 0
    nums = nested.select(F.transform("hits", lambda h: h["hitNumber"]).alias("n"),
                              F.size("hits").alias("k"))
    assert nums.where(F.col("n") != F.sequence(F.lit(1).cast("long"), F.col("k").cast("long"))).count() == 0


def test_every_event_is_one_hit(store, spark):
    from conftest import SF_SMALL
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet").count()
    assert store.all().agg(F.sum("totals.hits")).first()[0] == events
    assert store.hit_rows().count() == events


def test_hit_numbers_against_a_plain_window(spark, store):
    """The two-level numbering equals a row number over the whole session."""
    from pyspark.sql.window import Window
    from conftest import SF_SMALL
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    day, half = F.to_date("ts"), (F.hour("ts") >= 12).cast("int")
    w = Window.partitionBy("user_id", day, half).orderBy("ts", "event_id")
    plain = ev.select(F.col("user_id").cast("string").alias("fullVisitorId"),
                      F.row_number().over(w).cast("long").alias("hitNumber"),
                      F.concat(F.lit("/"), "event_type", F.lit("/"), (F.col("event_id") % 10).cast("string")).alias("pagePath"),
                      F.min(F.unix_timestamp("ts")).over(Window.partitionBy("user_id", day, half)).alias("visitId"))
    ours = store.hit_rows().select("fullVisitorId", "visitId", "hit.hitNumber", "hit.page.pagePath")
    assert ours.exceptAll(plain.select(*ours.columns)).count() == 0
    assert plain.select(*ours.columns).exceptAll(ours).count() == 0


def test_same_second_hits_are_ordered(spark):
    """Several events of one visitor in one second: numbered by time, then id."""
    import datetime as dt
    import tempfile
    from weblytics.sources import fixture
    base = tempfile.mkdtemp(prefix="weblytics-fx-")
    t0 = dt.datetime(2024, 1, 2, 13, 0, 5)
    rows = [(10, t0 + dt.timedelta(microseconds=500), 3, "view", 1.0, None),
            (11, t0, 3, "click", 1.0, None),
            (12, t0, 3, "view", 1.0, None),
            (13, t0 - dt.timedelta(seconds=1), 3, "view", 1.0, None),
            (14, t0 + dt.timedelta(seconds=3), 3, "purchase", 2.5, None)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, "
                                "value double, props string").write.parquet(f"{base}/events.parquet")
    from conftest import SF_SMALL
    for t in ("customer", "nation", "region"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    got = {r.event: r.n for r in fixture.derive_hit_rows(spark, base)
           .select(F.col("hit.page.pagePath").alias("event"), F.col("hit.hitNumber").alias("n")).collect()}
    assert got == {"/view/3": 1, "/click/1": 2, "/view/2": 3, "/view/0": 4, "/purchase/4": 5}


def test_partition_pruning(store):
    plan = store.between("20240111", "20240120")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan or "_table_suffix" in plan
    assert store.between("20240111", "20240120").select("date").distinct().count() == 10


def test_counts_at_sf001_match_fixture_spec(spark):
    """Every sf0.01 figure of the fixture specification."""
    from conftest import SF_MID
    from weblytics.sources.fixture import session_store
    st = session_store(spark, SF_MID)
    df = st.all()
    r = df.agg(
        F.count(F.lit(1)).alias("sessions"),
        F.countDistinct("fullVisitorId").alias("visitors"),
        F.count("totals.transactions").alias("with_tx"),
        F.count("totals.bounces").alias("bounces"),
        F.count_if(F.col("trafficSource.medium").isNull()).alias("null_medium"),
        F.count_if(F.col("trafficSource.campaign").isNull()).alias("null_campaign"),
        F.count_if(F.col("totals.pageviews").isNull()).alias("null_pageviews"),
        F.count_if(F.col("totals.timeOnSite").isNull()).alias("null_time"),
    ).first()
    assert (r.sessions, r.visitors, r.with_tx, r.bounces) == (6038, 150, 1768, 3323)
    assert (r.null_medium, r.null_campaign) == (1214, 3048)
    assert (r.null_pageviews, r.null_time) == (4257, 3323)
    multi = (df.groupBy("fullVisitorId", "date").count().where("count > 1").count())
    assert multi == 2032
    countries = df.groupBy("geoNetwork.country").count()
    assert countries.count() == 25 and countries.where("count > 100").count() == 25
    browsers = df.groupBy("device.browser").count().where("count > 100").count()
    assert browsers == 4
    groups = df.groupBy("device.operatingSystem", "device.deviceCategory", "device.browser").count().count()
    assert groups == 60
    assert st.between("20240101", "20240121").count() == 4206
    assert st.between("20240122", "20240130").count() == 1832
    assert st.hit_rows().count() == 10000


def test_sessions_are_exported_without_hits(spark):
    """Session rows are stored alone, derived once; hits and blocks follow when read."""
    import tempfile
    from conftest import SF_SMALL
    from weblytics.session import children
    from weblytics.sources import fixture
    base = tempfile.mkdtemp(prefix="weblytics-lazy-")
    for t in ("events", "customer", "nation", "region"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{base}/{t}.parquet")
    st = fixture.session_store(spark, base)
    folder = st.root.rsplit("/", 1)[0]

    def tables():
        return sorted(t for c in children(spark, folder) for t in children(spark, f"{folder}/{c}"))

    assert st.all().count() == 598 and tables() == ["sessions"]
    whole = fixture.export_sessions(spark, base, f"{base}/export")
    assert st.hit_leaves().exceptAll(whole.hit_leaves()).count() == 0
    assert st.hit_rows().exceptAll(whole.hit_rows()).count() == 0 and st.hit_rows().count() == whole.hit_rows().count()
    assert st.all().exceptAll(whole.all()).count() == 0
    assert tables() == ["blocks", "hits", "sessions"]
    assert fixture._exported(spark, base, folder, "hits") == st._folder("hits")     # written once
