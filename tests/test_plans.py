"""Physical plans: partition pruning, column pruning, pushdown, join choice."""

from weblytics.operators import explore, features, reports


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df):
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_report_prunes_partitions_and_columns(store):
    text = _formatted(reports.conversion_by_os_device_browser(store.between("20240101", "20240110")))
    assert "PartitionFilters: [isnotnull(_table_suffix" in text
    # only the three device leaves and transactions are read
    assert "ReadSchema: struct<totals:struct<transactions:bigint>,device:struct<deviceCategory:string,operatingSystem:string,browser:string>>" in text


def test_hit_table_reads_two_leaves(store):
    text = _formatted(explore.hit_columns(store.hit_rows("20240111", "20240120")))
    assert "ReadSchema: struct<fullVisitorId:string,visitId:bigint,hit:struct<hitNumber:bigint,page:struct<pagePath:string>>>" in text
    assert "PartitionFilters" in text


def test_nested_layout_unnest_reads_two_leaves_and_agrees(spark, store):
    """A nested-layout table (hits inside the row): the zipped explode reads
    two leaves and gives the same rows as the split layout's hit table."""
    import uuid
    from weblytics.session import work_dir
    from weblytics.sources import SessionStore
    path = f"{work_dir(spark)}/test-nested/{uuid.uuid4().hex}"
    store.with_hits(store.all()).write.partitionBy("_table_suffix").parquet(path)
    nested = SessionStore(spark, path, layout="nested")
    flat = explore.unnest_hits(nested, "20240111", "20240120")
    text = _formatted(flat)
    assert "hits:array<struct<hitNumber:bigint,page:struct<pagePath:string>>>" in text
    split = explore.hit_columns(store.hit_rows("20240111", "20240120"))
    assert flat.exceptAll(split).count() == 0 and split.exceptAll(flat).count() == 0
    # and the nested layout's hit rows agree too
    assert nested.hit_rows().count() == store.hit_rows().count()


def test_hit_blocks_unnest_two_leaves(store):
    """The registered unnesting generates rows from arrays of bounded length."""
    flat = explore.unnest_hits(store, "20240111", "20240120")
    text = _formatted(flat)
    assert "Generate" in text
    assert "hits:array<struct<hitNumber:bigint,page:struct<pagePath:string>>>" in text
    rows = explore.hit_columns(store.hit_rows("20240111", "20240120"))
    assert flat.exceptAll(rows).count() == 0 and rows.exceptAll(flat).count() == 0


def test_history_reads_no_shard_after_the_period(spark, store):
    df = features.for_model(store, "history", "20240101", "20240110")
    from weblytics.operators.history import visitor_days
    text = _formatted(visitor_days(store.all().where("_table_suffix <= '20240110'")))
    assert "PartitionFilters: [isnotnull(_table_suffix" in text
    assert df.agg({"visit_date": "max"}).first()[0].isoformat() <= "2024-01-10"


def test_campaign_filter_pushed_to_scan(store):
    text = _formatted(reports.campaigns(store.between("20240101", "20240130")))
    assert "PushedFilters: [IsNotNull(trafficSource.campaign)" in text


def test_top_k_is_take_ordered(store):
    text = _formatted(reports.top_bounce_countries(store.all()))
    assert "TakeOrderedAndProject" in text


def test_temporal_metrics_broadcast(store):
    text = _plan(features.enriched(store.between("20240101", "20240121")))
    assert "BroadcastHashJoin" in text


def test_no_python_runs_in_any_registered_query(spark):
    """Every registered query (models included) stays on the JVM: no
    row-at-a-time or Arrow Python evaluation anywhere in its plan."""
    from conftest import SF_SMALL
    from weblytics.plans import catalogue
    python_nodes = ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas",
                    "FlatMapGroupsInPandas", "AggregateInPandas", "WindowInPandas")
    for name, fn in catalogue.queries().items():
        text = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not any(node in text for node in python_nodes), name
