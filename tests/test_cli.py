"""Command line on a stored session table."""

import uuid

from weblytics.__main__ import main
from weblytics.session import work_dir


def test_list(capsys):
    assert main(["list"]) == 0
    out = capsys.readouterr().out
    assert "an_conversion_by_os_device_browser" in out and "features_history" in out


def test_report_on_a_nested_table_matches_the_library(spark, store):
    from weblytics.operators import reports
    nested = f"{work_dir(spark)}/test-cli/{uuid.uuid4().hex}"
    store.with_hits(store.all()).write.partitionBy("_table_suffix").parquet(nested)
    out = f"{nested}-out"
    assert main(["report", "conversion_by_os_device_browser", "--sessions", nested,
                 "--start", "20240101", "--end", "20240130", "--out", out]) == 0
    got = spark.read.parquet(out)
    want = reports.conversion_by_os_device_browser(store.between("20240101", "20240130"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_run_registered_query(capsys, spark):
    from conftest import SF_SMALL
    assert main(["run", "an_time_by_device", "--sf-dir", SF_SMALL, "--show", "5"]) == 0
    assert "avg_time_on_site_seconds" in capsys.readouterr().out


def test_train_evaluate_publish_on_a_stored_table(spark, store, capsys):
    from weblytics.sources import published
    root = f"{work_dir(spark)}/test-cli/{uuid.uuid4().hex}"
    model, table = f"{root}/model", f"{root}/table"
    common = ["--sessions", store.root, "--layout", "split", "--model", model]
    assert main(["train", "history", "--start", "20240101", "--end", "20240121", *common]) == 0
    assert main(["evaluate", "history", "--start", "20240122", "--end", "20240130", *common]) == 0
    assert "roc_auc" in capsys.readouterr().out
    assert main(["publish", "--start", "20240122", "--end", "20240130", "--table", table,
                 "--run-date", "2024-02-01", *common]) == 0
    n = store.between("20240122", "20240130").count()
    assert published.read(spark, table, "2024-02-01").count() == n


def test_explore_commands(spark, store, capsys):
    common = ["--sessions", store.root, "--layout", "split", "--start", "20240115", "--end", "20240115"]
    assert main(["explore", "preview", *common, "--show", "2"]) == 0
    out = capsys.readouterr().out
    assert "hitNumber" in out or "hits" in out
    root = f"{work_dir(spark)}/test-cli/{uuid.uuid4().hex}"
    assert main(["explore", "hits", *common, "--out", root]) == 0
    assert spark.read.parquet(root).count() == store.hit_rows("20240115", "20240115").count()
