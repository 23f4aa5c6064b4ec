"""Versioned tables, ledgers, and writers that die."""

import threading
import uuid

import pytest

from weblytics.session import file_system, work_dir
from weblytics.sources import published, versions


def root_of(spark):
    return f"{work_dir(spark)}/test-versions/{uuid.uuid4().hex}"


def rows(spark, n, date="2024-01-31"):
    return spark.range(n).selectExpr("cast(id as string) unique_session_id", "id % 2 label", f"date'{date}' predictionDate",
                                     *[f"cast(null as {f.dataType.simpleString()}) {f.name}"
                                       for f in published.S.PUBLISHED.fields[2:] if f.name != "predictionDate"])


def test_readers_keep_what_they_opened(spark):
    root = root_of(spark)
    published.create_or_replace(rows(spark, 5), root, replace=False)
    before = published.open_table(spark, root)
    published.create_or_replace(rows(spark, 3, "2024-02-01"), root)
    assert before.count() == 5 and published.open_table(spark, root).count() == 3
    with pytest.raises(versions.AlreadyPresent):
        published.create_or_replace(rows(spark, 1), root, replace=False)
    with pytest.raises(FileNotFoundError):
        published.open_table(spark, root_of(spark))


def test_a_run_is_entered_once(spark):
    root = root_of(spark)
    assert published.read_runs(spark, root).count() == 0
    assert published.append_run(rows(spark, 4), root, "a")
    assert not published.append_run(rows(spark, 4), root, "a")
    assert published.append_run(rows(spark, 4), root, "b")
    # a run whose writer died before its marker, and one that died in it
    rows(spark, 9).write.partitionBy("predictionDate").parquet(f"{root}/runs/run=dead")
    import hashlib
    fs, marker = file_system(spark, f"{root}/ledger/{hashlib.sha256(b'c').hexdigest()}")
    fs.create(marker, False).close()
    assert published.read_runs(spark, root).count() == 8
    assert published.append_run(rows(spark, 2, "2024-02-01"), root, "c")
    assert published.read_runs(spark, root).count() == 10


def test_one_of_two_creators_succeeds(spark):
    root, outcomes = root_of(spark), []
    folders = [versions.new_folder(root) for _ in range(4)]

    def create(folder):
        try:
            versions.commit(spark, root, folder, replace=False)
            outcomes.append(folder)
        except versions.AlreadyPresent:
            outcomes.append(None)

    threads = [threading.Thread(target=create, args=(f,)) for f in folders]
    [t.start() for t in threads]
    [t.join() for t in threads]
    won = [o for o in outcomes if o]
    assert len(won) == 1 and versions.current(spark, root) == won[0]


def test_replacers_all_get_a_number(spark):
    root = root_of(spark)
    threads = [threading.Thread(target=versions.commit, args=(spark, root, versions.new_folder(root))) for _ in range(5)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert versions.numbers(spark, root) == [1, 2, 3, 4, 5]


def test_one_creator_succeeds_in_every_race(spark):
    for _ in range(25):
        root, won = root_of(spark), []
        start = threading.Barrier(6)

        def create(folder):
            start.wait()
            try:
                versions.commit(spark, root, folder, replace=False)
                won.append(folder)
            except versions.AlreadyPresent:
                pass

        threads = [threading.Thread(target=create, args=(versions.new_folder(root),)) for _ in range(6)]
        [t.start() for t in threads]
        [t.join() for t in threads]
        assert len(won) == 1 and versions.current(spark, root) == won[0]
