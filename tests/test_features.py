"""Feature sets: columns, no fan-out, sampling modes."""

from pyspark.sql import functions as F

from weblytics.operators import features


def test_column_lists(store):
    df = store.between("20240101", "20240121")
    assert len(features.basic(df).columns) == 2 + 6
    assert len(features.extended(df).columns) == 2 + 16
    assert len(features.enriched(df).columns) == 2 + 28
    assert len(features.history(df, store.all()).columns) == 2 + 21


def test_no_fan_out(store):
    df = store.between("20240101", "20240121")
    n = df.count()
    assert features.basic(df).count() == n
    assert features.enriched(df).count() == n
    assert features.history(df, store.all(), p=None).count() == n


def test_enriched_as_written_masks_instead_of_dropping(store):
    df = store.between("20240101", "20240121")
    as_written = features.enriched(df)
    filtered = features.enriched(df, mode="filter")
    assert as_written.count() == df.count()
    assert filtered.count() < df.count()
    # unsampled negatives keep their row but lose bounce_rate
    kept = set(r[0] for r in filtered.select("unique_session_id").collect())
    masked = as_written.where(F.col("bounce_rate").isNull()).select("unique_session_id").collect()
    assert masked and all(r[0] not in kept for r in masked)


def test_scoring_set_keeps_all_and_ids(store):
    df = store.between("20240122", "20240130")
    out = features.history(df, store.all(), for_scoring=True)
    assert out.count() == df.count()
    assert {"fullVisitorId", "visitId", "label"} <= set(out.columns)
