"""The repeatable class-balancing draw."""

from pyspark.sql import functions as F

from weblytics.functions import sampling
from weblytics.operators import features


def test_threshold_hex():
    assert sampling.threshold_hex(0.1) == "1999999a"
    assert sampling.threshold_hex(0.05) == "0ccccccd"
    assert sampling.threshold_hex(0.0) == "00000000"


def test_draw_is_repeatable_and_keeps_positives(store):
    df = store.between("20240101", "20240121")
    a = features.sampled(df, 0.1).select("unique_session_id").collect()
    b = features.sampled(df.repartition(7), 0.1).select("unique_session_id").collect()
    assert sorted(a) == sorted(b)
    positives = df.where(F.col("totals.transactions").isNotNull()).count()
    kept_pos = features.sampled(df, 0.1).where("label = 1").count()
    assert kept_pos == positives


def test_draw_rate_is_close_to_p(store):
    df = store.all().withColumn("k", F.concat(F.col("fullVisitorId"), F.lit("-"), F.col("visitId")))
    n = df.count()
    kept = df.where(sampling.draw(0.5, seed=1, key=F.col("k"))).count()
    assert abs(kept / n - 0.5) < 0.1


def test_split_independent_of_sample(store):
    """The eval split uses another seed: kept negatives are not all in eval."""
    from weblytics.plans.ml import MODELS
    df = features.history(store.between("20240101", "20240121"), store.all())
    neg = df.where("label = 0")
    ev = neg.where(sampling.in_eval_split(0.2, MODELS["history"].split_seed,
                                          key=F.col("unique_session_id"))).count()
    assert ev < neg.count()


def test_sessions_without_a_visitor_are_sampled_too(store):
    df = store.all().withColumn("fullVisitorId", F.lit(None).cast("string"))
    negatives = df.where("totals.transactions IS NULL").count()
    assert features.sampled(df, 1.0).count() == df.count()
    kept = features.sampled(df, 0.5).where("label = 0").count()
    assert 0.3 * negatives < kept < 0.7 * negatives


def test_draw_edges(store):
    import pytest
    df = store.all().withColumn("k", F.concat(F.col("fullVisitorId"), F.lit("-"), F.col("visitId")))
    n = df.count()
    assert df.where(sampling.draw(1.0, key=F.col("k"))).count() == n
    assert df.where(sampling.draw(0.0, key=F.col("k"))).count() == 0
    with pytest.raises(ValueError):
        sampling.threshold_hex(1.5)
