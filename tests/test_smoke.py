"""Every registered query runs at sf0.001 and returns its declared columns
(the model queries included, which have no SQL oracle)."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from weblytics.plans import catalogue

NAMES = list(catalogue.queries())


@pytest.mark.parametrize("name", [n for n in NAMES if n.startswith(("ml_", "pub_"))])
def test_model_queries_run(spark, name):
    df = E.queries()[name](spark, SF_SMALL)
    columns = df.columns
    rows = df.collect()
    assert len(rows) >= 1
    assert all(len(r) == len(columns) for r in rows)


def test_every_query_is_registered_once_and_builds(spark):
    assert len(NAMES) == len(set(NAMES)) == 84
    for name in NAMES:
        if name.startswith(("ml_", "pub_")):
            continue
        assert E.queries()[name](spark, SF_SMALL).columns


def test_model_query_shapes(spark):
    qs = E.queries()
    assert qs["ml_train_history"](spark, SF_SMALL).count() == 1
    assert qs["ml_evaluate_history"](spark, SF_SMALL).columns == [
        "precision", "recall", "accuracy", "f1_score", "log_loss", "roc_auc"]
    conf = qs["ml_confusion_history"](spark, SF_SMALL)
    assert conf.columns == ["expected_label", "predicted_0", "predicted_1"]
    pub = qs["pub_daily_predictions"](spark, SF_SMALL)
    assert len(pub.columns) == 25
    assert pub.count() == qs["feat_history_score"](spark, SF_SMALL).count()


def test_sf_dir_spelling_does_not_matter(spark):
    from weblytics.sources.fixture import session_store
    a = session_store(spark, SF_SMALL)
    b = session_store(spark, SF_SMALL + "/")
    assert a is b
    assert E.queries()["an_time_by_device"](spark, SF_SMALL + "/").count() == \
        E.queries()["an_time_by_device"](spark, SF_SMALL).count()
