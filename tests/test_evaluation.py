"""Evaluation operators on the fixed score, against Spark ML's evaluator."""

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from weblytics.operators import evaluation


def test_auc_matches_spark_evaluator(store):
    scored = evaluation.fixed_score(store.all())
    ours = evaluation.evaluate(scored).first().roc_auc
    ev = BinaryClassificationEvaluator(rawPredictionCol="predicted_probability", labelCol="label",
                                       metricName="areaUnderROC", numBins=0)
    theirs = ev.evaluate(scored.withColumn("label", F.col("label").cast("double")))
    assert abs(ours - theirs) < 1e-6


def test_confusion_sums_to_rows(store):
    scored = evaluation.fixed_score(store.all())
    rows = evaluation.confusion(scored).collect()
    assert sum(r.predicted_0 + r.predicted_1 for r in rows) == scored.count()


def test_metrics_consistent_with_confusion(store):
    scored = evaluation.fixed_score(store.all())
    cm = {r.expected_label: r for r in evaluation.confusion(scored).collect()}
    tp, fp = cm[1].predicted_1, cm[0].predicted_1
    fn, tn = cm[1].predicted_0, cm[0].predicted_0
    m = evaluation.evaluate(scored).first()
    assert abs(m.precision - tp / (tp + fp)) < 1e-6
    assert abs(m.recall - tp / (tp + fn)) < 1e-6
    assert abs(m.accuracy - (tp + tn) / (tp + fp + fn + tn)) < 1e-6


def test_auc_of_tiny_separated_scores_is_one(spark):
    rows = [(int(i >= 1000), 1e-5 + i * 1e-9, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "label long, predicted_probability double, predicted_label long")
    assert evaluation.roc_auc(df).first().roc_auc == 1.0
    assert evaluation.evaluate(df).first().roc_auc == 1.0


def test_single_class_gives_null_auc(spark):
    df = spark.createDataFrame([(1, 0.3, 0), (1, 0.9, 1)], "label long, predicted_probability double, predicted_label long")
    assert evaluation.evaluate(df).first().roc_auc is None
