"""Binary-classifier evaluation over a scored DataFrame, as aggregations.

Input columns: the 0/1 ``label``, the probability of label 1 and the
predicted 0/1 label.  The scored rows are reduced once to the numbers of positives
and negatives per distinct score; counts, log loss and the exact ROC AUC (rank sum
over range-partitioned scores) come from that stored table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import THRESHOLD
from ..session import materialise

EPS = 1e-15


def predict_at(prob: str = "predicted_probability", threshold: float = THRESHOLD):
    """Predicted label 1 when the probability of label 1 is >= threshold."""
    return F.when(F.col(prob) >= F.lit(threshold), F.lit(1)).otherwise(F.lit(0)).cast("long")


def tallies(scored: DataFrame, label: str = "label", prob: str = "predicted_probability",
            pred: str = "predicted_label") -> DataFrame:
    """(prob, pred, pos, neg, part): rows of each label per distinct score, stored
    and sorted by score over range partitions.  The scores are evaluated for this
    table only; every metric reads it."""
    y = F.col(label).cast("long")
    counted = scored.select(y.alias("y"), F.col(prob).cast("double").alias("prob"), F.col(pred).alias("pred")).groupBy(
        "prob", "pred").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal scores stay in one range
    return materialise(counted.repartitionByRange(n, "prob").withColumn("part", F.spark_partition_id()), "tallies")


def confusion(scored: DataFrame, label: str = "label", pred: str = "predicted_label") -> DataFrame:
    """One row per actual label: how many were predicted 0 and 1."""
    return (scored.groupBy(F.col(label).cast("long").alias("expected_label"))
            .agg(F.count_if(F.col(pred) == 0).alias("predicted_0"),
                 F.count_if(F.col(pred) == 1).alias("predicted_1"))
            .orderBy("expected_label"))


def _area(tally: DataFrame) -> DataFrame:
    """One row ``roc_auc``: the share of (positive, negative) pairs in order, ties
    counted half (NULL if a class is absent).  Negatives below a score are the
    sum of the earlier ranges plus a running sum inside the range."""
    known = tally.where(F.col("prob").isNotNull())
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)    # one row per range
    before = known.groupBy("part").agg(F.sum("neg").alias("neg")).select(
        "part", F.coalesce(F.sum("neg").over(earlier), F.lit(0)).alias("before"))
    per_score = known.groupBy("part", "prob").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    lower = Window.partitionBy("part").orderBy("prob").rowsBetween(Window.unboundedPreceding, -1)
    below = per_score.withColumn("lower", F.coalesce(F.sum("neg").over(lower), F.lit(0))).join(F.broadcast(before), "part")
    wide = "decimal(38,0)"
    # twice the pairs in order, exact in decimals
    twice = F.sum(F.col("pos").cast("decimal(18,0)") * (2 * (F.col("before") + F.col("lower")) + F.col("neg")).cast("decimal(19,0)"))
    total = below.agg(twice.cast(wide).alias("twice"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    pairs = F.col("p").cast("double") * F.col("n").cast("double")
    return total.select(F.when(pairs > 0, F.col("twice").cast("double") / (2 * pairs)).alias("roc_auc"))


def roc_auc(scored: DataFrame, label: str = "label", prob: str = "predicted_probability") -> DataFrame:
    """One-row DataFrame ``roc_auc`` (NULL if one class is absent)."""
    return _area(tallies(scored.withColumn("_pred", F.lit(0)), label, prob, "_pred"))


def evaluate(scored: DataFrame, label: str = "label", prob: str = "predicted_probability",
             pred: str = "predicted_label", digits: int | None = 6) -> DataFrame:
    """One row: precision, recall, accuracy, f1_score, log_loss, roc_auc.

    ``digits`` rounds the results: sums of doubles depend on how rows are
    split over tasks, so the last bits are not stable between runs."""
    tally = tallies(scored, label, prob, pred)
    p = F.least(F.greatest("prob", F.lit(EPS)), F.lit(1 - EPS))
    rows = F.col("pos") + F.col("neg")
    totals = tally.agg(
        *[F.sum(F.when(F.col("pred") == b, F.col(a)).otherwise(0)).cast("double").alias(n)
          for n, a, b in (("tp", "pos", 1), ("fp", "neg", 1), ("fn", "pos", 0), ("tn", "neg", 0))],
        F.try_divide(F.sum(-(F.col("pos") * F.ln(p) + F.col("neg") * F.ln(1 - p))), F.sum(rows)).alias("log_loss"),
    ).withColumn("roc_auc", F.lit(_area(tally).first().roc_auc).cast("double"))      # one row
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision = F.try_divide(tp, tp + fp)
    recall = F.try_divide(tp, tp + fn)
    metrics = totals.select(
        precision.alias("precision"),
        recall.alias("recall"),
        F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1_score"),
        F.col("log_loss"),
        F.col("roc_auc"),
    )
    if digits is not None:
        metrics = metrics.select(*[F.round(c, digits).alias(c) for c in metrics.columns])
    return metrics


def fixed_score(sessions: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """A model-free rational score, p = (1 + hits) / (6 + hits), for checking
    the evaluation operators against SQL (no exp, so every engine agrees)."""
    hits = F.coalesce(F.col("totals.hits"), F.lit(0)).cast("double")
    return (sessions
            .select(F.when(F.col("totals.transactions").isNull(), 0).otherwise(1).cast("long").alias("label"),
                    ((hits + 1) / (hits + 6)).alias("predicted_probability"))
            .withColumn("predicted_label", predict_at("predicted_probability", threshold)))
