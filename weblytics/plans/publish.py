"""Score the hold-out sessions with the history model and publish them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import THRESHOLD
from ..sources import published
from . import ml

# published name <- feature-set / scoring column
RENAMES = [
    ("unique_session_id", "unique_session_id"), ("label", "label"),
    ("operatingSystem", "os"), ("isMobile", "is_mobile"), ("country", "country"),
    ("region", "region"), ("deviceCategory", "device_category"), ("browser", "browser"),
    ("pageViews", "pageviews"), ("hits", "hits"), ("timeOnSite", "time_on_site"),
    ("trafficMedium", "traffic_medium"), ("trafficSource", "traffic_source"),
    ("campaign", "campaign"), ("visitHour", "visit_hour"), ("isOrganic", "is_organic"),
    ("eveningVisit", "evening_visit"), ("avgTimePerPageView", "avg_time_per_pageview"),
    ("bounceRate", "bounce_rate"), ("conversionRate", "conversion_rate"),
    ("visitFrequency", "visit_frequency"), ("totalTransactionValue", "total_transaction_value"),
    ("predictedLabel", "predicted_label"), ("predictedProbability", "predicted_probability"),
]


def predictions(model: ml.Classifier, scoring_features: DataFrame,
                threshold: float = THRESHOLD) -> DataFrame:
    """Scored sessions: the scoring feature set plus label and probability."""
    return ml.score(model, scoring_features, threshold)


def daily_table(scored: DataFrame, run_date: str | None = None) -> DataFrame:
    """The 25 published columns; ``predictionDate`` is ``run_date``
    (YYYY-MM-DD) or today's date when not given."""
    date = F.to_date(F.lit(run_date)) if run_date else F.current_date()
    cols = [F.col(src).alias(dst) for dst, src in RENAMES]
    return published.conform(scored.select(*cols, date.alias("predictionDate")))


def publish(scored: DataFrame, path: str, run_date: str | None = None,
            mode: str = "replace_dates") -> None:
    published.write(daily_table(scored, run_date), path, mode)
