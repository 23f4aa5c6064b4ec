"""The four per-session feature sets used to train and score the models.

* ``basic``    (set A):  6 features
* ``extended`` (set B): 16 features, negatives sampled at p = 0.1
* ``enriched`` (set C): 28 features from the metric tables; the p = 0.05
  draw sits in the join condition of the traffic metrics (see ``enriched``)
* ``history``  (set D): 21 features with the visitor history, negatives
  sampled at p = 0.05; without sample and with ids for scoring

Every set starts with ``unique_session_id`` (``fullVisitorId-visitId``): it
is not a feature, it is the key of the repeatable sample and split and of
the published rows.  Row count in = row count out for every join (all metric
tables are grouped by exactly their join keys).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions.fixed import (MISSING_CATEGORY, ORGANIC, SAMPLE_ENRICHED, SAMPLE_EXTENDED,
                               SAMPLE_HISTORY)
from ..functions.sampling import keep_positives
from . import history as H
from . import metrics as M

KEY = "unique_session_id"


def _common() -> dict[str, Column]:
    """Features shared by the sets, by output name, in the sets' order."""
    return {
        "os": X.or_default("device.operatingSystem", MISSING_CATEGORY),
        "is_mobile": F.col("device.isMobile"),
        "country": X.or_default("geoNetwork.country", MISSING_CATEGORY),
        "region": X.or_default("geoNetwork.region", MISSING_CATEGORY),
        "device_category": F.col("device.deviceCategory"),
        "browser": F.col("device.browser"),
        "pageviews": X.or_default("totals.pageviews", 0).cast("long"),
        "hits": X.or_default("totals.hits", 0).cast("long"),
        "time_on_site": X.or_default("totals.timeOnSite", 0).cast("long"),
        "traffic_medium": X.or_default("trafficSource.medium", MISSING_CATEGORY),
        "traffic_source": X.or_default("trafficSource.source", MISSING_CATEGORY),
        "campaign": X.or_default("trafficSource.campaign", MISSING_CATEGORY),
        "visit_hour": X.utc_hour("visitStartTime"),
        "is_organic": X.flag(F.col("trafficSource.medium") == F.lit(ORGANIC)),
        "evening_visit": X.evening_visit(X.utc_hour("visitStartTime")),
        "avg_time_per_pageview": X.per_unit(F.col("totals.timeOnSite"), F.col("totals.pageviews"), 2),
        "pageviews_per_hit": X.per_unit(F.col("totals.pageviews"), F.col("totals.hits"), 3),
    }


def _head() -> list[Column]:
    return [X.session_key().alias(KEY), X.is_converted().alias("label")]


def _pick(names: list[str]) -> list[Column]:
    common = _common()
    return [common[n].alias(n) for n in names]


BASIC = ["os", "is_mobile", "country", "pageviews", "time_on_site", "traffic_medium"]

EXTENDED = ["os", "is_mobile", "country", "region", "device_category", "browser",
            "pageviews", "hits", "time_on_site", "traffic_medium", "traffic_source",
            "campaign", "visit_hour", "is_organic", "evening_visit", "avg_time_per_pageview"]

ENRICHED = ["os", "is_mobile", "country", "region", "device_category", "browser",
            "pageviews", "hits", "time_on_site", "traffic_medium", "traffic_source",
            "campaign", "visit_hour", "day_of_week", "month", "is_weekend", "day_of_month",
            "time_on_site_category", "bounce_rate", "sessions_by_device_type", "is_organic",
            "avg_time_per_pageview", "total_visits_user", "device_country",
            "medium_timeofday", "browser_os", "visits_day_of_week", "pageviews_per_hit"]

HISTORY = ["os", "is_mobile", "country", "region", "device_category", "browser",
           "pageviews", "hits", "time_on_site", "traffic_medium", "traffic_source",
           "campaign", "visit_hour", "bounce_rate", "conversion_rate", "is_organic",
           "evening_visit", "avg_time_per_pageview", "visit_frequency",
           "total_transaction_value", "visit_date"]

CATEGORICAL = {"os", "country", "region", "device_category", "browser", "traffic_medium",
               "traffic_source", "campaign", "day_of_week", "time_on_site_category",
               "device_country", "medium_timeofday", "browser_os"}


def basic(sessions: DataFrame) -> DataFrame:
    """Set A over the sessions of a period."""
    return sessions.select(*_head(), *_pick(BASIC))


def extended(sessions: DataFrame, p: float | None = SAMPLE_EXTENDED,
             seed: int | None = 42) -> DataFrame:
    """Set B; every converted session kept, others with probability ``p``
    (``None`` keeps all)."""
    if p is not None:
        sessions = sessions.where(keep_positives(p, seed))
    return sessions.select(*_head(), *_pick(EXTENDED))


def enriched(sessions: DataFrame, p: float | None = SAMPLE_ENRICHED, seed: int | None = 42,
             mode: str = "as_written") -> DataFrame:
    """Set C: sessions enriched with the period's metric tables.

    The sampling condition of this set is part of the LEFT JOIN condition of
    the traffic metrics, so no row is dropped: an unsampled negative keeps
    its row but gets a NULL ``bounce_rate``.  ``mode="as_written"`` (default)
    reproduces that by joining plainly and masking with the draw;
    ``mode="filter"`` applies the draw as a row filter instead.  ``p=None``
    joins without any condition."""
    if mode not in ("as_written", "filter"):
        raise ValueError("mode must be 'as_written' or 'filter'")
    base = sessions
    if p is not None:
        base = base.withColumn("_drawn", keep_positives(p, seed))
        if mode == "filter":
            base = base.where(F.col("_drawn"))
    # the metric tables always see the whole period
    tables = M.PeriodTables(sessions)
    main = main_dataset(base, tables=tables)
    main = M.join_side(main, tables.traffic().select("source", "bounce_rate"), M.BY_SOURCE)
    bounce = F.col("bounce_rate")
    if p is not None and mode == "as_written":
        bounce = F.when(F.col("_drawn"), bounce)
    common = _common()
    cols = [(bounce if n == "bounce_rate" else F.col(n) if n in MAIN_EXTRA else common[n]).alias(n)
            for n in ENRICHED]
    return main.select(*_head(), *cols)


MAIN_EXTRA = ["day_of_week", "month", "is_weekend", "day_of_month", "device_country",
              "medium_timeofday", "browser_os", "time_on_site_category", "total_visits_user",
              "visits_day_of_week", "sessions_by_device_type"]


def main_dataset(sessions: DataFrame, tables: M.PeriodTables | None = None) -> DataFrame:
    """Every session column plus calendar features, crossed categories, the
    time-on-site category and three joined counts: the visitor's sessions in
    the period (default 1), sessions on the same weekday x month (default 0)
    and sessions of the same OS x category x browser (default 0; a NULL key
    part never matches).  ``tables``: the metric tables of the period the counts
    are taken from (default: of ``sessions``)."""
    tables = M.PeriodTables(sessions) if tables is None else tables
    d = X.session_date("date")
    hour = X.utc_hour("visitStartTime")
    base = sessions.select(
        "*",
        X.weekday_name(d).alias("day_of_week"),
        F.month(d).cast("long").alias("month"),
        X.flag(X.weekday_name(d).isin(*X.WEEKEND)).alias("is_weekend"),
        F.dayofmonth(d).cast("long").alias("day_of_month"),
        F.concat(F.col("device.deviceCategory"), F.lit("_"), F.col("geoNetwork.country")).alias("device_country"),
        F.concat(F.col("trafficSource.medium"), F.lit("_"), X.time_of_day(hour)).alias("medium_timeofday"),
        F.concat(F.col("device.browser"), F.lit("_"), F.col("device.operatingSystem")).alias("browser_os"),
        X.time_on_site_category(F.col("totals.timeOnSite")).alias("time_on_site_category"),
    )
    joined = M.join_side(base, tables.users(), {"fullVisitorId": "fullVisitorId"})
    # at most 7 x 12 rows: a broadcast whose size is bounded by the calendar
    joined = joined.join(F.broadcast(tables.temporal()), ["day_of_week", "month"], "left")
    joined = M.join_side(joined, tables.device(), M.BY_DEVICE)
    return joined.select(
        *[F.col(f"`{c}`") for c in sessions.columns],
        "day_of_week", "month", "is_weekend", "day_of_month", "device_country",
        "medium_timeofday", "browser_os", "time_on_site_category",
        F.coalesce("visit_count", F.lit(1)).cast("long").alias("total_visits_user"),
        F.coalesce("total_visits_day", F.lit(0)).cast("long").alias("visits_day_of_week"),
        F.coalesce("total_sessions_by_device", F.lit(0)).cast("long").alias("sessions_by_device_type"),
    )


def history(sessions: DataFrame, sessions_all: DataFrame, p: float | None = SAMPLE_HISTORY,
            seed: int | None = 42, start: str | None = None, end: str | None = None,
            for_scoring: bool = False) -> DataFrame:
    """Set D: the period's traffic (non-NULL source count) and conversion
    metrics plus the visitor's history over all shards (``sessions_all``).

    The metric tables use the whole period; the draw (``p``) then keeps every
    converted session and a repeatable share of the others.  ``for_scoring``
    keeps every session and adds ``fullVisitorId`` and ``visitId``."""
    tables = M.PeriodTables(sessions)
    traffic = tables.traffic(rate_over_non_null=True).select("source", "bounce_rate")
    conv = tables.conversion().select(*M.DEVICE_KEYS, "conversion_rate")

    s = sessions
    if p is not None and not for_scoring:
        s = s.where(keep_positives(p, seed))
    s = H.with_history(s, sessions_all, start, end)
    joined = M.join_side(M.join_side(s, traffic, M.BY_SOURCE), conv, M.BY_DEVICE)
    common = _common()
    own = {"bounce_rate", "conversion_rate", "visit_frequency", "total_transaction_value", "visit_date"}
    cols = [(F.col(n) if n in own else common[n]).alias(n) for n in HISTORY]
    ids = [F.col("fullVisitorId"), F.col("visitId")] if for_scoring else []
    return joined.select(*_head(), *ids, *cols)


def sampled(sessions: DataFrame, p: float, seed: int | None = 42) -> DataFrame:
    """The class-balancing sample alone: key, label and date of the kept sessions."""
    return (sessions.where(keep_positives(p, seed))
            .select(*_head(), "date"))


def for_model(store, name: str, start: str, end: str, for_scoring: bool = False) -> DataFrame:
    """The feature set of model ``name`` (basic / extended / enriched /
    history) over the shards ``start``..``end`` of a ``SessionStore``."""
    s = store.between(start, end)
    if name == "basic":
        return basic(s)
    if name == "extended":
        return extended(s, p=None if for_scoring else SAMPLE_EXTENDED)
    if name == "enriched":
        return enriched(s, p=None if for_scoring else SAMPLE_ENRICHED)
    if name == "history":
        return history(s, store.all(), start=start, end=end, for_scoring=for_scoring)
    raise KeyError(name)
