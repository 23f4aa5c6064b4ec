"""The ten descriptive reports over a period of sessions.

Each function takes the sessions of the period (already pruned to the
period's shards by the caller) and returns the report.  All are one
aggregation: partial aggregates run in the scan tasks, then one shuffle of
at most (tasks x groups) rows; a hot group (one browser or one source holding
a third of the sessions) costs nothing extra because it is pre-aggregated
before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_converted, or_default, pct, ratio, session_date, weekday_name
from ..functions.fixed import (CAMPAIGN_NOT_SET, MIN_CONVERSION_PCT, MIN_SESSIONS, REVENUE_UNIT,
                               TOP_COUNTRIES, UNKNOWN)


def _converted_sum():
    return F.sum(is_converted()).alias("total_transactions")


def _revenue_usd():
    return F.round(
        F.sum(or_default("totals.transactionRevenue", 0)).cast("double") / REVENUE_UNIT, 2
    ).alias("total_revenue_usd")


def tx_by_device_browser(sessions: DataFrame) -> DataFrame:
    """Sum of transactions per device category x browser; groups whose sum is
    NULL (no transaction at all) are dropped."""
    return (sessions
            .groupBy(F.col("device.deviceCategory").alias("deviceCategory"),
                     F.col("device.browser").alias("browser"))
            .agg(F.sum("totals.transactions").alias("total_transactions"))
            .where(F.col("total_transactions").isNotNull())
            .orderBy(F.col("deviceCategory").asc(), F.col("total_transactions").desc()))


def bounce_by_source(sessions: DataFrame) -> DataFrame:
    """Visits (non-NULL sources counted), bounces, unrounded bounce percent."""
    per_source = (sessions
                  .groupBy(F.col("trafficSource.source").alias("source"))
                  .agg(F.count("trafficSource.source").alias("total_visits"),
                       F.sum("totals.bounces").alias("total_bounces")))
    return (per_source
            .select("source", "total_visits", "total_bounces",
                    (ratio("total_bounces", "total_visits") * 100).alias("bounce_rate"))
            .orderBy(F.col("source").desc()))


def conversion_by_os_device_browser(sessions: DataFrame,
                                    min_rate: float = MIN_CONVERSION_PCT) -> DataFrame:
    """Conversion percent per OS x category x browser, kept above ``min_rate``."""
    return (sessions
            .groupBy(or_default("device.operatingSystem", UNKNOWN).alias("operating_system"),
                     or_default("device.deviceCategory", UNKNOWN).alias("device_category"),
                     or_default("device.browser", UNKNOWN).alias("browser"))
            .agg(F.count(F.lit(1)).alias("total_sessions"), _converted_sum())
            .withColumn("conversion_rate_percentage", pct("total_transactions", "total_sessions"))
            .where(F.col("conversion_rate_percentage") > min_rate)
            .orderBy(F.col("conversion_rate_percentage").desc()))


def purchaser_share(sessions: DataFrame) -> DataFrame:
    """Distinct visitors, distinct purchasing visitors, and their percent.

    Written as two aggregation levels instead of two DISTINCT counts over a
    cross join: first one row per visitor (did they ever buy), then a global
    count.  Exact, one scan, and a visitor with many sessions is collapsed by
    the partial aggregate before the shuffle."""
    visitors = (sessions
                .where(F.col("fullVisitorId").isNotNull())
                .groupBy("fullVisitorId")
                .agg(F.max(is_converted()).alias("bought")))
    totals = visitors.agg(F.count(F.lit(1)).alias("total_visitors"),
                          F.coalesce(F.sum("bought"), F.lit(0)).cast("long").alias("total_purchasers"))
    return totals.select("total_visitors", "total_purchasers",
                         pct("total_purchasers", "total_visitors").alias("conversion_rate_pct"))


def revenue_by_source_medium(sessions: DataFrame,
                             min_rate: float = MIN_CONVERSION_PCT) -> DataFrame:
    return (sessions
            .groupBy(F.col("trafficSource.source").alias("source"),
                     F.col("trafficSource.medium").alias("medium"))
            .agg(F.count(F.lit(1)).alias("total_sessions"), _converted_sum(), _revenue_usd())
            .withColumn("conversion_rate_percentage", pct("total_transactions", "total_sessions"))
            .where(F.col("conversion_rate_percentage") > min_rate)
            .orderBy(F.col("total_revenue_usd").desc()))


def top_bounce_countries(sessions: DataFrame, k: int = TOP_COUNTRIES,
                         min_sessions: int = MIN_SESSIONS) -> DataFrame:
    """Top-k countries by bounce percent among those with > min_sessions.

    The limit is the feature (a top-k report); country breaks ties so the
    result is deterministic.  Planned as TakeOrderedAndProject: each task
    keeps its own k best, the driver merges k x tasks rows."""
    bounces = F.sum(or_default("totals.bounces", 0))
    return (sessions
            .groupBy(F.col("geoNetwork.country").alias("country"))
            .agg(F.count(F.lit(1)).alias("total_sessions"), bounces.alias("total_bounces"))
            .withColumn("bounce_rate_percentage", pct("total_bounces", "total_sessions"))
            .where(F.col("total_sessions") > min_sessions)
            .orderBy(F.col("bounce_rate_percentage").desc(), F.col("country").asc_nulls_last())
            .limit(k))


def time_by_device(sessions: DataFrame) -> DataFrame:
    return (sessions
            .groupBy(F.col("device.deviceCategory").alias("device_category"))
            .agg(F.count(F.lit(1)).alias("total_sessions"),
                 F.round(F.avg(or_default("totals.timeOnSite", 0)), 2).alias("avg_time_on_site_seconds"))
            .orderBy(F.col("avg_time_on_site_seconds").desc()))


def campaigns(sessions: DataFrame, not_set: str = CAMPAIGN_NOT_SET) -> DataFrame:
    """Campaign comparison; undefined campaigns (NULL, ``not_set``) excluded."""
    camp = F.col("trafficSource.campaign")
    return (sessions
            .where(camp.isNotNull() & (camp != F.lit(not_set)))
            .groupBy(camp.alias("campaign"))
            .agg(F.count(F.lit(1)).alias("total_sessions"), _converted_sum(), _revenue_usd())
            .withColumn("conversion_rate_percentage", pct("total_transactions", "total_sessions"))
            .orderBy(F.col("total_revenue_usd").desc()))


def pageviews_by_browser(sessions: DataFrame, min_sessions: int = MIN_SESSIONS) -> DataFrame:
    return (sessions
            .groupBy(F.col("device.browser").alias("browser"))
            .agg(F.count(F.lit(1)).alias("total_sessions"),
                 F.round(F.avg(or_default("totals.pageviews", 0)), 2).alias("avg_pageviews_per_session"))
            .where(F.col("total_sessions") > min_sessions)
            .orderBy(F.col("avg_pageviews_per_session").desc()))


def sessions_by_weekday(sessions: DataFrame) -> DataFrame:
    """Sessions and converted sessions per weekday name (Sunday = day 1)."""
    return (sessions
            .groupBy(weekday_name(session_date("date")).alias("day_of_week"))
            .agg(F.count(F.lit(1)).alias("total_sessions"), _converted_sum())
            .orderBy(F.col("total_transactions").desc()))
