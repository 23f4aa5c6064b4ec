"""Dimension metric tables, each grouped by exactly its join keys (so a later
left join can never multiply session rows).

All are computed on the period being prepared (training or hold-out).  They
are small in the number of groups; the plan pre-aggregates in the scan
tasks, and adaptive execution turns the later joins into broadcast joins
when the measured table is small, or keeps a shuffle join when it is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import is_converted, pct, session_date, weekday_name
from ..session import materialise

DEVICE_KEYS = ("operating_system", "device_category", "browser")


def traffic(sessions: DataFrame, rate_over_non_null: bool = False) -> DataFrame:
    """Per traffic source: visits, bounces, bounce percent.

    ``rate_over_non_null=False`` counts all rows (``COUNT(*)``);
    ``True`` counts non-NULL sources (``COUNT(source)``), which differs only
    for the NULL-source group, where the rate then is NULL (0 visits)."""
    source = F.col("trafficSource.source")
    visits = F.count(source) if rate_over_non_null else F.count(F.lit(1))
    return (sessions.groupBy(source.alias("source"))
            .agg(visits.alias("total_visits"),
                 F.sum("totals.bounces").alias("total_no_of_bounces"))
            .withColumn("bounce_rate", pct("total_no_of_bounces", "total_visits")))


def device(sessions: DataFrame) -> DataFrame:
    """Sessions per operating system x device category x browser."""
    return (sessions.groupBy(F.col("device.operatingSystem").alias("operating_system"),
                             F.col("device.deviceCategory").alias("device_category"),
                             F.col("device.browser").alias("browser"))
            .agg(F.count(F.lit(1)).alias("total_sessions_by_device")))


def temporal(sessions: DataFrame) -> DataFrame:
    """Sessions per weekday name x month (the year is not part of the key).
    At most 7 x 12 rows whatever the data size."""
    d = session_date("date")
    return (sessions.groupBy(weekday_name(d).alias("day_of_week"),
                             F.month(d).cast("long").alias("month"))
            .agg(F.count(F.lit(1)).alias("total_visits_day")))


def users(sessions: DataFrame) -> DataFrame:
    """Sessions per visitor in the period (later sessions included)."""
    return (sessions.groupBy("fullVisitorId")
            .agg(F.count(F.lit(1)).alias("visit_count")))


# key sets of the metric tables: number, columns
SOURCE_SET, DEVICE_SET, CALENDAR_SET, VISITOR_SET = range(4)
KEY_SETS = {
    SOURCE_SET: ("source",),
    DEVICE_SET: DEVICE_KEYS,
    CALENDAR_SET: ("day_of_week", "month"),
    VISITOR_SET: ("fullVisitorId",),
}


class PeriodTables:
    """All metric tables of a period from one scan of its sessions: one aggregate
    over the four key sets (``GROUPING SETS``), stored by key set.  Counts are partial in
    the scan tasks; a reader of one table reads its part only."""

    def __init__(self, sessions: DataFrame):
        d = session_date("date")
        keyed = sessions.select(
            F.col("trafficSource.source").alias("source"), F.col("device.operatingSystem").alias("operating_system"),
            F.col("device.deviceCategory").alias("device_category"), F.col("device.browser").alias("browser"),
            weekday_name(d).alias("day_of_week"), F.month(d).cast("long").alias("month"), "fullVisitorId",
            F.col("totals.bounces").alias("bounces"), is_converted().alias("converted"))
        keys = [k for names in KEY_SETS.values() for k in names]
        # a NULL key is a group of its own set; the grouping id tells the sets apart
        ids = {sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in names): n
               for n, names in KEY_SETS.items()}
        number = F.coalesce(*[F.when(F.grouping_id() == F.lit(i), F.lit(n)) for i, n in ids.items()])
        grouped = keyed.groupingSets([[F.col(k) for k in names] for names in KEY_SETS.values()], *keys).agg(
            number.alias("key_set"), F.count(F.lit(1)).alias("n"), F.sum("bounces").alias("bounces"),
            F.sum("converted").alias("converted"))
        self.stored = materialise(grouped, "period-metrics", partition_by=("key_set",))

    def _part(self, key_set: int) -> DataFrame:
        return self.stored.where(F.col("key_set") == key_set)

    def traffic(self, rate_over_non_null: bool = False) -> DataFrame:
        source = F.col("source")
        visits = F.when(source.isNull(), F.lit(0).cast("long")).otherwise(F.col("n")) if rate_over_non_null else F.col("n")
        return (self._part(SOURCE_SET).select("source", visits.alias("total_visits"), F.col("bounces").alias("total_no_of_bounces"))
                .withColumn("bounce_rate", pct("total_no_of_bounces", "total_visits")))

    def device(self) -> DataFrame:
        return self._part(DEVICE_SET).select(*DEVICE_KEYS, F.col("n").alias("total_sessions_by_device"))

    def temporal(self) -> DataFrame:
        return self._part(CALENDAR_SET).select("day_of_week", "month", F.col("n").alias("total_visits_day"))

    def users(self) -> DataFrame:
        return self._part(VISITOR_SET).select("fullVisitorId", F.col("n").alias("visit_count"))

    def conversion(self) -> DataFrame:
        return (self._part(DEVICE_SET).select(*DEVICE_KEYS, F.col("n").alias("total_sessions"),
                                              F.col("converted").alias("total_transactions"))
                .withColumn("conversion_rate", pct("total_transactions", "total_sessions")))


def join_stored(sessions: DataFrame, table: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join of a metric table; ``on`` maps session columns to its keys.

    The table is written first: its real size is then known when the join is
    planned (a small one is broadcast and no session moves), and a large one is
    joined over two plain shuffles, whose skewed partitions adaptive execution
    splits.  A NULL key part matches nothing; such sessions get a key of their
    own each, so they spread over all tasks."""
    return join_side(sessions, materialise(table, "metric"), on)


def join_side(sessions: DataFrame, stored: DataFrame, on: dict[str, str]) -> DataFrame:
    """``join_stored`` with a table that is stored already."""
    side = stored.select(
        *[F.col(k).alias(f"_side_{i}") for i, k in enumerate(on.values())],
        *[c for c in stored.columns if c not in on.values()])
    for i in range(len(on)):
        side = side.where(F.col(f"_side_{i}").isNotNull())
    first, *rest = on
    missing = F.lit(False)
    for k in on:
        missing = missing | F.col(k).isNull()
    alone = F.concat(F.lit("?"), F.xxhash64("fullVisitorId", "visitId", "visitStartTime", "date").cast("string"))
    keyed = sessions.withColumn("_key", F.when(missing, alone).otherwise(F.col(first)))
    condition = (F.col("_key") == F.col("_side_0")) & ~missing
    for i, k in enumerate(rest, start=1):
        condition = condition & (F.col(k) == F.col(f"_side_{i}"))
    return keyed.join(side, condition, "left").drop("_key", *[f"_side_{i}" for i in range(len(on))])


BY_DEVICE = {"device.operatingSystem": "operating_system", "device.deviceCategory": "device_category",
             "device.browser": "browser"}
BY_SOURCE = {"trafficSource.source": "source"}


def conversion(sessions: DataFrame) -> DataFrame:
    """Sessions, converted sessions and conversion percent per OS x device
    category x browser."""
    return (sessions.groupBy(F.col("device.operatingSystem").alias("operating_system"),
                             F.col("device.deviceCategory").alias("device_category"),
                             F.col("device.browser").alias("browser"))
            .agg(F.count(F.lit(1)).alias("total_sessions"),
                 F.sum(is_converted()).alias("total_transactions"))
            .withColumn("conversion_rate", pct("total_transactions", "total_sessions")))
