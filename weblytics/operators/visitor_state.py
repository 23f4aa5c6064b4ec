"""Visitor history kept from day to day.

``history.prior_days`` derives every visitor's past from all shards.  A daily run
needs only what happened before its day: a snapshot per day holds (visitor,
sessions, revenue) of all days up to and including it.  The run of a day

1. reads that day's shard, and joins it with the last snapshot before the day:
   sessions and revenue of strictly earlier days;
2. adds the shard's sums to that snapshot and stores the result as its own.

A shard that arrives late adds its sums to the snapshot before it and to every later
snapshot; no session of another day is read again.  Every snapshot is a version
(``sources.versions``): a run that dies leaves the one before, and readers of
a replaced snapshot keep its files.  A snapshot lists the days it counts, written
with it: a late run that died goes on where it stopped, and entering a day again is
an error, so no shard counts twice.

A NULL visitor has no past (0 sessions, NULL revenue) and enters no snapshot.  Revenue
is NULL as long as no session had any.  A day without sessions has a snapshot too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import session_date
from ..session import children
from ..sources import versions
from .metrics import join_side

STATE = "fullVisitorId string, n_sessions long, revenue long"


def sums(sessions: DataFrame) -> DataFrame:
    """(fullVisitorId, n_sessions, revenue) of some sessions."""
    return (sessions.where(F.col("fullVisitorId").isNotNull()).groupBy("fullVisitorId")
            .agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("totals.transactionRevenue").cast("long").alias("revenue")))


def merged(one: DataFrame, other: DataFrame) -> DataFrame:
    return one.unionByName(other).groupBy("fullVisitorId").agg(
        F.sum("n_sessions").alias("n_sessions"), F.sum("revenue").alias("revenue"))


class VisitorState:
    """Snapshots under ``root``, one per day (YYYYMMDD)."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def days(self) -> list[str]:
        """The days entered, ascending."""
        return [d for d in children(self.spark, self.root) if versions.current(self.spark, f"{self.root}/{d}")]

    def snapshot(self, day: str) -> DataFrame:
        folder = versions.current(self.spark, f"{self.root}/{day}")
        if folder is None:
            raise KeyError(f"no snapshot of {day}")
        return self.spark.read.schema(STATE).parquet(f"{folder}/state")

    def counted(self, day: str) -> set[str]:
        """The days that a snapshot counts one by one (those of the seed aside)."""
        folder = versions.current(self.spark, f"{self.root}/{day}")
        return {r.day for r in self.spark.read.schema("day string").parquet(f"{folder}/days").collect()}

    def before(self, day: str) -> DataFrame:
        """The last snapshot of an earlier day (empty if there is none)."""
        earlier = [d for d in self.days() if d < day]
        return self.snapshot(earlier[-1]) if earlier else self.spark.createDataFrame([], STATE)

    def _store(self, day: str, state: DataFrame, days: set[str], replace: bool) -> None:
        root = f"{self.root}/{day}"
        folder = versions.new_folder(root)
        state.write.parquet(f"{folder}/state")
        self.spark.createDataFrame([(d,) for d in sorted(days)], "day string").coalesce(1).write.parquet(f"{folder}/days")
        versions.commit(self.spark, root, folder, replace)

    def seed(self, day: str, sessions: DataFrame) -> None:
        """Start from the sessions of all days up to ``day``."""
        if self.days():
            raise versions.AlreadyPresent(self.root)
        self._store(day, sums(sessions), {day}, replace=False)

    def enter(self, day: str, shard: DataFrame) -> None:
        """Count a day's shard, in order or late."""
        entered = self.days()
        if day in entered:
            raise versions.AlreadyPresent(f"{self.root}/{day}")
        mine = sums(shard)
        # the day itself comes last: it is entered when all later ones count it
        for later in (d for d in entered if d > day):
            days = self.counted(later)
            if day not in days:
                self._store(later, merged(self.snapshot(later), mine), days | {day}, replace=True)
        earlier = [d for d in entered if d < day]
        days = self.counted(earlier[-1]) if earlier else set()
        self._store(day, merged(self.before(day), mine), days | {day}, replace=False)

    def history(self, day: str, shard: DataFrame) -> DataFrame:
        """``shard`` (the day's sessions) plus ``visit_date``, ``visit_frequency`` and
        ``total_transaction_value``."""
        past = self.before(day).select("fullVisitorId", F.col("n_sessions").alias("visit_frequency"),
                                       F.col("revenue").alias("total_transaction_value"))
        out = join_side(shard.withColumn("visit_date", session_date("date")), past, {"fullVisitorId": "fullVisitorId"})
        return out.withColumn("visit_frequency", F.coalesce("visit_frequency", F.lit(0).cast("long")))
