"""A visitor's history before the current day.

For every session: how many sessions the same visitor had on strictly
earlier days (``visit_frequency``) and their summed revenue
(``total_transaction_value``), over all shards.  Written as correlated
subqueries this is a join of every session against all earlier rows of the
visitor.  Here it is:

1. one aggregate to (visitor, day) rows - partial aggregation, so a visitor
   holding a large share of all sessions is reduced in the scan tasks;
2. a running sum over the earlier days of each visitor, a window whose
   partition holds one row per active day of one visitor (bounded by the
   calendar, not by traffic);
3. an equi-join back to the sessions on (visitor, day), which spreads one
   busy visitor over as many keys as it has days.

Sessions on the same day see the same history (strictly earlier days only).
A NULL visitor matches nothing: 0 sessions and NULL revenue, exactly like
the correlated form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import session_date
from ..schema import SUFFIX
from .metrics import join_stored


def visitor_days(sessions_all: DataFrame) -> DataFrame:
    """(fullVisitorId, visit_date) -> visit_frequency, total_transaction_value."""
    per_day = (sessions_all
               .where(F.col("fullVisitorId").isNotNull())
               .groupBy("fullVisitorId", session_date("date").alias("visit_date"))
               .agg(F.count(F.lit(1)).alias("n_sessions"),
                    F.sum("totals.transactionRevenue").alias("day_revenue")))
    earlier = (Window.partitionBy("fullVisitorId").orderBy("visit_date")
               .rowsBetween(Window.unboundedPreceding, -1))
    return per_day.select(
        "fullVisitorId", "visit_date",
        F.coalesce(F.sum("n_sessions").over(earlier), F.lit(0)).cast("long").alias("visit_frequency"),
        F.sum("day_revenue").over(earlier).alias("total_transaction_value"),
    )


def with_history(sessions: DataFrame, sessions_all: DataFrame,
                 start: str | None = None, end: str | None = None) -> DataFrame:
    """``sessions`` plus ``visit_date``, ``visit_frequency`` and
    ``total_transaction_value``.  ``start`` / ``end`` (YYYYMMDD) restrict the
    history rows to the dates of the period before the join.  A session's
    date equals its shard suffix, so shards after ``end`` are never read."""
    if end is not None:
        sessions_all = sessions_all.where(F.col(SUFFIX) <= F.lit(end))
    hist = visitor_days(sessions_all)
    if start is not None:
        hist = hist.where(F.col("visit_date") >= F.to_date(F.lit(start), "yyyyMMdd"))
    s = sessions.withColumn("visit_date", session_date("date"))
    out = join_stored(s, hist, {"fullVisitorId": "fullVisitorId", "visit_date": "visit_date"})
    return out.withColumn("visit_frequency", F.coalesce("visit_frequency", F.lit(0).cast("long")))


def prior_days(sessions_all: DataFrame) -> DataFrame:
    """The history of every session of all shards (W1 alone)."""
    out = with_history(sessions_all, sessions_all)
    return out.select("fullVisitorId", "visitId", "visit_date",
                      "visit_frequency", "total_transaction_value")
