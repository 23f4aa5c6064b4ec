"""Export the session table from the event-level test tables.

One session = (user, calendar day, half day).  The export writes the split
layout (see ``sessions.SessionStore``):

* session rows: one aggregation of events by session key with map-side
  partial aggregation (a very active user is reduced in the scan tasks
  before the shuffle), the visit number (a window per user over sessions,
  bounded by the calendar: two sessions per day), and a join to the
  customer / nation / region dimensions;
* hit rows: the hit number (row number in the session by time, event id)
  without ever gathering a session in one place: events are counted per
  (session, second), a running count over the seconds of a session (at most
  43,200 rows per session) gives the hits before each second, and a row
  number inside one (session, second) finishes it.  A session with any
  number of hits is spread over as many tasks as it has seconds.

Both are written partitioned by the shard suffix; queries then read them
like the sharded source table, with partition pruning.  A store writes a table
when it is first read: queries over sessions do not wait for hits.
"""

from __future__ import annotations

import hashlib
import inspect
import os
import sys
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .. import schema as S
from ..session import app_id, children, configure, file_stamp, path_exists, work_dir
from .sessions import SessionStore

# Fixed values of the test-table mapping, indexed by id modulo the list size
# (None = NULL).  Operating system and browser by user id, device category by
# user id, source / medium / campaign by the session's first event id.
OPERATING_SYSTEMS = ["Windows", "Macintosh", "Android", "iOS", None]
DEVICE_CATEGORIES = ["desktop", "mobile", "tablet"]
BROWSERS = ["Chrome", "Safari", "Firefox", "Edge"]
SOURCES = ["google", "(direct)", "partner", "youtube"]
MEDIUMS = ["organic", "cpc", "referral", "(none)", None]
CAMPAIGNS = ["promo_a", "promo_b", "(not set)", None, None, None]
VISITOR_ID_NULL_EVERY = 10   # visitorId is NULL when user_id % 10 = 0
REGION_NULL_EVERY = 7        # geoNetwork.region is NULL when user_id % 7 = 0
PAGE_PATH_BUCKETS = 10       # pagePath = '/' || event_type || '/' || event_id % 10
REVENUE_SCALE = 1_000_000    # revenue is stored as money x 10^6
BLOCK_HITS = 64              # hits of one row of the nested blocks


def _pick(values: list, key: Column) -> Column:
    """values[key % len(values)] as a string column (NULL entries allowed)."""
    arr = F.array(*[F.lit(v).cast("string") for v in values])
    return F.element_at(arr, (F.pmod(key, F.lit(len(values))) + 1).cast("int"))


def _null_struct(dtype: T.DataType) -> Column:
    return F.lit(None).cast(dtype)


def _hit_struct() -> Column:
    hit_fields = {f.name: f.dataType for f in S.HIT.fields}
    page_path = F.concat(F.lit("/"), F.col("event_type"), F.lit("/"),
                         F.pmod(F.col("event_id"), F.lit(PAGE_PATH_BUCKETS)).cast("string"))
    return F.struct(
        F.col("hitNumber").cast("long").alias("hitNumber"),
        F.when(F.col("event_type") == "view", F.lit("PAGE")).otherwise(F.lit("EVENT")).alias("type"),
        F.struct(page_path.alias("pagePath"),
                 F.lit(None).cast("string").alias("pageTitle")).alias("page"),
        _null_struct(hit_fields["eventInfo"]).alias("eventInfo"),
        _null_struct(hit_fields["product"]).alias("product"),
    )


def _user_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id -> continent, country, market segment.  nation (25 rows) and
    region (5 rows) are fixed-size TPC-H dimensions: broadcast is safe; the
    customer table grows with the data and is joined by a shuffle."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_nationkey", "c_mktsegment")
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", "n_name", "n_regionkey")
    region = spark.read.parquet(f"{sf_dir}/region.parquet").select("r_regionkey", "r_name")
    return (customer
            .join(F.broadcast(nation), customer.c_nationkey == nation.n_nationkey, "left")
            .join(F.broadcast(region), nation.n_regionkey == region.r_regionkey, "left")
            .select(F.col("c_custkey").alias("user_id"), "n_name", "r_name", "c_mktsegment"))


SESSION_KEY = ["user_id", "day", "half"]


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (spark.read.parquet(f"{sf_dir}/events.parquet")
            .select("event_id", "ts", "user_id", "event_type", "value")
            .withColumn("day", F.to_date("ts"))
            .withColumn("half", (F.hour("ts") >= 12).cast("int"))
            .withColumn("sec", F.unix_timestamp("ts")))


def derive_session_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Session rows (every session field but ``hits``) plus the suffix."""
    configure(spark)
    ev = _events(spark, sf_dir)
    purchase = F.col("event_type") == "purchase"
    sessions = ev.groupBy(*SESSION_KEY).agg(
        F.min("sec").alias("start_sec"),
        F.max("sec").alias("end_sec"),
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("event_type") == "view").alias("n_views"),
        F.count_if(purchase).alias("n_purchases"),
        F.sum(F.when(purchase, F.round(F.col("value") * REVENUE_SCALE).cast("long"))).alias("revenue"),
        F.min("event_id").alias("first_event_id"),
    )
    # visit number per user: sessions per user are bounded by the calendar
    # (two per day), so this window partition stays small for any user
    by_user = Window.partitionBy("user_id").orderBy("start_sec", "half")
    sessions = sessions.withColumn("visit_number", F.row_number().over(by_user).cast("long"))
    sessions = sessions.join(_user_geo(spark, sf_dir), "user_id", "left")

    uid = F.col("user_id")
    first_id = F.col("first_event_id")
    nullif0 = lambda x: F.when(x != 0, x.cast("long"))
    return sessions.select(
        F.when(F.pmod(uid, F.lit(VISITOR_ID_NULL_EVERY)) != 0, uid.cast("string")).alias("visitorId"),
        uid.cast("string").alias("fullVisitorId"),
        F.col("start_sec").alias("visitId"),
        F.col("visit_number").alias("visitNumber"),
        F.col("start_sec").alias("visitStartTime"),
        F.date_format("day", "yyyyMMdd").alias("date"),
        F.struct(
            nullif0(F.col("n_views")).alias("pageviews"),
            nullif0(F.col("end_sec") - F.col("start_sec")).alias("timeOnSite"),
            nullif0(F.col("n_purchases")).alias("transactions"),
            F.col("revenue").alias("transactionRevenue"),
            F.when(F.col("n_events") == 1, F.lit(1).cast("long")).alias("bounces"),
            F.col("n_events").cast("long").alias("hits"),
        ).alias("totals"),
        F.struct(
            _pick(SOURCES, first_id).alias("source"),
            _pick(MEDIUMS, first_id).alias("medium"),
            _pick(CAMPAIGNS, first_id).alias("campaign"),
        ).alias("trafficSource"),
        F.struct(
            _pick(DEVICE_CATEGORIES, uid).alias("deviceCategory"),
            _pick(OPERATING_SYSTEMS, uid).alias("operatingSystem"),
            _pick(BROWSERS, uid).alias("browser"),
            (F.pmod(uid, F.lit(3)) != 0).alias("isMobile"),
        ).alias("device"),
        F.struct(
            F.col("r_name").alias("continent"),
            F.col("n_name").alias("country"),
            F.when(F.pmod(uid, F.lit(REGION_NULL_EVERY)) != 0, F.col("c_mktsegment")).alias("region"),
            F.lit(None).cast("string").alias("city"),
        ).alias("geoNetwork"),
        F.date_format("day", "yyyyMMdd").alias(S.SUFFIX),
    )


def derive_hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per hit: ``fullVisitorId``, ``visitId``, ``hit``, suffix.

    hitNumber = (hits of the session in earlier seconds) + (row number by
    time, event id inside the second).  Every window here is bounded: by the
    seconds of a half day, or by one visitor's events within one second."""
    configure(spark)
    ev = _events(spark, sf_dir)
    session = Window.partitionBy(*SESSION_KEY)
    earlier_seconds = session.orderBy("sec").rowsBetween(Window.unboundedPreceding, -1)
    per_second = (ev.groupBy(*SESSION_KEY, "sec").agg(F.count(F.lit(1)).alias("n"))
                  .select(*SESSION_KEY, "sec",
                          F.coalesce(F.sum("n").over(earlier_seconds), F.lit(0)).alias("before"),
                          F.min("sec").over(session).alias("visit_id")))
    in_second = Window.partitionBy(*SESSION_KEY, "sec").orderBy("ts", "event_id")
    hits = (ev.join(per_second, SESSION_KEY + ["sec"])
            .withColumn("hitNumber", F.col("before") + F.row_number().over(in_second)))
    return hits.select(
        F.col("user_id").cast("string").alias("fullVisitorId"),
        F.col("visit_id").alias("visitId"),
        _hit_struct().alias("hit"),
        F.date_format("day", "yyyyMMdd").alias(S.SUFFIX),
    )


def _write(rows: DataFrame, path: str) -> None:
    """Write ``rows`` partitioned by shard suffix.

    Rows are rebalanced by suffix: adaptive execution puts small days together
    and splits a busy day over several tasks by the measured size of its
    shuffled rows, so the rows are derived once (range partitions would derive
    them a second time, to sample their bounds) and there are few files.  The
    overwrite is static: a dynamic one leaves no ``_SUCCESS``, and an export
    without it is never used again."""
    (rows.hint("rebalance", F.col(S.SUFFIX))
     .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(S.SUFFIX).parquet(path))


def _blocks(stored: DataFrame) -> DataFrame:
    """Rows with at most ``BLOCK_HITS`` hits of a session, from hit rows."""
    number = F.floor((F.col("hit.hitNumber") - 1) / BLOCK_HITS)
    return (stored.groupBy("fullVisitorId", "visitId", S.SUFFIX, number.alias("block"))
            .agg(F.array_sort(F.collect_list("hit")).alias("hits")).drop("block"))


def _stored_hits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.HIT_ROW_WITH_SUFFIX).parquet(path)


def export_sessions(spark: SparkSession, sf_dir: str, root: str) -> SessionStore:
    """Write the split layout: ``<root>/sessions``, ``<root>/hits`` and
    ``<root>/blocks`` (arrays of at most ``BLOCK_HITS`` hits), partitioned by
    shard suffix."""
    _write(derive_session_rows(spark, sf_dir), f"{root}/sessions")
    _write(derive_hit_rows(spark, sf_dir), f"{root}/hits")
    _write(_blocks(_stored_hits(spark, f"{root}/hits")), f"{root}/blocks")
    return SessionStore(spark, root, layout="split")


def _fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Key of an export: the text of the exporting code, the input folder, and
    name, size and modification time of every input file."""
    h = hashlib.sha1(_abs(sf_dir).encode())
    for module in (sys.modules[__name__], S):
        h.update(inspect.getsource(module).encode())
    for name in ("events", "customer", "nation", "region"):
        h.update(f"|{name}:{file_stamp(spark, f'{sf_dir}/{name}.parquet')}".encode())
    return h.hexdigest()[:16]


def _abs(path: str) -> str:
    return path if "://" in path else os.path.abspath(path)


_EXPORTED: dict[tuple[str, str], SessionStore] = {}
_LOCK = threading.RLock()


def _exported(spark: SparkSession, sf_dir: str, base: str, table: str) -> str:
    """The first complete folder of ``table`` under ``base``, in name order; where
    there is none the table is written, and blocks from the stored hits."""
    with _LOCK:  # one export even when several threads ask at once
        done = [c for c in children(spark, base) if path_exists(spark, f"{base}/{c}/{table}/_SUCCESS")]
        if done:
            return f"{base}/{done[0]}/{table}"
        if table == "sessions":
            rows = derive_session_rows(spark, sf_dir)
        elif table == "hits":
            rows = derive_hit_rows(spark, sf_dir)
        else:
            rows = _blocks(_stored_hits(spark, _exported(spark, sf_dir, base, "hits")))
        path = f"{base}/{uuid.uuid4().hex}/{table}"
        _write(rows, path)
        return path


def session_store(spark: SparkSession, sf_dir: str) -> SessionStore:
    """The exported session table for ``sf_dir``: the session rows are exported
    here on first use, hit rows and blocks when the store is first asked for them.

    Lives under the cluster's shared work folder, keyed by the input files, so
    it is reused by later queries and survives the loss of any executor.
    Every export of a table writes its own uniquely named folder under that key
    and is used only once it is committed, so two processes that export the same
    input at the same time never write into each other's files; readers take the
    first complete copy in name order."""
    configure(spark)
    # keyed by the running application: a new SparkContext never sees
    # DataFrames of a stopped one
    key = (app_id(spark), _abs(sf_dir))
    with _LOCK:
        if key not in _EXPORTED:
            fingerprint = _fingerprint(spark, sf_dir)
            base = f"{work_dir(spark)}/weblytics/sessions/{fingerprint}"
            root = _exported(spark, sf_dir, base, "sessions").rsplit("/", 1)[0]
            _EXPORTED[key] = SessionStore(spark, root, layout="split", key=fingerprint,
                                          export=lambda table: _exported(spark, sf_dir, base, table))
        return _EXPORTED[key]
