"""Explicit schemas: the nested session table and the published table.

Every source is read with an explicit schema so that shards written at
different times (with different optional fields) read the same way and no
schema inference runs over a large directory.
"""

from pyspark.sql import types as T

_S = T.StringType()
_L = T.LongType()
_B = T.BooleanType()
_D = T.DoubleType()

TOTALS = T.StructType([
    T.StructField("pageviews", _L),
    T.StructField("timeOnSite", _L),
    T.StructField("transactions", _L),
    T.StructField("transactionRevenue", _L),
    T.StructField("bounces", _L),
    T.StructField("hits", _L),
])

TRAFFIC_SOURCE = T.StructType([
    T.StructField("source", _S),
    T.StructField("medium", _S),
    T.StructField("campaign", _S),
])

DEVICE = T.StructType([
    T.StructField("deviceCategory", _S),
    T.StructField("operatingSystem", _S),
    T.StructField("browser", _S),
    T.StructField("isMobile", _B),
])

GEO_NETWORK = T.StructType([
    T.StructField("continent", _S),
    T.StructField("country", _S),
    T.StructField("region", _S),
    T.StructField("city", _S),
])

HIT = T.StructType([
    T.StructField("hitNumber", _L),
    T.StructField("type", _S),
    T.StructField("page", T.StructType([
        T.StructField("pagePath", _S),
        T.StructField("pageTitle", _S),
    ])),
    T.StructField("eventInfo", T.StructType([
        T.StructField("eventCategory", _S),
        T.StructField("eventAction", _S),
        T.StructField("eventLabel", _S),
    ])),
    T.StructField("product", T.StructType([
        T.StructField("productSKU", _S),
        T.StructField("productName", _S),
        T.StructField("productCategory", _S),
        T.StructField("productRevenue", _L),
    ])),
])

# One row = one session.  ``_table_suffix`` (YYYYMMDD, string) is the
# directory partition column of the stored table; it is kept as a string so
# that range filters compare lexicographically like the shard suffixes do.
SESSION_FIELDS = [
    T.StructField("visitorId", _S),
    T.StructField("fullVisitorId", _S),
    T.StructField("visitId", _L),
    T.StructField("visitNumber", _L),
    T.StructField("visitStartTime", _L),
    T.StructField("date", _S),
    T.StructField("totals", TOTALS),
    T.StructField("trafficSource", TRAFFIC_SOURCE),
    T.StructField("device", DEVICE),
    T.StructField("geoNetwork", GEO_NETWORK),
    T.StructField("hits", T.ArrayType(HIT)),
]

SESSION = T.StructType(SESSION_FIELDS)
SUFFIX = "_table_suffix"
SESSION_WITH_SUFFIX = T.StructType(SESSION_FIELDS + [T.StructField(SUFFIX, _S)])

# Split layout: the session rows without the repeated field, and a child
# table with one row per hit, keyed by (fullVisitorId, visitId).  Both are
# partitioned by the shard suffix.
SESSION_ROW_FIELDS = [f for f in SESSION_FIELDS if f.name != "hits"]
SESSION_ROW_WITH_SUFFIX = T.StructType(SESSION_ROW_FIELDS + [T.StructField(SUFFIX, _S)])
HIT_ROW_WITH_SUFFIX = T.StructType([
    T.StructField("fullVisitorId", _S),
    T.StructField("visitId", _L),
    T.StructField("hit", HIT),
    T.StructField(SUFFIX, _S),
])

# Rows with at most a bounded number of a session's hits each.
HIT_BLOCK_WITH_SUFFIX = T.StructType([
    T.StructField("fullVisitorId", _S),
    T.StructField("visitId", _L),
    T.StructField("hits", T.ArrayType(HIT)),
    T.StructField(SUFFIX, _S),
])

# The published daily-predictions table, in column order.
PUBLISHED = T.StructType([
    T.StructField("unique_session_id", _S),
    T.StructField("label", _L),
    T.StructField("operatingSystem", _S),
    T.StructField("isMobile", _B),
    T.StructField("country", _S),
    T.StructField("region", _S),
    T.StructField("deviceCategory", _S),
    T.StructField("browser", _S),
    T.StructField("pageViews", _L),
    T.StructField("hits", _L),
    T.StructField("timeOnSite", _L),
    T.StructField("trafficMedium", _S),
    T.StructField("trafficSource", _S),
    T.StructField("campaign", _S),
    T.StructField("visitHour", _L),
    T.StructField("isOrganic", _L),
    T.StructField("eveningVisit", _L),
    T.StructField("avgTimePerPageView", _D),
    T.StructField("bounceRate", _D),
    T.StructField("conversionRate", _D),
    T.StructField("visitFrequency", _L),
    T.StructField("totalTransactionValue", _D),
    T.StructField("predictedLabel", _L),
    T.StructField("predictedProbability", _D),
    T.StructField("predictionDate", T.DateType()),
])
