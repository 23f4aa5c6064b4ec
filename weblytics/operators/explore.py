"""Exploration queries over the session table: preview a shard, all sessions
with a known visitor, and one row per hit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S


def star(sessions: DataFrame) -> DataFrame:
    """``SELECT *`` of the session table (the shard suffix is a pseudo-column,
    not part of ``*``)."""
    return sessions.drop(S.SUFFIX)


def preview(shard: DataFrame, n: int = 100, order=("fullVisitorId", "visitId")) -> DataFrame:
    """``SELECT * FROM one_shard LIMIT n``.  Sorted by the session key first so
    the preview is the same on every run; planned as a top-n per task and a
    merge of n x tasks rows, never a full sort."""
    return star(shard).orderBy(*order).limit(n)


def known_visitors(sessions: DataFrame) -> DataFrame:
    """All sessions of the range whose ``visitorId`` is set."""
    return star(sessions.where(F.col("visitorId").isNotNull()))


def hit_columns(hit_rows: DataFrame) -> DataFrame:
    """Visitor, visit, hit number, page path from one-row-per-hit data (the
    hit table of the split layout): only the two hit leaves are read."""
    return hit_rows.select("fullVisitorId", "visitId",
                           F.col("hit.hitNumber").alias("hitNumber"),
                           F.col("hit.page.pagePath").alias("pagePath"))


def unnest_hits(store, start: str | None = None, end: str | None = None) -> DataFrame:
    """One row per hit: visitor, visit, hit number, page path, unnested from
    the ``hits`` arrays of a ``SessionStore``."""
    return store.hit_leaves(start, end).select("fullVisitorId", "visitId", "hitNumber", "pagePath")


def known_visitor_hits(store, start: str, end: str) -> DataFrame:
    """The hits of all sessions of the range whose ``visitorId`` is set, one
    row each: the companion of ``known_visitors``."""
    known = store.between(start, end).where(F.col("visitorId").isNotNull()).select(
        F.col("fullVisitorId").alias("_visitor"), F.col("visitId").alias("_visit"),
        F.col(S.SUFFIX).alias("_shard"))
    hits = store.hit_leaves(start, end)
    return (hits.join(known, F.col("fullVisitorId").eqNullSafe(F.col("_visitor"))
                      & F.col("visitId").eqNullSafe(F.col("_visit"))
                      & (F.col(S.SUFFIX) == F.col("_shard")), "left_semi")
            .select("fullVisitorId", "visitId", F.col(S.SUFFIX).alias("date"), "hitNumber", "pagePath"))


def flat(df: DataFrame) -> DataFrame:
    """Flatten struct columns to ``struct_leaf`` columns and render arrays as
    JSON text (NULL fields kept), so a nested result can be compared with
    another engine column by column."""
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, T.StructType):
            for sub in field.dataType.fields:
                cols.append(F.col(f"`{field.name}`.`{sub.name}`").alias(f"{field.name}_{sub.name}"))
        elif isinstance(field.dataType, T.ArrayType):
            cols.append(F.to_json(F.col(field.name), {"ignoreNullFields": "false"})
                        .alias(f"{field.name}_json"))
        else:
            cols.append(F.col(f"`{field.name}`"))
    return df.select(*cols)
