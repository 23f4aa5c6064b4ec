"""The sharded session table: one Parquet folder per day (``_table_suffix``).

Equivalent of reading one daily shard, a suffix range of shards, or all
shards.  Suffix filters become ``PartitionFilters`` (files of other days are
never opened), and selected struct leaves become a pruned ``ReadSchema``.

Two layouts are read:

* ``nested`` - one row per session with the repeated ``hits`` field inside
  (the shape of an analytics export);
* ``split``  - ``<root>/sessions`` holds the session rows without ``hits``,
  ``<root>/hits`` one row per hit (``fullVisitorId``, ``visitId``, ``hit``), and
  ``<root>/blocks`` the hits in blocks of a bounded number (``hits`` arrays).
  Nothing ever has to hold all hits of a session in one value, so a session
  with an unbounded number of hits is as cheap as any other; the nested shape
  is assembled only for the rows a ``SELECT *`` returns (``with_hits``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..session import children

KEYS = ["fullVisitorId", "visitId"]
LEAVES = ("hitNumber", "page.pagePath")


def read_sessions(spark: SparkSession, root: str, nested: bool = True) -> DataFrame:
    """All shards, read with the explicit schema (no inference; a shard that
    lacks a column reads it as NULL)."""
    schema = S.SESSION_WITH_SUFFIX if nested else S.SESSION_ROW_WITH_SUFFIX
    return spark.read.schema(schema).parquet(root)


def _suffix_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.where(F.col(S.SUFFIX) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(S.SUFFIX) <= F.lit(end))
    return df


class SessionStore:
    """Handle on a stored session table (``layout`` = "split" or "nested").
    ``export``: gives the folder of ``hits`` or ``blocks`` where they are written
    on first use (default: they are under ``root``)."""

    def __init__(self, spark: SparkSession, root: str, layout: str = "split",
                 key: str | None = None, export: Callable[[str], str] | None = None):
        if layout not in ("split", "nested"):
            raise ValueError("layout must be 'split' or 'nested'")
        self.spark = spark
        self.root = root.rstrip("/")
        self.layout = layout
        self._key = key
        self._export = export
        self._base: DataFrame | None = None
        self._hits: DataFrame | None = None
        self._shards: list[str] | None = None

    # -- session rows -------------------------------------------------------
    def all(self) -> DataFrame:
        """Every shard (no suffix filter).  The folder is
        listed once per store; every query filters that one relation, so its
        partition list is reused and the pruning happens per query."""
        if self._base is None:
            if self.layout == "split":
                self._base = read_sessions(self.spark, f"{self.root}/sessions", nested=False)
            else:
                self._base = read_sessions(self.spark, self.root, nested=True)
        return self._base

    def shard(self, day: str) -> DataFrame:
        """One daily shard, ``day`` = YYYYMMDD."""
        return self.all().where(F.col(S.SUFFIX) == F.lit(day))

    def between(self, start: str, end: str) -> DataFrame:
        """The shards whose suffix is between ``start`` and ``end`` (string
        comparison, both ends included)."""
        return self.all().where(F.col(S.SUFFIX).between(F.lit(start), F.lit(end)))

    # -- hits ---------------------------------------------------------------
    def _folder(self, table: str) -> str:
        return self._export(table) if self._export is not None else f"{self.root}/{table}"

    def hit_rows(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """One row per hit: ``fullVisitorId``, ``visitId``, ``hit`` (struct),
        ``_table_suffix``."""
        if self.layout == "split":
            if self._hits is None:
                self._hits = self.spark.read.schema(S.HIT_ROW_WITH_SUFFIX).parquet(self._folder("hits"))
            return _suffix_range(self._hits, start, end)
        sessions = _suffix_range(self.all(), start, end)
        return sessions.select(*KEYS, F.explode("hits").alias("hit"), S.SUFFIX)

    def hit_blocks(self, start: str | None = None, end: str | None = None) -> DataFrame:
        """Rows with a bounded ``hits`` array each (several per session)."""
        if self.layout == "nested":
            return _suffix_range(self.all(), start, end).select(*KEYS, "hits", S.SUFFIX)
        blocks = self.spark.read.schema(S.HIT_BLOCK_WITH_SUFFIX).parquet(self._folder("blocks"))
        return _suffix_range(blocks, start, end)

    def hit_leaves(self, start: str | None = None, end: str | None = None,
                   leaves: tuple[str, ...] = LEAVES) -> DataFrame:
        """One row per hit with the wanted leaves only (named by their last
        part): they are zipped before the explode, so the scan reads just
        them.  A NULL or empty ``hits`` gives no row (inner lateral join)."""
        names = [leaf.rsplit(".", 1)[-1] for leaf in leaves]
        zipped = F.arrays_zip(*[F.col(f"hits.{leaf}").alias(n) for leaf, n in zip(leaves, names)])
        rows = self.hit_blocks(start, end).select(*KEYS, S.SUFFIX, F.explode(zipped).alias("hit"))
        return rows.select(*KEYS, S.SUFFIX, *[F.col(f"hit.{n}").alias(n) for n in names])

    def with_hits(self, sessions: DataFrame, start: str | None = None, end: str | None = None,
                  max_sessions: int | None = None) -> DataFrame:
        """``sessions`` (rows of this store, suffix range ``start``..``end``)
        in the nested shape, with the ``hits`` array.

        The split layout assembles the arrays here, ordered by hit number.
        ``max_sessions`` states a proven upper bound on the number of
        ``sessions`` rows (e.g. a preview limit); the hits are then cut down
        with a broadcast semi-join on those keys before being grouped."""
        if self.layout == "nested":
            return sessions
        # a visit split at midnight has one id in two shards: the shard (equal
        # to the session's date) is part of the key, and a NULL visitor is a value
        mine = ["_visitor", "_visit", "_shard"]
        hits = self.hit_rows(start, end).select(
            F.col("fullVisitorId").alias("_visitor"), F.col("visitId").alias("_visit"),
            F.col(S.SUFFIX).alias("_shard"), "hit")

        def same(left: DataFrame, right: DataFrame):
            return (left["fullVisitorId"].eqNullSafe(right["_visitor"])
                    & left["visitId"].eqNullSafe(right["_visit"]) & (left["date"] == right["_shard"]))

        if max_sessions is not None:
            # the limit again, so that the broadcast cannot exceed what is stated
            few = sessions.select(*KEYS, "date").limit(max_sessions)
            hits = hits.join(F.broadcast(few), same(few, hits), "left_semi")
        hits_type = dict((f.name, f.dataType) for f in S.SESSION_FIELDS)["hits"]
        arrays = hits.groupBy(*mine).agg(
            F.array_sort(F.collect_list("hit")).cast(hits_type).alias("hits"))
        out = sessions.join(arrays, same(sessions, arrays), "left")
        # every input column, with ``hits`` where the nested schema has it
        cols = list(sessions.columns)
        at = cols.index("geoNetwork") + 1 if "geoNetwork" in cols else len(cols)
        cols.insert(at, "hits")
        return out.select(*[F.col(f"`{c}`") for c in cols])

    @property
    def key(self) -> str:
        """Identity of the stored data (given by the exporter, else a digest of
        the whole path); stored models are filed under it."""
        return self._key or hashlib.sha1(self.root.encode()).hexdigest()[:16]

    def shards(self) -> list[str]:
        """Suffixes of the shards present (a folder listing)."""
        root = f"{self.root}/sessions" if self.layout == "split" else self.root
        return [n.split("=", 1)[1] for n in children(self.spark, root) if n.startswith(f"{S.SUFFIX}=")]

    def require(self, start: str, end: str) -> None:
        """Error unless a shard lies between ``start`` and ``end``."""
        if self._shards is None:
            self._shards = self.shards()
        if not any(start <= s <= end for s in self._shards):
            raise ValueError(f"no shard between {start} and {end} in {self.root}")

    def refresh(self) -> "SessionStore":
        """Forget the folder listings (after new shards were written)."""
        self._base = None
        self._hits = None
        self._shards = None
        return self

    def __repr__(self) -> str:
        return f"SessionStore({self.root!r}, layout={self.layout!r})"
