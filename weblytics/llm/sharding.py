"""Two-pass external shuffle of documents into shards.

Pass 1 scatters the records uniformly into memory-sized buckets by a seeded
hash of the whole row and its copy number; the scatter is one Spark exchange.  Rows
without a key, or with one key, spread like any others; rows that agree in every
column more than ``hot_rows`` times are counted and made anew with copy numbers,
so they spread too.  Pass 2 loads one bucket at a time, puts it into the order of
the rows' hashes (so a repeated task sees the same input), shuffles it with
Fisher-Yates from a generator seeded by (seed, bucket) and writes it.  A bucket's first position is the number of rows in the buckets
before it; shard ``s`` takes the positions ``floor(s N / S)`` up to
``floor((s + 1) N / S)``, so shard sizes differ by one row at most.

Edge cases: a NULL key is a value like any other; repeated rows keep their number;
NULL texts are kept as NULL and count as one byte; an empty table gives no
rows.  An input column named like an output column is replaced, all others are
kept.  Maps are not part of a row's hash; tables with maps get no copy numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, extended, group_arrow, shuffle_partitions, store

OUTPUT = ("shard", "slot")
HOT_ROWS = 1000


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniformly random order of ``n`` rows, the same for the same seed."""
    rng = np.random.default_rng(seed)
    order = list(range(n))
    # j_i uniform on 0 .. i for i = n - 1 down to 1
    draws = rng.integers(0, np.arange(n, 1, -1)) if n > 1 else []
    for i, j in zip(range(n - 1, 0, -1), np.asarray(draws).tolist()):
        order[i], order[j] = order[j], order[i]
    return np.asarray(order, dtype=np.int64)


def packed_rows(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(row, order, copy): each row as one struct, a hash of it, and a number that
    tells copies of a very frequent row apart (0 for all others)."""
    plain = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.xxhash64(*plain)
    rows = docs.select(F.struct(*columns).alias("row"), order.alias("order"), F.lit(0).cast("long").alias("copy"))
    if len(plain) < len(columns):
        return rows
    frequent = docs.groupBy(order.alias("hot")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).select("hot")
    if frequent.head() is None:
        return rows
    frequent = store(frequent, "hot-rows")
    counted = (rows.join(frequent, F.col("order") == F.col("hot"), "left_semi").groupBy("row", "order")
               .agg(F.count(F.lit(1)).alias("n")))
    copies = counted.select("row", "order", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    return rows.join(frequent, F.col("order") == F.col("hot"), "left_anti").unionByName(copies)


def bucket_of(seed: int, buckets: int):
    return F.pmod(F.xxhash64(F.lit(seed), "order", "copy"), F.lit(buckets)).cast("long")


def shuffled_buckets(rows: DataFrame, seed: int, buckets: int) -> DataFrame:
    """(row, bucket, pos): packed rows with their place in their bucket."""
    scattered = rows.withColumn("bucket", bucket_of(seed, buckets))

    def shuffle(bucket: pa.Table) -> pa.Table:
        number = bucket.column("bucket")[0].as_py()
        # rows with one hash and copy number are equal
        ordered = bucket.take(pc.sort_indices(bucket, sort_keys=[("order", "ascending"), ("copy", "ascending")]))
        mixed = ordered.take(pa.array(fisher_yates(len(ordered), (seed, number))))
        return mixed.select(["row", "bucket"]).append_column("pos", pa.array(np.arange(len(mixed)), pa.int64()))

    return group_arrow(scattered, "bucket", shuffle, extended(scattered.select("row", "bucket"), "pos long"))


def bucket_count(docs: DataFrame, text: str, bucket_bytes: int) -> tuple[int, int]:
    """Enough buckets that one holds about ``bucket_bytes`` of text, and at
    least two for each shuffle partition; and the tasks that write them: one for
    ``bucket_bytes``, two per core at least.  A little text in very many partitions
    would be as many tasks, each with files of its own in several shards."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    full = -(-int(total) // bucket_bytes)
    return max(full, 2 * shuffle_partitions(spark)), max(full, 2 * spark.sparkContext.defaultParallelism)


def shard(docs: DataFrame, shards: int = 8, seed: int = 17, key: str = "doc_id",
          text: str = "text", bucket_bytes: int = 16 << 20, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Write ``docs`` into ``shards`` shuffled shards (Parquet, one folder per shard,
    several files each, every file in slot order) in the shared work folder; returns
    the table read back: the input columns, ``shard`` and ``slot`` (gapless from 0)."""
    docs = drop_names(docs, OUTPUT)
    buckets, writers = bucket_count(docs, text, bucket_bytes)
    packed = packed_rows(docs, hot_rows)
    mixed = shuffled_buckets(packed, seed, buckets)
    counts = packed.groupBy(bucket_of(seed, buckets).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    # one row per bucket, so the running total is over a bounded table
    up_to = Window.orderBy("bucket")
    offsets = store(counts.select("bucket", (F.sum("n").over(up_to) - F.col("n")).alias("before")), "buckets")
    rows = docs.count()
    place = (F.col("before") + F.col("pos")).alias("place")
    placed = (mixed.join(offsets, "bucket").select("row", place)
              .withColumn("shard", F.expr(f"int(((place + 1) * {shards} - 1) div {max(rows, 1)})"))
              .select("row.*", "shard", F.expr(f"place - (shard * bigint({rows})) div {shards}").alias("slot")))
    return store(placed.coalesce(writers).sortWithinPartitions("shard", "slot"), "shards", partition_by=["shard"])
