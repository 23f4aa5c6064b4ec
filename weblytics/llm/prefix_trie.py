r"""Prefix trie of conversations.

Turns are ordered by turn number, and every conversation is rebuilt: it opens
with the first ``h`` turns of the first conversation of its family
(``conv_id - conv_id % family``; ``h = crc32(conv_id) % heads``), followed
by its own turns after its first ``h``.  Each distinct sequence of first turns
(role, text) is a node; conversations that start with it are its members.

Method, whole-sequence collapse:

1. identical rebuilt conversations become one sequence with a weight, its
   smallest conversation and the digest of its list of ends;
2. sequences that are proper prefixes of others are dropped by an anti-join:
   what stays are the leaves;
3. the prefixes of the collapsed sequences, weighted, are aggregated per node;
4. each node's saving belongs to the sequence of its smallest member.  A sequence
   owns a lower end of its path, so a node's subtree is the sum, over the
   sequences through it, of what they own at its depth or below.

A prefix is known by its depth and two 64-bit values: the exclusive or, over its
turns, of hashes of (position, role, text).  That can be summed block by
block, so neither positions nor running values need a conversation in one task:
rows are numbered inside range partitions and added up over partitions, and
running values are built inside blocks of ``BLOCK`` turns plus the sum of the
blocks before.  Texts are read once and never shuffled.  The list of ends is
hashed as a stream of bounded chunks; only that is in sequence per node, as the
digest itself is.

Edge cases: a NULL role or text is an empty one; NULL turns come first; turns with
the same number stand in the order of their hashes, so the result depends on no
file order; repeated rows are turns of their own; rows without conv_id belong to
no conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblytics.llm.common import map_arrow, shuffle_partitions, store

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 1024            # turns of one conversation that meet in one task
CHUNK = 65_536          # conversation ids of one hashed piece
NODE = ["depth", "a", "b"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, pos, t1, t2, words): the turns of each conversation, numbered from 0."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"), "turn",
        F.xxhash64(role, text).alias("t1"), F.xxhash64(text, F.lit(1), role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    order = [F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    n = shuffle_partitions(conversations.sparkSession)
    # one conversation may lie in many range partitions
    ranged = store(turns.repartitionByRange(n, F.col("conv"), *order)
                   .withColumn("part", F.spark_partition_id()), "trie-turns")
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n")).select(
        "conv", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("conv", "part").orderBy(*order)
    return (ranged.withColumn("rank", F.row_number().over(inside) - 1).join(offsets, ["conv", "part"])
            .select("conv", (F.col("rank") + F.col("offset")).alias("pos"), "t1", "t2", "words"))


def rebuild(turns: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """(conv, depth, a, b, words): every rebuilt conversation with its root row
    (depth 0) and its turns from 1; ``a`` and ``b`` hash position and turn."""
    head = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).alias("h")
    sizes = store(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")), "trie-sizes")
    base = (F.col("conv") - F.col("conv") % family).alias("base")
    convs = sizes.select("conv", head, base)
    first = sizes.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    lengths = convs.join(first, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    opening = turns.where((F.col("conv") % family == 0) & (F.col("pos") < heads - 1)).withColumnRenamed("conv", "base")
    opened = lengths.where(F.col("taken") > 0).join(opening, "base").where(F.col("pos") < F.col("taken")).select(
        "conv", (F.col("pos") + 1).alias("depth"), "t1", "t2", "words")
    own = turns.where(F.col("pos") >= (F.crc32(F.col("conv").cast("string").cast("binary")) % heads))
    rest = own.join(lengths, "conv").select(
        "conv", (F.col("pos") + 1 + F.col("taken") - F.col("h")).alias("depth"), "t1", "t2", "words")
    root = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("a"),
                        F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("words"))
    rows = opened.unionByName(rest).select(
        "conv", F.col("depth").cast("long"), F.xxhash64("depth", "t1", "t2").alias("a"),
        F.xxhash64("t2", "t1", "depth").alias("b"), "words")
    return store(rows.unionByName(root), "trie-rebuilt")


def running(rows: DataFrame, values: dict[str, tuple[str, object]], upwards: bool = True) -> DataFrame:
    """``rows`` plus running aggregates over the depths of each conversation, from
    the root down or from the end up.  ``values``: new column -> (column, aggregate)."""
    rows = rows.withColumn("block", F.expr(f"depth div {BLOCK}"))
    order = (lambda c: F.col(c).asc()) if upwards else (lambda c: F.col(c).desc())
    blocks = rows.groupBy("conv", "block").agg(*[f(c).alias(f"_{n}") for n, (c, f) in values.items()])
    earlier = Window.partitionBy("conv").orderBy(order("block")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    before = blocks.select("conv", "block", *[
        F.coalesce(f(f"_{n}").over(earlier), zero).alias(f"_{n}") for n, (_, f) in values.items()])
    inside = Window.partitionBy("conv", "block").orderBy(order("depth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    local = rows.withColumns({f"__{n}": f(c).over(inside) for n, (c, f) in values.items()})
    joined = local.join(before, ["conv", "block"])
    both = {n: F.col(f"_{n}").bitwiseXOR(F.col(f"__{n}")) if f is F.bit_xor else F.col(f"_{n}") + F.col(f"__{n}")
            for n, (_, f) in values.items()}
    return joined.withColumns(both).drop("block", *[f"_{n}" for n in values], *[f"__{n}" for n in values])


def ends_of(whole: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes at which conversations end.

    ``whole`` is range-partitioned by node and conversation; its pieces of at most
    ``CHUNK`` ids are joined in parallel, and one digest per node reads them in order."""
    inside = Window.partitionBy(*NODE, "part").orderBy("conv")
    pieces = (whole.withColumn("rank", F.row_number().over(inside) - 1)
              .withColumn("piece", F.expr(f"rank div {CHUNK}"))
              .groupBy(*NODE, "part", "piece")
              .agg(F.min("conv").alias("first"),
                   F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids")))
    n = shuffle_partitions(whole.sparkSession)
    ordered = pieces.select(*NODE, "first", "ids").repartition(n, *NODE).sortWithinPartitions(*NODE, "first")

    def run(batches):
        node, digest = None, None
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                key = (row["depth"], row["a"], row["b"])
                if key == node:
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = key, hashlib.sha256()
                digest.update(row["ids"].encode())
            yield _ends_batch(done)
        if node is not None:
            yield _ends_batch([(*node, digest.hexdigest())])

    return map_arrow(ordered, run, "depth long, a long, b long, ends_sha256 string")


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[], [], [], []]
    kinds = [pa.int64()] * 3 + [pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], [*NODE, "ends_sha256"])


def trie(rebuilt: DataFrame) -> DataFrame:
    """The nodes of rebuilt conversations."""
    spark = rebuilt.sparkSession
    n = shuffle_partitions(spark)
    # 1. a conversation is its last node; identical ones collapse
    whole = rebuilt.groupBy("conv").agg(F.max("depth").alias("depth"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    whole = store(whole.repartitionByRange(n, *NODE, "conv").withColumn("part", F.spark_partition_id()), "trie-whole")
    sequences = store(whole.groupBy(*NODE).agg(F.count(F.lit(1)).alias("weight"), F.min("conv").alias("conv")),
                      "trie-sequences")
    paths = running(
        rebuilt.join(sequences.select("conv", "weight", F.col("depth").alias("length")), "conv")
        .withColumnsRenamed({"a": "own_a", "b": "own_b"}),
        {"a": ("own_a", F.bit_xor), "b": ("own_b", F.bit_xor)})
    paths = store(paths, "trie-paths")
    # 2. leaves
    proper = paths.where(F.col("depth") < F.col("length")).select(*NODE).distinct()
    leaves = store(sequences.join(proper, NODE, "left_anti").select("conv", F.lit(1).cast("long").alias("leaf")),
                   "trie-leaves")
    # 3. weighted prefixes
    nodes = paths.join(leaves, "conv", "left").groupBy(*NODE).agg(
        F.sum("weight").alias("n_convs"), F.min("conv").alias("conv_id"),
        F.sum(F.coalesce("leaf", F.lit(0))).alias("n_leaves"), F.max("words").alias("words"),
        F.min(F.col("a").bitwiseXOR(F.col("own_a"))).alias("up_a"), F.min(F.col("b").bitwiseXOR(F.col("own_b"))).alias("up_b"))
    nodes = store(nodes, "trie-nodes")
    # 4. what each sequence owns, from its end up
    owned = nodes.select(F.col("conv_id").alias("conv"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("saving"))
    below = running(
        paths.select("conv", *NODE).join(owned, ["conv", "depth"], "left")
        .withColumn("saving", F.coalesce("saving", F.lit(0).cast("long"))),
        {"saved": ("saving", F.sum)}, upwards=False)

    # one aggregate per node of all that is counted elsewhere
    null = F.lit(None)
    counted = (
        below.select(*NODE, F.col("saved").alias("saved"), null.cast("long").alias("child"), null.cast("string").alias("ends"))
        .unionByName(nodes.where(F.col("depth") > 0).select(
            (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"),
            null.cast("long").alias("saved"), F.lit(1).cast("long").alias("child"), null.cast("string").alias("ends")))
        .unionByName(ends_of(whole).select(
            *NODE, null.cast("long").alias("saved"), null.cast("long").alias("child"), F.col("ends_sha256").alias("ends")))
        .groupBy(*NODE).agg(F.sum("saved").alias("saved_tokens"), F.coalesce(F.sum("child"), F.lit(0)).alias("n_children"),
                            F.coalesce(F.max("ends"), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"),
                           F.col("conv_id").alias("parent_conv_id"))
    return (nodes.join(counted, NODE).join(parents, ["depth", "up_a", "up_b"], "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"))


def build(conversations: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return trie(rebuild(turns_of(conversations), family, heads))
