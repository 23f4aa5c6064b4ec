"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import shuffle_partitions, store

MAX_ROUNDS = 64
EDGES_PER_TASK = 50_000


def tasks_for(edges: DataFrame, n_edges: int) -> int:
    """How many tasks a step over ``n_edges`` edges is worth: one for every
    ``EDGES_PER_TASK``, two per core at least, and no more than there are shuffle
    partitions.  Few edges in very many partitions would take a task for each."""
    spark = edges.sparkSession
    return max(1, min(shuffle_partitions(spark), max(-(-n_edges // EDGES_PER_TASK), 2 * spark.sparkContext.defaultParallelism)))


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over undirected edges stored as (u, v), u > v; an edge may
    come out more than once.

    Large star: every node hands its smallest neighbour (or itself) to its
    larger neighbours.  Small star: to its smaller neighbours and itself."""
    both = edges.select("u", "v")
    if large:
        both = both.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")).coalesce(tasks)
    # under another name the minima have an exchange of their own, so adaptive execution
    # can split the rows of a node with very many neighbours
    minima = least.select(F.col("u").bitwiseXOR(F.lit(0).cast("long")).alias("w"), "m")
    moved = both.join(minima, F.col("u") == F.col("w")).drop("w").coalesce(tasks)
    if large:
        out = moved.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"),
                                       F.least("u", "v").alias("v"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the
    smallest node of the component.  Each round is written to the shared work
    folder; rounds grow with the logarithm of the longest path."""
    current = store(edges.filter("a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(MAX_ROUNDS):
        state = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        tasks = tasks_for(current, state[0])
        # a large star has no more edges than there were, so one removal of repeated
        # ones, after the small star, serves both
        stars = _star(_star(current, True, tasks), False, tasks)
        current = store(stars.distinct().coalesce(tasks), "edges")
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    # every node but the roots has one edge, to its root
    roots = current.select("v").distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
