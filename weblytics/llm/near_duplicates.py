r"""Near-duplicate documents by HyperMinHash.

1. A document is the set of its distinct 5-word shingles (``width``; 64-bit hashes;
   A-Z folded, words are runs of ``[^\x20\x09-\x0D]``).  Every shingle falls
   into one of 128 buckets; a bucket keeps its smallest hash as a 16-bit
   register: the leading-zero count and the next 10 bits (the mantissa).
2. Documents with equal sets are one class; only classes go on.
3. Four neighbouring registers are a band, 32 bands in all.  Two sets with a
   similarity of 0.8 miss each other in every band with a probability below
   1e-7.  Band keys held by one class alone are dropped.
4. Among the classes that share a band key, registers give a Jaccard estimate,
   corrected for accidental register collisions; pairs far below the limit
   (five standard deviations) are ruled out.  Per key, as many plausible pairs
   are returned as connect all of them, never all pairs.  A key that many hold
   is split into blocks, compared two by two.
5. Classes connected by plausible pairs form a cluster, which is compared on
   full sets in units of at most two blocks of classes; pairs already connected
   are skipped.  A cluster with very many blocks is compared per band key
   instead, in blocks as well, so a unit's memory is bounded and no pair is
   left out.  A unit returns links that connect what it verified.
6. Components of the links; a component's id is its smallest document id.

Edge cases: documents without words or text have no shingles, are linked with
nothing and kept, with their own id as component; a NULL id takes part, its
component is the smallest non-NULL id (NULL if there is none) and it is not
``kept`` beside a non-NULL one; repeated rows share a class and, if they repeat
the smallest id, are all ``kept``; an empty table gives no rows.  ``kept`` is
about ids; ``keep_one`` decides per row: rows that share an id, or have none,
may be in different components, and each component keeps exactly one row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import map_arrow, ship, store
from weblytics.llm.graph import connected_components
from weblytics.llm.hashing import (FOLD_AZ, batches_of, mix, text_buffer, window_hashes, word_class,
                                   words_of)

BUCKET_BITS = 7
MANTISSA_BITS = 10
BUCKETS = 1 << BUCKET_BITS
REST_BITS = 64 - BUCKET_BITS
BAND = 4  # registers of 16 bits: a band is one 64-bit word


@dataclass(frozen=True)
class NearOptions:
    width: int = 5
    percent: int = 80
    #: a unit's block: so many classes and shingles at most (one class at least)
    block_classes: int = 1024
    block_shingles: int = 1 << 20
    #: clusters of more blocks are compared per band key
    cluster_blocks: int = 32
    #: standard deviations below the limit at which an estimate rules a pair out
    deviations: float = 5.0


def shingle_sets(column, width: int):
    """Sorted distinct shingle hashes of each text of a column."""
    data, offsets = text_buffer(column)
    words = words_of(data, offsets, word_class("nonspace"), FOLD_AZ)
    windows = window_hashes(words.hashes, width)
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= width:
            yield np.unique(windows[a:b - width + 1])
        elif b > a:
            yield window_hashes(words.hashes[a:b], b - a)
        else:
            yield windows[:0]


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 16-bit registers of a sorted set; 0 is an empty bucket."""
    out = np.zeros(BUCKETS, dtype=np.uint16)
    bucket = (shingles >> np.uint64(REST_BITS)).astype(np.int64)
    first = np.flatnonzero(np.diff(bucket, prepend=-1))
    rest = shingles[first] & np.uint64((1 << REST_BITS) - 1)
    bits = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    zeros = np.maximum(REST_BITS - bits, 0)
    # the MANTISSA_BITS bits after the leading one
    aligned = rest << np.minimum(zeros + 1, 63).astype(np.uint64)
    mantissa = (aligned >> np.uint64(REST_BITS - MANTISSA_BITS)) & np.uint64((1 << MANTISSA_BITS) - 1)
    out[bucket[first]] = ((zeros + 1) << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def level_chances(sizes: np.ndarray) -> np.ndarray:
    """Chance that a bucket's register has each leading-zero count, by set size."""
    level = np.arange(1, REST_BITS + 1)
    n = sizes.astype(np.float64)[:, None]
    return (1 - 0.5 ** level / BUCKETS) ** n - (1 - 0.5 ** (level - 1) / BUCKETS) ** n


def signatures(docs: DataFrame, key: str, text: str, opt: NearOptions) -> DataFrame:
    """Per row: key, text hash, set size, set hash (16 bytes) and registers."""
    def run(batches):
        for batch in batches:
            column = batch.column(2)
            for a, b in batches_of(column):
                sizes, classes, regs = [], [], []
                for s in shingle_sets(column.slice(a, b - a), opt.width):
                    sizes.append(len(s))
                    with np.errstate(over="ignore"):
                        classes.append(np.array(
                            [mix(s).sum(), mix(s + np.uint64(0x9E3779B97F4A7C15)).sum()],
                            dtype=np.uint64).tobytes())
                    regs.append(registers(s).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a),
                     pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(regs, pa.binary())],
                    ["doc_id", "text_hash", "n_shingles", "class", "registers"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"),
                       F.xxhash64(f"`{text}`").alias("text_hash"), F.col(f"`{text}`").alias("text"))
    return map_arrow(rows, run, "doc_id long, text_hash long, n_shingles long, class binary, registers binary")


def classes_of(signed: DataFrame) -> DataFrame:
    """One row per distinct non-empty set, with a 64-bit ``node`` number."""
    grouped = signed.filter("n_shingles > 0").groupBy("class").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("sample"),
        # the row to keep: a NULL id comes last
        F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("first_row"),
        F.max("n_shingles").alias("n_shingles"), F.max("registers").alias("registers"))
    for seed in range(8):
        found = store(grouped.withColumn("node", F.xxhash64(F.lit(seed), "class")), "classes")
        if found.groupBy("node").count().filter("count > 1").isEmpty():
            return found
    raise RuntimeError("no seed gives the sets different numbers")


def band_keys(classes: DataFrame) -> DataFrame:
    """(key, node): a row for every band that is not empty."""
    def run(batches):
        salt = np.arange(BUCKETS // BAND, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD95)
        for batch in batches:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint64)
            bands = raw.reshape(batch.num_rows, BUCKETS // BAND)
            row, band = np.nonzero(bands)
            keys = mix(mix(bands[row, band]) + salt[band])
            nodes = batch.column(0).take(pa.array(row))
            for a in range(0, len(row), 1 << 16):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[a:a + (1 << 16)].view(np.int64)), nodes.slice(a, 1 << 16)], ["key", "node"])

    return map_arrow(classes.select("node", "registers"), run, "key long, node long")


def shared_keys(keys: DataFrame) -> DataFrame:
    """(key, node, blocks) of the keys that two classes or more hold."""
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keys.join(counts, "key").select("key", "node", "n")


def plausible(regs: np.ndarray, chance: np.ndarray, one, many, opt: NearOptions) -> np.ndarray:
    """Which pairs (one, many) of rows the register estimate does not rule out:
    it lies at most ``deviations`` standard deviations below the limit."""
    used = ((regs[one] > 0) | (regs[many] > 0)).sum(axis=-1)
    equal = ((regs[one] == regs[many]) & (regs[one] > 0)).sum(axis=-1)
    by_accident = (chance[one] * chance[many]).sum(axis=-1) * (BUCKETS / (1 << MANTISSA_BITS))
    limit = opt.percent / 100
    margin = opt.deviations * np.sqrt(limit * (1 - limit) / np.maximum(used, 1))
    return (equal - by_accident) / np.maximum(used, 1) >= limit - margin


def _spanning(nodes, blocks, regs, chance, cross: bool, opt: NearOptions) -> list[tuple[int, int]]:
    """Plausible pairs that connect all of a unit's plausible pairs."""
    n = len(nodes)
    group, out = np.arange(n), []
    for x in range(n - 1):
        open_ = group[x + 1:] != group[x]
        if cross:
            open_ &= blocks[x + 1:] != blocks[x]
        y = np.flatnonzero(open_) + x + 1
        if not len(y):
            continue
        for other in y[plausible(regs, chance, x, y, opt)].tolist():
            if group[other] != group[x]:
                out.append((int(nodes[x]), int(nodes[other])))
                group[group == group[other]] = group[x]
    return out


def plausible_links(classes: DataFrame, held: DataFrame, opt: NearOptions) -> DataFrame:
    """(a, b) between classes that share a band key and whose estimate is near
    the limit or above: per key (in blocks, if many hold it) as many as connect
    its plausible pairs.  A pair comes once from every unit that found it."""
    blocks = F.ceil(F.col("n") / opt.block_classes).cast("int")
    own = F.pmod(F.xxhash64(F.lit(5), "node"), blocks).cast("int")
    units = F.explode(F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(
        F.least(x, own).alias("low"), F.greatest(x, own).alias("high"))))
    rows = (held.select("key", "node", own.alias("block"), units.alias("unit"))
            .join(classes.select("node", "registers", "n_shingles"), "node")
            .select("key", "unit.low", "unit.high", "block", "node", "n_shingles", "registers")
            .repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "node"))

    def links(table: pa.Table) -> pa.RecordBatch:
        nodes, blocks_ = table.column("node").to_numpy(), table.column("block").to_numpy()
        regs = np.frombuffer(b"".join(table.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        chance = level_chances(table.column("n_shingles").to_numpy())
        unit = [table.column(c).to_numpy() for c in ("key", "low", "high")]
        cross = unit[1] != unit[2]
        first = np.flatnonzero(np.concatenate([[True], np.any([u[1:] != u[:-1] for u in unit], axis=0)]))
        size = np.diff(np.append(first, len(nodes)))
        # units of two classes all at once, the others one by one
        two = first[size == 2]
        two = two[~cross[two] | (blocks_[two] != blocks_[two + 1])]
        two = two[plausible(regs, chance, two, two + 1, opt)]
        found = list(zip(nodes[two].tolist(), nodes[two + 1].tolist()))
        for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
            part = slice(at, at + n)
            found += _spanning(nodes[part], blocks_[part], regs[part], chance[part], bool(cross[at]), opt)
        found = list(dict.fromkeys(found))
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()),
                                           pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    def run(batches):
        # whole units only: the last one of a batch waits for the next batch
        held_back = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held_back is not None:
                table = pa.concat_tables([held_back, table])
            unit = [table.column(c).to_numpy() for c in ("key", "low", "high")]
            change = np.flatnonzero(np.any([u[1:] != u[:-1] for u in unit], axis=0))
            cut = int(change[-1]) + 1 if len(change) else 0
            held_back = table.slice(cut)
            if cut:
                yield links(table.slice(0, cut))
        if held_back is not None and len(held_back):
            yield links(held_back)

    return map_arrow(rows, run, "a long, b long")


def members_of_units(classes: DataFrame, keys: DataFrame, opt: NearOptions) -> DataFrame:
    """(node, units): the comparison units that each class takes part in, as an
    array of (group, low block, high block, own block)."""
    held = store(shared_keys(keys), "band-members")
    clusters = store(connected_components(plausible_links(classes, held, opt)), "clusters")
    sized = clusters.join(classes.select("node", "n_shingles"), "node")

    def blocks(members: DataFrame) -> DataFrame:
        """Adds the number of blocks of each group, and the node's own block."""
        count = members.groupBy("group").agg(F.greatest(
            F.ceil(F.count(F.lit(1)) / opt.block_classes),
            F.ceil(F.sum("n_shingles") / opt.block_shingles)).cast("int").alias("blocks"))
        return members.join(count, "group").withColumn(
            "block", F.pmod(F.xxhash64(F.lit(3), "node"), F.col("blocks")).cast("int"))

    by_cluster = blocks(sized.select(F.col("root").alias("group"), "node", "n_shingles"))
    large = by_cluster.filter(F.col("blocks") > opt.cluster_blocks).select("node", "n_shingles")
    by_key = blocks(held.select("key", "node").join(large, "node").select(F.col("key").alias("group"), "node", "n_shingles"))
    every = by_cluster.filter(F.col("blocks") <= opt.cluster_blocks).unionByName(by_key)
    pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(
        F.col("group").alias("group"), F.least(x, F.col("block")).alias("low"),
        F.greatest(x, F.col("block")).alias("high"), F.col("block").alias("block")))
    return every.groupBy("node").agg(F.flatten(F.collect_list(pair)).alias("units"))


def unit_rows(docs: DataFrame, members: DataFrame, classes: DataFrame, key: str, text: str,
              opt: NearOptions) -> DataFrame:
    """One row per unit and class with the class's full set and registers."""
    wanted = members.join(classes.select("node", "class", "sample"), "node").select(
        F.col("sample.doc_id").alias("__id"), F.col("sample.text_hash").alias("__hash"), "node", "class", "units")
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("__d"), F.xxhash64(f"`{text}`").alias("__hash"),
                       F.col(f"`{text}`").alias("text"))
    # one document of each class, found by its id and its text's hash
    joined = rows.join(wanted, F.col("__d").eqNullSafe(F.col("__id"))
                       & (rows["__hash"] == wanted["__hash"])).select("node", "units", "text")

    def run(batches):
        for batch in batches:
            nodes, units, column = batch.column(0).to_pylist(), batch.column(1), batch.column(2)
            for a, b in batches_of(column, 1 << 20):
                out = {n: [] for n in ("group", "low", "high", "block", "node", "shingles")}
                for k, s in zip(range(a, b), shingle_sets(column.slice(a, b - a), opt.width)):
                    raw = s.tobytes()
                    for u in units[k].as_py():
                        for n in ("group", "low", "high", "block"):
                            out[n].append(u[n])
                        out["node"].append(nodes[k])
                        out["shingles"].append(raw)
                kinds = {"group": pa.int64(), "node": pa.int64(), "shingles": pa.binary()}
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, kinds.get(n, pa.int32())) for n, v in out.items()], list(out))

    return map_arrow(joined, run, "group long, low int, high int, block int, node long, shingles binary")


def verified_links(nodes: np.ndarray, blocks: np.ndarray, sets: list[np.ndarray], cross: bool,
                   opt: NearOptions) -> list[tuple[int, int]]:
    """Links that connect all classes of a unit whose sets are similar enough.
    ``cross``: only pairs of different blocks are compared."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets])
    regs = np.stack([registers(s) for s in sets])
    chance = level_chances(sizes)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    # postings: the classes that hold a shingle
    begin = np.flatnonzero(np.diff(flat, prepend=flat[:1] ^ np.uint64(1)))
    finish = np.append(begin[1:], len(flat))
    values = flat[begin]
    group = np.arange(n)
    links = []
    for x in range(n - 1):
        open_ = group != group[x]
        open_[:x + 1] = False
        if cross:
            open_ &= blocks != blocks[x]
        # sizes alone rule pairs out
        small, big = np.minimum(sizes, sizes[x]), np.maximum(sizes, sizes[x])
        open_ &= 100 * small >= opt.percent * big
        y = np.flatnonzero(open_)
        if not len(y):
            continue
        y = y[plausible(regs, chance, x, y, opt)]
        if not len(y):
            continue
        at = np.searchsorted(values, sets[x])
        runs = finish[at] - begin[at]
        inside = np.repeat(begin[at] - np.cumsum(runs) + runs, runs) + np.arange(int(runs.sum()))
        both = np.bincount(owner[inside], minlength=n)[y]
        y = y[100 * both >= opt.percent * (sizes[x] + sizes[y] - both)]
        for other in y.tolist():
            if group[other] != group[x]:
                links.append((int(nodes[x]), int(nodes[other])))
                group[group == group[other]] = group[x]
    return links


def links_of(units: DataFrame, opt: NearOptions) -> DataFrame:
    """(a, b) links between classes, verified on full sets."""
    def run(unit: pa.Table) -> pa.Table:
        nodes, first = np.unique(unit.column("node").to_numpy(), return_index=True)
        blocks = unit.column("block").to_numpy()[first]
        raw = unit.column("shingles").combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        sets = [np.frombuffer(raw[int(k)].as_buffer(), dtype=np.uint64) for k in first]
        cross = unit.column("low")[0].as_py() != unit.column("high")[0].as_py()
        links = verified_links(nodes, blocks, sets, cross, opt)
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()),
                         "b": pa.array([x for _, x in links], pa.int64())})

    ship(units.sparkSession)
    return units.groupBy("group", "low", "high").applyInArrow(run, "a long, b long")


def placed_classes(docs: DataFrame, signed: DataFrame, key: str, text: str, opt: NearOptions) -> DataFrame:
    """(class, least_id, first_row, root): every class with its component."""
    classes = classes_of(signed)
    members = store(members_of_units(classes, band_keys(classes), opt), "units")
    links = store(links_of(unit_rows(docs, members, classes, key, text, opt), opt), "links")
    roots = store(connected_components(links), "components")
    return classes.join(roots, "node", "left").select(
        "class", "least_id", "first_row", F.coalesce("root", "node").alias("root"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text",
         opt: NearOptions = NearOptions()) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` and
    ``kept`` (the component's smallest id)."""
    signed = store(signatures(docs, key, text, opt), "signatures")
    placed = placed_classes(docs, signed, key, text, opt)
    least = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    found = store(placed.join(least, "root").select("class", "component_id", F.lit(True).alias("__set")),
                  "class-components")
    # documents without words have no class and stand alone
    return (signed.select("doc_id", "n_shingles", "class").join(found, "class", "left")
            .withColumn("component_id", F.when(F.col("__set"), F.col("component_id")).otherwise(F.col("doc_id")))
            .select("doc_id", "n_shingles", "component_id",
                    F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text",
             opt: NearOptions = NearOptions()) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one of the
    smallest id (NULL last), then of the smallest text hash; rows that agree in
    both are told apart by their other columns.  Rows without words all stay."""
    signed = store(signatures(docs, key, text, opt), "signatures")
    first = placed_classes(docs, signed, key, text, opt).groupBy("root").agg(
        F.min("first_row").alias("row")).select(
        F.col("row.doc_id").alias("__first_id"), F.col("row.text_hash").alias("__first_hash"),
        F.lit(True).alias("__first"))
    # id and text make a row's class, and so its component
    rows = signed.filter("n_shingles > 0").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"))
    judged = rows.join(first, F.col("doc_id").eqNullSafe(F.col("__first_id"))
                       & (F.col("text_hash") == F.col("__first_hash")), "left")
    # what is not simply kept: rows to drop, and first rows that are repeated
    decided = store(judged.filter("__first IS NULL OR n > 1").select(
        F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"),
        F.col("__first").isNotNull().alias("__repeated")), "decided")

    def same_row(other: DataFrame):
        return (F.col(f"`{key}`").cast("long").eqNullSafe(other["__id"])
                & (F.xxhash64(F.col(f"`{text}`")) == other["__hash"]))

    kept = docs.join(decided, same_row(decided), "left_anti")
    repeated = decided.filter("__repeated").select("__id", "__hash")
    if repeated.isEmpty():
        return kept
    # one of them, the least as JSON; copies merge before the shuffle
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns)
    rest = F.to_json(F.struct(*[c for c, n in zip(columns, docs.columns) if n != text]))
    one = (docs.join(repeated, same_row(repeated))
           .groupBy(repeated["__id"], repeated["__hash"]).agg(F.min_by(whole, rest).alias("__row"))
           .select("__row.*"))
    return kept.unionAll(one)
