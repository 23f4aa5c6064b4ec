r"""Repeated-passage removal with sharded Aho-Corasick automata.

A window is 35 consecutive words (runs of ``[^\x20\x09-\x0D]``) of a document.
Every word covered by a window whose word sequence starts anywhere else too is
removed.

1. Anchors.  The smallest 10-word hash inside a window is its anchor; equal
   windows have equal anchors, and a document has few different ones.
   Documents are dealt to buckets by a hash; per bucket the anchors are counted,
   and those seen twice or more anywhere are kept.  Only windows with such an
   anchor are candidates.
2. Suspects.  Each bucket hashes its candidate windows (64 bits over all 35
   words) and sends the sorted distinct hashes, cut by their top bits, to
   counting shards.  A shard answers every bucket with one bit per hash: does
   the hash start anywhere else?  Equal windows always do, so this only spares
   the automata what cannot recur.
3. Automata.  Consecutive suspects with one anchor form a stretch of at most 60
   words.  The distinct stretches of all documents, with their number of places, are
   dealt to shards by their anchor, so all stretches that could share a window meet.
   A shard compiles them into Aho-Corasick automata over exact words (whole
   stretches with several places, single windows of the others) and streams
   every stretch through: a window is confirmed if its words have two places.
4. The places of each stretch get the confirmed windows back; these alone
   decide which words of a document go.

The cost is linear: a document's stretches go to the shards of their own anchors
only.  Buckets and shards are sized from the input's bytes; copies and common
passages count once per bucket and once per shard, so no group grows with its number
of copies.  Rows that agree in key and text beyond ``hot_rows`` are looked at twice
only, and take the result by a join.

Edge cases: a NULL or short text has no window; documents are dealt by key and
text hash; repeated rows repeat each other's passages and lose them; NULL keys are
allowed; an empty table gives no rows.  Input columns named like output
columns are replaced (``clean`` keeps them all).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weblytics.llm.common import extended, group_arrow, map_arrow, ship, shuffle_partitions, store
from weblytics.llm.hashing import batches_of, text_buffer, window_hashes, word_class, words_of

MORE = "n_words long, n_removed long, passages array<struct<start:int,stop:int>>, kept_text string"
OUTPUT = ("n_words", "n_removed", "passages", "kept_text")


@dataclass(frozen=True)
class PassageOptions:
    window: int = 35
    anchor: int = 10
    #: text bytes of a bucket
    bucket_bytes: int = 4 << 20
    #: words of the patterns in one automaton (about 100 bytes each)
    automaton_words: int = 1 << 19
    #: text bytes of the stretches in one shard
    shard_bytes: int = 8 << 20
    #: leading bits of the hashes that are used (fewer of them collide)
    hash_bits: int = 64
    #: rows with one key and text that a bucket may hold
    hot_rows: int = 64


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, span = values, 1
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def hashes_of(words, width: int, opt: PassageOptions) -> np.ndarray:
    """Hashes of all ``width``-word windows."""
    found = window_hashes(words.hashes, width)
    return found if opt.hash_bits == 64 else found & ~np.uint64((1 << (64 - opt.hash_bits)) - 1)


def anchors_of(words, opt: PassageOptions) -> np.ndarray:
    """Anchor of every window start of a batch of documents (windows that leave
    their document are masked by ``words.windows_of``)."""
    grams = hashes_of(words, opt.anchor, opt)
    reach = opt.window - opt.anchor + 1
    return sliding_least(grams, reach) if len(grams) >= reach else grams[:0]


def bucket_anchors(docs: DataFrame, text: str, opt: PassageOptions) -> DataFrame:
    """(anchor, bucket, n): n counts a document's places of the anchor, 2 at most."""
    def run(batches):
        for batch in batches:
            column = batch.column(1)
            buckets = batch.column(0).to_numpy()
            for a, b in batches_of(column):
                words = words_of(*text_buffer(column.slice(a, b - a)), word_class("nonspace"))
                grams = hashes_of(words, opt.anchor, opt)
                least = anchors_of(words, opt)
                found, places, owner = [], [], []
                for k, (lo, hi) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
                    if hi - lo < opt.window:
                        continue
                    mine = np.unique(least[lo:hi - opt.window + 1])
                    own = grams[lo:hi - opt.anchor + 1]
                    at = np.searchsorted(mine, own)
                    at[at == len(mine)] = 0
                    hit = at[mine[at] == own]
                    found.append(mine)
                    places.append(np.bincount(hit, minlength=len(mine)))
                    owner.append(np.full(len(mine), buckets[a + k]))
                if not found:
                    continue
                anchor, n, bucket = map(np.concatenate, (found, places, owner))
                order = np.lexsort((anchor, bucket))
                anchor, n, bucket = anchor[order], n[order], bucket[order]
                new = np.flatnonzero((np.diff(anchor, prepend=anchor[:1] ^ np.uint64(1)) != 0)
                                     | (np.diff(bucket, prepend=-1) != 0))
                n = np.minimum(np.add.reduceat(n, new), 2)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[new].view(np.int64)), pa.array(bucket[new]), pa.array(n.astype(np.int32))],
                    ["anchor", "bucket", "n"])

    return map_arrow(docs.select("__bucket", F.col(f"`{text}`")), run, "anchor long, bucket int, n int")


def recurring_anchors(anchors: DataFrame) -> DataFrame:
    """(bucket, anchor) of the anchors with two places or more anywhere."""
    total = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor")
    return anchors.select("bucket", "anchor").join(total, "anchor", "left_semi").distinct()


class _Bucket:
    """Words, candidate windows and their sorted distinct hashes of a bucket."""

    def __init__(self, texts, anchors: np.ndarray, opt: PassageOptions):
        self.words, self.hashes, self.starts, self.least = [], [], [], []
        anchors = np.sort(anchors)
        for a, b in batches_of(texts):
            words = words_of(*text_buffer(texts.slice(a, b - a)), word_class("nonspace"))
            least = anchors_of(words, opt)
            full = hashes_of(words, opt.window, opt)
            valid = words.windows_of(opt.window)
            at = np.searchsorted(anchors, least)
            at[at == len(anchors)] = 0
            starts = np.flatnonzero(valid & (anchors[at] == least)) if len(anchors) else np.zeros(0, np.int64)
            self.words.append((a, b, words))
            self.starts.append(starts)
            self.least.append(least[starts] if len(starts) else least[:0])
            self.hashes.append(full[starts] if len(starts) else np.zeros(0, np.uint64))
        flat = np.concatenate(self.hashes) if self.hashes else np.zeros(0, np.uint64)
        self.distinct, counts = np.unique(flat, return_counts=True)
        self.twice = counts > 1


def _shard_cuts(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Where each of the 2^bits shards begins in sorted hashes."""
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits) if bits else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.searchsorted(hashes, edges), [len(hashes)]])


def _longs(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False).view(np.uint64)


def _texts(column):
    column = column.combine_chunks()
    return pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column


def candidate_windows(docs: DataFrame, anchors: DataFrame, text: str, bits: int, opt: PassageOptions) -> DataFrame:
    """(shard, bucket, hashes, twice): sorted distinct hashes of the bucket's
    candidates, and a bit for those that it has more than once."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"shard": [], "bucket": [], "hashes": [], "twice": []}
        if len(left) and len(right):
            bucket = _Bucket(_texts(right.column(text)), _longs(left.column("anchor")), opt)
            cuts = _shard_cuts(bucket.distinct, bits)
            number = right.column("__bucket")[0].as_py()
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                out["shard"].append(s)
                out["bucket"].append(number)
                out["hashes"].append(bucket.distinct[cuts[s]:cuts[s + 1]].tobytes())
                out["twice"].append(np.packbits(bucket.twice[cuts[s]:cuts[s + 1]]).tobytes())
        return pa.table({"shard": pa.array(out["shard"], pa.int32()), "bucket": pa.array(out["bucket"], pa.int32()),
                         "hashes": pa.array(out["hashes"], pa.binary()), "twice": pa.array(out["twice"], pa.binary())})

    ship(docs.sparkSession)
    return anchors.groupBy("bucket").cogroup(docs.select("__bucket", text).groupBy("__bucket")).applyInArrow(
        run, "shard int, bucket int, hashes binary, twice binary")


def confirmed(candidates: DataFrame) -> DataFrame:
    """(bucket, shard, recurs): one bit per candidate hash, in its order."""
    def run(shard: pa.Table) -> pa.Table:
        parts = [np.frombuffer(h, np.uint64) for h in shard.column("hashes").to_pylist()]
        flat = np.concatenate(parts)
        order = np.argsort(flat, kind="stable")
        ranked = flat[order]
        same = ranked[1:] == ranked[:-1]
        recurs = np.zeros(len(flat), dtype=bool)
        recurs[order[1:][same]] = True
        recurs[order[:-1][same]] = True
        out, at = [], 0
        for part, twice in zip(parts, shard.column("twice").to_pylist()):
            own = np.unpackbits(np.frombuffer(twice, np.uint8), count=len(part)).astype(bool)
            out.append(np.packbits(recurs[at:at + len(part)] | own).tobytes())
            at += len(part)
        return pa.table({"bucket": shard.column("bucket"), "shard": shard.column("shard"),
                         "recurs": pa.array(out, pa.binary())})

    return group_arrow(candidates, "shard", run, "bucket int, shard int, recurs binary")


# ---------------------------------------------------------------------------
# stretches
# ---------------------------------------------------------------------------
STRETCHES = ("bucket int, h1 long, h2 long, start int, anchor long, digest binary, places int, words binary")


def _split(starts: np.ndarray, least: np.ndarray, longest: int) -> list[tuple[int, int]]:
    """(first, last) indices of the runs of consecutive starts with one anchor, of at
    most ``longest`` windows each."""
    cut = np.flatnonzero((np.diff(starts) != 1) | (np.diff(least) != 0)) + 1
    edges = np.concatenate([[0], cut, [len(starts)]])
    return [(k, min(k + longest, hi) - 1) for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist())
            for k in range(lo, hi, longest)]


def _stretches(bucket: _Bucket, recurs: np.ndarray, table: pa.Table, text: str, opt: PassageOptions) -> dict[str, list]:
    """The stretches of a bucket's documents; words and places with the first of equal ones."""
    out = {c.split()[0]: [] for c in STRETCHES.split(", ")}
    column, number = _texts(table.column(text)), table.column("__bucket")[0].as_py()
    ids = [table.column(c).to_pylist() for c in ("__h1", "__h2")]
    first: dict[bytes, int] = {}
    for (a, b, words), starts, hashes, least in zip(bucket.words, bucket.starts, bucket.hashes, bucket.least):
        if not len(starts):
            continue
        good = recurs[np.searchsorted(bucket.distinct, hashes)]
        starts, least = starts[good], least[good]
        data, offsets = text_buffer(column.slice(a, b - a))
        owner = np.searchsorted(words.first, starts, side="right") - 1
        for k in np.unique(owner).tolist():
            mine = slice(*np.searchsorted(owner, [k, k + 1]).tolist())
            lo, hi = int(words.first[k]), int(words.first[k + 1])
            # the document's words joined by one space, and where each begins and ends there
            spaced = b" ".join(data[offsets[k]:offsets[k + 1]].tobytes().split())
            ends = np.cumsum(words.ends[lo:hi] - words.starts[lo:hi] + 1) - 1
            begins = np.concatenate([[0], ends[:-1] + 1])
            own, anchors = starts[mine] - lo, least[mine]
            for i, j in _split(own, anchors, opt.window - opt.anchor + 1):
                s, e = int(own[i]), int(own[j]) + opt.window
                piece = spaced[begins[s]:ends[e - 1]]
                digest = hashlib.blake2b(piece, digest_size=16).digest()
                known = first.get(digest)
                if known is None:
                    first[digest] = len(out["start"])
                else:
                    out["places"][known] = 2
                row = (number, ids[0][a + k], ids[1][a + k], s, int(anchors[i].astype(np.int64)), digest,
                       1 if known is None else 0, piece if known is None else None)
                for values, value in zip(out.values(), row):
                    values.append(value)
    return out


def confirmed_windows(pieces: list[bytes], places: list[int], opt: PassageOptions) -> list[np.ndarray]:
    """For each distinct stretch, which of its windows have two places or more among
    all stretches, by their words.

    Patterns are whole stretches that have two places already, and the single windows
    of the others; automata hold a bounded number of words each, and every stretch
    is streamed through each."""
    numbers: dict[bytes, int] = {}
    streams = [tuple([numbers.setdefault(w, len(numbers)) for w in p.split(b" ")]) for p in pieces]
    width = opt.window
    patterns: dict[tuple, int] = {}         # pattern -> places, 2 at most
    for stream, n in zip(streams, places):
        if n > 1:
            patterns[stream] = 2
    for stream, n in zip(streams, places):
        if n == 1:
            for k in range(len(stream) - width + 1):
                patterns.setdefault(stream[k:k + width], 0)
    masks = [np.zeros(len(s) - width + 1, dtype=bool) for s in streams]
    todo, at = list(patterns.items()), 0
    while at < len(todo):
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        size, first = 0, at
        while at < len(todo) and (size == 0 or size + len(todo[at][0]) <= opt.automaton_words):
            automaton.add_word(todo[at][0], at - first)
            size += len(todo[at][0])
            at += 1
        automaton.make_automaton()
        count = [n for _, n in todo[first:at]]
        found: list[tuple[int, int, int]] = []      # stretch, pattern, start
        for k, (stream, n) in enumerate(zip(streams, places)):
            for end, pattern in automaton.iter(stream):
                count[pattern] += n
                found.append((k, pattern, end + 1 - len(todo[first + pattern][0])))
        for k, pattern, start in found:
            if count[pattern] > 1:
                masks[k][start:start + len(todo[first + pattern][0]) - width + 1] = True
    return masks


def located(distinct: DataFrame, opt: PassageOptions) -> DataFrame:
    """(digest, windows): one bit per window of each distinct stretch (shard, digest,
    words, places) that has a confirmed one."""
    def run(shard: pa.Table) -> pa.Table:
        digests = shard.column("digest").to_pylist()
        masks = confirmed_windows(shard.column("words").to_pylist(),
                                  [min(2, n) for n in shard.column("places").to_pylist()], opt)
        kept = [(d, np.packbits(m).tobytes()) for d, m in zip(digests, masks) if m.any()]
        return pa.table({"digest": pa.array([d for d, _ in kept], pa.binary()),
                         "windows": pa.array([w for _, w in kept], pa.binary())})

    return group_arrow(distinct, "shard", run, "digest binary, windows binary")


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _finish(table: pa.Table, replies: dict[tuple, list], text: str, opt: PassageOptions) -> dict[str, pa.Array]:
    """The result columns of a bucket's documents from (start, windows) replies."""
    counts, removed, spans, kept = [], [], [], []
    column = _texts(table.column(text))
    ids = list(zip(table.column("__h1").to_pylist(), table.column("__h2").to_pylist()))
    for a, b in batches_of(column):
        data, offsets = text_buffer(column.slice(a, b - a))
        raw = data.tobytes()
        for k in range(b - a):
            # bytes.split() splits at exactly the white space that ends a word here
            words = raw[offsets[k]:offsets[k + 1]].split()
            change = np.zeros(len(words) + 1, dtype=np.int64)
            for start, packed in replies.get(ids[a + k], ()):
                at = start + np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8)))
                np.add.at(change, at, 1)
                np.add.at(change, at + opt.window, -1)
            mask = np.cumsum(change)[:-1] > 0
            counts.append(len(words))
            removed.append(int(mask.sum()))
            first, last = _runs(mask)
            spans.append([{"start": int(s), "stop": int(e)} for s, e in zip(first, last)])
            left = words if not removed[-1] else compress(words, (~mask).tolist())
            kept.append(b" ".join(left).decode("utf-8", "replace"))
    return {"n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "passages": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
            "kept_text": pa.array(kept, pa.string())}


def _known(left: pa.Table, right: pa.Table, bits: int, text: str, opt: PassageOptions) -> tuple[_Bucket, np.ndarray]:
    """A bucket from its recurring anchors and documents, and its suspects from the
    counting shards' replies."""
    import pyarrow.compute as pc

    mine = left.filter(pc.is_valid(left.column("anchor")))
    found = _longs(mine.column("anchor")) if len(mine) else np.zeros(0, np.uint64)
    bucket = _Bucket(_texts(right.column(text)), found, opt)
    cuts = _shard_cuts(bucket.distinct, bits)
    recurs = np.zeros(len(bucket.distinct), dtype=bool)
    replies = left.filter(pc.is_valid(left.column("shard")))
    for s, packed in zip(replies.column("shard").to_pylist(), replies.column("recurs").to_pylist()):
        recurs[cuts[s]:cuts[s + 1]] = np.unpackbits(
            np.frombuffer(packed, np.uint8), count=int(cuts[s + 1] - cuts[s])).astype(bool)
    return bucket, recurs


def stretches(docs: DataFrame, anchors: DataFrame, answers: DataFrame, text: str, bits: int,
              opt: PassageOptions) -> DataFrame:
    """(``STRETCHES``) of all documents (__bucket, __h1, __h2, text)."""
    known = anchors.select("bucket", "anchor", F.lit(None).cast("int").alias("shard"),
                           F.lit(None).cast("binary").alias("recurs")).unionByName(
        answers.select("bucket", F.lit(None).cast("long").alias("anchor"), "shard", "recurs"))
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {c.split()[0]: [] for c in STRETCHES.split(", ")}
        if len(left) and len(right):
            bucket, recurs = _known(left, right, bits, text, opt)
            rows = _stretches(bucket, recurs, right, text, opt)
        return pa.table({n: pa.array(v, kinds[c.split()[1]]) for (n, v), c in zip(rows.items(), STRETCHES.split(", "))})

    ship(docs.sparkSession)
    return known.groupBy("bucket").cogroup(docs.groupBy("__bucket")).applyInArrow(run, STRETCHES)


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text",
           opt: PassageOptions = PassageOptions()) -> DataFrame:
    """``docs`` plus ``n_words``, ``n_removed``, the removed ``passages`` (word
    positions, stop excluded) and ``kept_text`` (kept words, joined by a space)."""
    spark = docs.sparkSession
    # the other columns travel as one struct, so no name can clash
    kept = [c for c in docs.columns if c.lower() not in OUTPUT or c == text]
    others = [F.col(f"`{c}`") for c in kept if c != text] or [F.lit(None).alias("none")]
    whole = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text"),
                        F.xxhash64(f"`{key}`", f"`{text}`").alias("__h1"), F.xxhash64(f"`{text}`", F.lit(1), f"`{key}`").alias("__h2"))
    total, rows = docs.agg(F.sum(F.octet_length(f"`{text}`")), F.count(F.lit(1))).first()
    buckets = max(-(-int(total or 0) // opt.bucket_bytes), 2 * shuffle_partitions(spark))
    bits = max(0, (buckets // 4).bit_length())
    dealt = whole.withColumn("__bucket", F.pmod("__h1", F.lit(buckets)).cast("int"))

    # ids of rows that are there too often for one bucket; none, as a rule
    hot = whole.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") > opt.hot_rows).select("__h1", "__h2")
    several = None
    if rows and hot.head() is not None:
        hot = store(hot, "hot-rows")
        several = dealt.join(hot, ["__h1", "__h2"], "left_semi")
        # two of them show that they recur; each task passes on two at most
        order = Window.partitionBy("__h1", "__h2").orderBy(F.lit(1))
        two = several.withColumn("__n", F.row_number().over(order)).where("__n <= 2").drop("__n")
        dealt = store(dealt.join(hot, ["__h1", "__h2"], "left_anti").unionByName(two.select(*dealt.columns)), "dealt")
    looked = dealt.select("__bucket", "__h1", "__h2", "text")

    anchors = store(recurring_anchors(store(bucket_anchors(looked, "text", opt), "anchors")), "recurring-anchors")
    answers = store(confirmed(candidate_windows(looked, anchors, "text", bits, opt)), "recurring-windows")
    found = store(stretches(looked, anchors, answers, "text", bits, opt), "stretches")
    distinct = found.where(F.col("words").isNotNull()).groupBy("digest").agg(
        F.any_value("words").alias("words"), F.any_value("anchor").alias("anchor"), F.sum("places").alias("places"))
    size = found.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    shards = max(-(-int(size) // opt.shard_bytes), 2 * shuffle_partitions(spark))
    replies = located(distinct.select(F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int").alias("shard"),
                                      "digest", "words", "places"), opt)
    places = found.select("bucket", "h1", "h2", "start", "digest").join(store(replies, "located"), "digest").select(
        "bucket", "h1", "h2", "start", "windows")
    schema = extended(dealt.select("row", "text", "__h1", "__h2"), MORE)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(right):
            return schema_table
        mine: dict[tuple, list] = {}
        for h1, h2, start, windows in zip(*(left.column(c).to_pylist() for c in ("h1", "h2", "start", "windows"))):
            mine.setdefault((h1, h2), []).append((start, windows))
        # rows with one key and text have equal stretches: each of them once
        mine = {k: list(set(v)) for k, v in mine.items()}
        out = right.select(["row", "text", "__h1", "__h2"])
        for name, values in _finish(right, mine, "text", opt).items():
            out = out.append_column(name, values)
        return out

    from pyspark.sql.pandas.types import to_arrow_schema

    schema_table = to_arrow_schema(schema).empty_table()
    ship(spark)
    done = places.groupBy("bucket").cogroup(dealt.groupBy("__bucket")).applyInArrow(run, schema)
    if several is not None:
        done = store(done, "judged")
        more = done.join(hot, ["__h1", "__h2"], "left_semi").groupBy("__h1", "__h2").agg(
            *[F.any_value(c).alias(c) for c in OUTPUT])
        done = done.join(hot, ["__h1", "__h2"], "left_anti").select("row", "text", *OUTPUT).unionByName(
            several.select("__h1", "__h2", "row", "text").join(more, ["__h1", "__h2"]).select("row", "text", *OUTPUT))
    return done.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in kept], *OUTPUT)


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text",
          opt: PassageOptions = PassageOptions()) -> DataFrame:
    """``docs`` without repeated passages.  A text that loses nothing stays as it
    is; one that loses words becomes its kept words joined by one space."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns if c != text]).alias("input"), F.col(f"`{key}`").alias("key"),
                         F.col(f"`{text}`").alias("text"))
    done = remove(packed, "key", "text", opt)
    new = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    return done.select(*[(new if c == text else F.col(f"input.`{c}`")).alias(c) for c in columns])
