r"""Benchmark decontamination by word windows.

Benchmark items and documents are folded alike (A-Z to lower case, words are
runs of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``).  An item gives its windows of 10
consecutive words, or one window of all its words when it has fewer.  The
distinct 64-bit hashes of the item windows are a hash set, broadcast while it
has at most ``BROADCAST_WINDOWS`` entries (beyond that Spark joins by shuffle);
each document's windows are hashed and looked up in one pass over the text.
Hits are verified word by word against the items and only then counted.  Words
inside a verified window are hit; documents can be dropped, or the hit words
removed.

A document's hits depend on its text alone, so hits are gathered per distinct
text (SHA-256), which also merges the hits of copies before they are shuffled.
Everything is DataFrame operations.

Edge cases: a NULL text has no words and is never hit; items without words
give no window; items that share an id are one item; an item without id counts
as the id ''; an empty benchmark or document table gives no hits or no rows.
Input columns named like output columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, store

WINDOW = 10
#: hash set entries of 16 bytes: 64 MB at most
BROADCAST_WINDOWS = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTPUT = ("n_words", "n_hit", "items", "contaminated")


def folded_words(text: Column) -> Column:
    whole = F.coalesce(text, F.lit(""))
    # on ASCII text lower() folds exactly A-Z, and is the faster one
    folded = F.when(F.octet_length(whole) == F.char_length(whole), F.lower(whole)).otherwise(
        F.translate(whole, UPPER, LOWER))
    parts = F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    return F.filter(parts, lambda w: w != "")


def text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hash(words: Column, at: Column, length: int) -> Column:
    return F.xxhash64(*[F.get(words, at + k) for k in range(length)])


def item_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text",
                 window: int = WINDOW) -> DataFrame:
    """(h, length, item, words): every window of every item."""
    items = (benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"),
                              folded_words(F.col(f"`{text}`")).alias("words"))
             .withColumn("length", F.least(F.size("words"), F.lit(window)))
             .filter(F.col("length") > 0))
    placed = items.select("item", "words", "length",
                          F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("i"))
    h = F.coalesce(*[F.when(F.col("length") == n, _hash(F.col("words"), F.col("i"), n))
                     for n in range(1, window + 1)])
    return placed.select(h.alias("h"), "length", "item",
                         F.slice("words", F.col("i") + 1, F.col("length")).alias("words")).distinct()


def document_hits(docs: DataFrame, windows: DataFrame, text: str = "text") -> DataFrame:
    """Per distinct text with a hit: ``key``, hit ``spans`` (start, length) and
    the ids of the ``items`` found.  ``windows`` is a stored table."""
    # at most WINDOW different lengths
    lengths = sorted(r[0] for r in windows.select("length").distinct().collect())
    if not lengths:
        lengths = [WINDOW]
    hashes = windows.select("h", "length").distinct()
    small = hashes.count() <= BROADCAST_WINDOWS
    if small:
        hashes = F.broadcast(hashes)
    whole = F.col(f"`{text}`")
    words = F.col("words")
    texts = docs.select(text_key(whole).alias("key"), folded_words(whole).alias("words"))
    placed = (texts.filter(F.size(words) >= lengths[0])
              .select("key", "words", F.explode(F.sequence(F.lit(0), F.size(words) - lengths[0])).alias("i")))
    if len(lengths) == 1:
        placed = placed.withColumn("length", F.lit(lengths[0]))
    else:
        placed = (placed.withColumn("length", F.explode(F.array(*map(F.lit, lengths))))
                  .filter(F.col("i") + F.col("length") <= F.size(words)))
    h = F.coalesce(*[F.when(F.col("length") == n, _hash(words, F.col("i"), n)) for n in lengths])
    looked_up = placed.withColumn("h", h)
    own = ["key", "i", "length", "h", F.slice(words, F.col("i") + 1, F.col("length")).alias("words")]
    # a broadcast lookup cuts out the words of hits only; rows that are shuffled
    # to the lookup carry their window, never their whole text
    if small:
        found = looked_up.join(hashes, ["h", "length"], "left_semi").select(*own)
    else:
        found = looked_up.select(*own).join(hashes, ["h", "length"], "left_semi").select(
            "key", "i", "length", "h", "words")
    # copies of a text, and windows shared by many, merge before the shuffle
    found = found.distinct()
    verified = (found.join(windows, ["h", "length", "words"])
                .groupBy("key").agg(F.collect_set(F.struct("i", "length")).alias("spans"),
                                    F.collect_set("item").alias("items")))
    return verified


def positions(spans: Column) -> Column:
    """Distinct word positions inside the spans."""
    return F.array_distinct(F.flatten(F.transform(
        spans, lambda s: F.sequence(s["i"], s["i"] + s["length"] - 1))))


def find(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
         window: int = WINDOW) -> DataFrame:
    """``docs`` without the text, plus ``n_words``, ``n_hit``, ``items`` (ids
    found, as sorted strings) and ``contaminated``."""
    windows = store(item_windows(benchmark, item, "text", window), "benchmark-windows")
    hits = store(document_hits(docs, windows, text)
                 .select("key", F.size(positions(F.col("spans"))).cast("long").alias("__n_hit"),
                         F.array_sort("items").alias("__items")), "benchmark-hits")
    whole = F.col(f"`{text}`")
    # the other columns travel as one struct, so no name can clash
    others = [c for c in drop_names(docs, OUTPUT).columns if c != text]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("row"), text_key(whole).alias("key"),
                        F.size(folded_words(whole)).cast("long").alias("n_words"))
    n_hit = F.coalesce("__n_hit", F.lit(0)).cast("long")
    return keyed.join(hits, "key", "left").select(
        *[F.col(f"row.`{c}`").alias(c) for c in others], "n_words", n_hit.alias("n_hit"),
        F.coalesce("__items", F.array().cast("array<string>")).alias("items"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text",
          item: str = "item_id", window: int = WINDOW) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or with
    the hit words taken out of them (``remove="spans"``; such a text becomes its
    remaining folded words joined by one space)."""
    if remove not in ("documents", "spans"):
        raise ValueError(remove)
    windows = store(item_windows(benchmark, item, "text", window), "benchmark-windows")
    hits = store(document_hits(docs, windows, text).select("key", positions(F.col("spans")).alias("hit")), "benchmark-hits")
    # the input row travels as one struct, so no name can clash
    columns = docs.columns
    others = [F.col(f"`{c}`") for c in columns if c != text] or [F.lit(None).alias("none")]
    keyed = docs.select(F.struct(*others).alias("row"), F.col(f"`{text}`").alias("text")).withColumn(
        "key", text_key(F.col("text")))
    if remove == "documents":
        left = keyed.join(hits.select("key"), "key", "left_anti")
    else:
        words = F.when(F.col("hit").isNotNull(), folded_words(F.col("text")))
        remaining = F.transform(
            F.array_except(F.sequence(F.lit(0), F.size("words") - 1), F.col("hit")), lambda i: F.get(F.col("words"), i))
        left = keyed.join(hits, "key", "left").withColumn("words", words).withColumn(
            "text", F.when(F.col("hit").isNull(), F.col("text")).otherwise(F.array_join(remaining, " ")))
    return left.select(*[(F.col("text") if c == text else F.col(f"row.`{c}`")).alias(c) for c in columns])
