r"""Quality rules with adaptive thresholds.

Every document gets counts over its whole text; two base rules fail a document
outright (fewer than 50 words; more than half of its words in repeated 3-word
windows).  Four rates of the others are judged against their own kind: per
language and source, a mergeable sketch of each rate gives two quantiles, ``base``
and ``high``, and a rate beyond ``high + fence (high - base) + slack`` (for the
mean word length also below ``base - fence (high - base) - slack``) rejects the
document.  Word length takes quartiles.  Symbols take the median and the 80 % point,
so up to a fifth of a source may be junk without moving its limit.  Repeated lines
and words, absent from most documents, take the 90 and 99 % points: their spread
is that of the upper tail, and at most a hundredth of a group lies beyond.  The only
slack is one symbol in a hundred word characters, for sources without any.

The sketch is a histogram over logarithmic buckets of integers: values below 64
exactly, larger ones with 32 buckets per power of two (relative error 1/32).
Two sketches merge by adding counts, so partial aggregates merge before the
shuffle, a language's sketch is the sum of its sources', and a (language,
source) with fewer than ``min_rows`` documents takes its language's thresholds,
or those of all documents.

Words are runs of ``[^\x20\x09-\x0D]``; window equality is that of 64-bit
hashes.  Everything is DataFrame operations.

Edge cases: a NULL or empty text has no words and fails; NULL languages and
sources are groups of their own; repeated rows and ties are judged alike; an
empty table gives no rows.  Input columns named like output columns are
replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, store

SPACE = " \t\n\x0b\f\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("word_length", "symbol_rate", "dup_line_rate", "repeat_rate")


@dataclass(frozen=True)
class Rule:
    """Quantiles in percent; ``two_sided``: the low end is judged too."""

    base: int
    high: int
    fence: int
    slack: int = 0
    two_sided: bool = False


@dataclass(frozen=True)
class QualityOptions:
    """Rates are integers: word length in 1/100 characters, the others in
    1/10000."""

    min_words: int = 50
    max_repeat_percent: int = 50
    min_rows: int = 100
    word_length: Rule = Rule(25, 75, 5, two_sided=True)
    symbol_rate: Rule = Rule(50, 80, 3, slack=100)
    dup_line_rate: Rule = Rule(90, 99, 1)
    repeat_rate: Rule = Rule(90, 99, 1)

    def rule(self, rate: str) -> Rule:
        return getattr(self, rate)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def words_column(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(
        F.array().cast("array<string>"))


def repeated_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array."""
    windows = F.when(F.size(words) >= 4, F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"),
                           i.alias("i"))))
    # in hash order a window that occurs again has an equal neighbour
    twice = let(F.array_sort(windows), lambda w: F.filter(
        w, lambda x, k: ((k > 0) & (x["h"] == F.get(w, k - 1)["h"]))
        | F.coalesce(x["h"] == F.get(w, k + 1)["h"], F.lit(False))))
    covered = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
    return F.coalesce(F.size(F.array_distinct(covered)), F.lit(0))


def with_counts(docs: DataFrame, text: str = "text", opt: QualityOptions = QualityOptions()) -> DataFrame:
    """``docs`` plus the counts, ``base_failed`` and the rates."""
    docs = drop_names(docs, (*COUNTS, *RATES, "base_failed", "kept"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    words = F.col("__words")
    counted = (
        docs.withColumn("__words", words_column(whole)).withColumn("__lines", lines)
        .select(
            *[F.col(f"`{c}`") for c in docs.columns],
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
            F.size("__lines").cast("long").alias("__n_lines"),
            F.when(F.size(words) >= 4, repeated_words(words)).otherwise(0).cast("long").alias("n_repeat_words")))

    def rate(part: str, whole_: str, scale: int) -> Column:
        return F.expr(f"CASE WHEN {whole_} > 0 THEN ({scale} * {part}) div {whole_} ELSE 0 END")

    return (counted
            .withColumn("base_failed", (F.col("n_words") < opt.min_words)
                        | (100 * F.col("n_repeat_words") > opt.max_repeat_percent * F.col("n_words")))
            .withColumn("word_length", rate("word_chars", "n_words", 100))
            .withColumn("symbol_rate", rate("n_symbols", "word_chars", 10000))
            .withColumn("dup_line_rate", rate("n_dup_lines", "__n_lines", 10000))
            .withColumn("repeat_rate", rate("n_repeat_words", "n_words", 10000))
            .drop("__n_lines"))


def bucket_of(value: Column) -> Column:
    """Bucket number of a non-negative integer."""
    bits = F.length(F.bin(value))
    return F.when(value < 64, value).otherwise(
        32 * (bits - 6) + F.call_function("shiftright", value, (bits - 6).cast("int")))


def value_of(bucket: Column) -> Column:
    """Smallest integer of a bucket."""
    power = F.floor(bucket / 32).cast("int") - 1
    return F.when(bucket < 64, bucket).otherwise(
        F.call_function("shiftleft", 32 + bucket % 32, power))


def sketches(counted: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per (language, source, rate, bucket) with its count, of the
    documents that pass the base rules."""
    rates = F.explode(F.array(*[F.struct(F.lit(r).alias("rate"), F.col(r).alias("value")) for r in RATES]))
    return (counted.filter(~F.col("base_failed"))
            .select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{source}`").alias("source"), rates.alias("r"))
            .groupBy("lang", "source", F.col("r.rate").alias("rate"), bucket_of(F.col("r.value")).alias("bucket"))
            .agg(F.count(F.lit(1)).alias("n")))


def thresholds(sketch: DataFrame, opt: QualityOptions = QualityOptions()) -> DataFrame:
    """``low_*`` and ``high_*`` of every rate per (language, source)."""
    def of_rule(part: str) -> Column:
        return F.element_at(F.create_map(*[x for r in RATES for x in (
            F.lit(r), F.lit(getattr(opt.rule(r), part)))]), F.col("rate"))

    def fences(keys: list[str]) -> DataFrame:
        merged = sketch.groupBy(*keys, "rate", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*keys, "rate")
        seen = merged.withColumn("up_to", F.sum("n").over(group.orderBy("bucket"))).withColumn(
            "all", F.sum("n").over(group))

        def quantile(part: str) -> Column:
            return F.min(F.when(100 * F.col("up_to") >= of_rule(part) * F.col("all"), F.col("bucket")))

        out = seen.groupBy(*keys, "rate").agg(
            quantile("base").alias("b_base"), quantile("high").alias("b_high"), F.max("all").alias("rows"))
        # the ends of the buckets: no value of a quantile's own bucket lies beyond it
        base, high = value_of(F.col("b_base")), value_of(F.col("b_high") + 1) - 1
        reach = of_rule("fence") * (high - base) + of_rule("slack")
        named = out.select(*keys, "rate", "rows", F.when(of_rule("two_sided"), base - reach).alias("low"),
                           (high + reach).alias("high"))
        return named.groupBy(*keys).agg(
            F.max("rows").alias("rows"),
            *[F.max(F.when(F.col("rate") == r, F.col(side))).alias(f"{side}_{r}")
              for r in RATES for side in ("low", "high")])

    sides = [f"{side}_{r}" for r in RATES for side in ("low", "high")]
    by_source = fences(["lang", "source"])
    by_lang = fences(["lang"]).select(F.col("lang").alias("__lang"), F.col("rows").alias("__rows"),
                                         *[F.col(s).alias(f"__l_{s}") for s in sides])
    # one row: the thresholds of all documents
    overall = fences([]).first()
    return (by_source.join(by_lang, F.col("lang").eqNullSafe(F.col("__lang")), "left")
            .select("lang", "source", *[
                F.when(F.col("rows") >= opt.min_rows, F.col(s))
                .when(F.col("__rows") >= opt.min_rows, F.col(f"__l_{s}"))
                .otherwise(F.lit(overall[s] if overall else None).cast("long")).alias(s) for s in sides]))


def packed(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The columns to judge by, and the whole input row as ``row``: keeps input
    columns whose names the results would replace."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select(
        "row", *[F.col(f"row.`{c}`").alias(c) for c in dict.fromkeys((text, lang, source))])


def judge(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source",
          opt: QualityOptions = QualityOptions(), keep_text: bool = True) -> DataFrame:
    """``docs`` plus counts, rates, ``base_failed`` and ``kept``."""
    counted = with_counts(docs, text, opt)
    if not keep_text:
        counted = counted.drop(text)
    # both passes read the counted table; the text is counted once
    counted = store(counted, "quality-counts")
    limits = store(thresholds(store(sketches(counted, lang, source), "quality-sketches"), opt),
                   "quality-thresholds")
    names = {c: f"__t_{c}" for c in limits.columns}
    limits = limits.select(*[F.col(c).alias(n) for c, n in names.items()])
    inside = F.lit(True)
    for r in RATES:
        inside = inside & (F.col(r) <= F.col(f"__t_high_{r}"))
        if opt.rule(r).two_sided:
            inside = inside & (F.col(r) >= F.col(f"__t_low_{r}"))
    joined = counted.join(
        limits, F.col(f"`{lang}`").eqNullSafe(F.col("__t_lang"))
        & F.col(f"`{source}`").eqNullSafe(F.col("__t_source")), "left")
    return (joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))
            .drop(*names.values()))
