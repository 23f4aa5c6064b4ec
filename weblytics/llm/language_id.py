"""Language identification with averaged hashed subword embeddings.

A text is the average of the embeddings of its hashed character n-grams (2 to
4 bytes of the lower-cased text, none across a word boundary except at its
ends), followed by a linear softmax.  Embeddings and output weights are trained
together by stochastic gradient descent in numpy, on a sample of labelled rows:
every language gets the same expected share of ``max_rows`` (a hash of the key
decides, so the sample is the same on every run).  A fifth of the sample is
held back to fit a softmax temperature and the rejection limit: the smallest
score above which at least ``target_precision`` of the held-back rows are right.

For scoring, embeddings times output weights is one table of (n-gram bucket,
language), so a text costs a few look-ups per byte.

Edge cases: a text that is NULL or has no letter is ``und`` with score 0 and
rejected; rows without a language are scored but never learnt from; without any
learnable row every text is ``und``; an empty table gives no rows; repeated rows
score alike.  Input columns named like output columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, extended, map_arrow
from weblytics.llm.hashing import SEGMENT_BYTES, batches_of, text_buffer

OUTPUT = "lang_pred string, score double, rejected boolean"
UNDEFINED = "und"


@dataclass(frozen=True)
class LanguageOptions:
    bucket_bits: int = 14
    dimension: int = 16
    #: expected number of sampled rows over all languages
    max_rows: int = 2400
    epochs: int = 6
    rate: float = 4.0
    target_precision: float = 0.99
    seed: int = 11


#: bytes of the range before that a part of a very long text begins with
OVERLAP = 4

#: lower-cased ASCII letters and the bytes of other characters; else a space
_LETTER = np.full(256, 0x20, dtype=np.uint8)
for _c in range(26):
    _LETTER[ord("a") + _c] = _LETTER[ord("A") + _c] = ord("a") + _c
_LETTER[0x80:] = np.arange(0x80, 256)


def ngram_buckets(data: np.ndarray, offsets: np.ndarray, bits: int):
    """For n = 2, 3, 4: (n, bucket of each position's n-gram, whether it counts)."""
    m = _LETTER[data]
    # U+00C0 .. U+00DE to lower case
    upper = np.zeros(len(data), dtype=bool)
    upper[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    m[upper] += 0x20
    # bytes from each position to the end of its document
    sizes = np.diff(offsets)
    left = np.repeat(offsets[1:], sizes) - np.arange(len(data))
    space = m == 0x20
    wide = m.astype(np.uint32)
    for n in (2, 3, 4):
        size = len(data) - n + 1
        if size <= 0:
            continue
        code = np.full(size, n, dtype=np.uint32)
        for k in range(n):
            code = code * np.uint32(0x01000193) ^ wide[k:size + k]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        good = left[:size] >= n
        for k in range(1, n - 1):
            good &= ~space[k:size + k]
        if n == 2:
            good &= ~(space[:size] & space[1:size + 1])
        yield n, code >> np.uint32(32 - bits), good


def _has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # (buckets + 1, languages); the last row is zero
    bits: int
    temperature: float
    limit: float

    def score(self, column) -> tuple[list, np.ndarray, list]:
        """(language, probability, rejected) of every text of a column."""
        names, scores, rejected = [], np.zeros(len(column)), []
        k = len(self.languages)
        for a, b in batches_of(column, SEGMENT_BYTES):
            part = column.slice(a, b - a)
            data, offsets = text_buffer(part)
            total = np.zeros((b - a, k))
            count = np.zeros(b - a)
            # a range of several documents is short; a long one is alone
            cuts = [(0, len(data))] if b - a > 1 else [
                (max(0, at - OVERLAP), min(len(data), at + SEGMENT_BYTES)) for at in range(0, max(len(data), 1), SEGMENT_BYTES)]
            for number, (lo, hi) in enumerate(cuts):
                local = np.clip(offsets - lo, 0, hi - lo)
                # documents with bytes in this range, and where they begin
                have = np.flatnonzero(np.diff(local) > 0)
                if not len(have):
                    continue
                first = local[:-1][have]
                for n, bucket, good in ngram_buckets(data[lo:hi], local, self.bits):
                    if number:
                        # these ended in the range before and are counted there
                        good[:OVERLAP + 1 - n] = False
                    index = np.where(good, bucket, len(self.table) - 1).astype(np.int64)
                    at = np.minimum(first, len(index) - 1)
                    ok = first < len(index)
                    for c in range(k):
                        total[have[ok], c] += np.add.reduceat(self.table[:, c][index], at[ok])
                    count[have[ok]] += np.add.reduceat(good.astype(np.int64), at[ok])
            mean = total / np.maximum(count, 1)[:, None] / self.temperature
            mean -= mean.max(axis=1, keepdims=True)
            p = np.exp(mean)
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            ascii_letter = np.zeros(len(data) + 1, dtype=np.int64)
            np.cumsum((_LETTER[data] != 0x20) & (data < 0x80), out=ascii_letter[1:])
            clear = ascii_letter[offsets[1:]] > ascii_letter[offsets[:-1]]
            for i in range(b - a):
                if clear[i] or _has_letter(part[i].as_py()):
                    scores[a + i] = p[i, best[i]]
                    names.append(self.languages[best[i]])
                    rejected.append(bool(scores[a + i] < self.limit))
                else:
                    names.append(UNDEFINED)
                    rejected.append(True)
        return names, scores, rejected


def sample_features(docs: DataFrame, key: str, text: str, lang: str, opt: LanguageOptions) -> list:
    """Sampled labelled rows as (language, buckets, weights): ``max_rows`` at most, about
    as many of each language, drawn by a hash of key and text."""
    eligible = docs.filter(F.col(f"`{lang}`").isNotNull() & F.col(f"`{text}`").isNotNull())
    # one row per language
    counts = {r[0]: r[1] for r in eligible.groupBy(F.col(f"`{lang}`")).count().collect()}
    if not counts:
        return []
    share = opt.max_rows / len(counts)
    limit = F.coalesce(*[F.when(F.col(f"`{lang}`") == name, F.lit(min(1.0, share / n)))
                         for name, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64(F.lit(opt.seed), F.col(f"`{key}`"), F.col(f"`{text}`")), F.lit(1 << 30)) / float(1 << 30)
    # a language's draws relative to its limit: the cut treats all languages alike
    sample = (eligible.filter(draw < limit).select(
        (draw / limit).alias("draw"), F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text"))
        .orderBy("draw", "lang", F.xxhash64("text")).limit(opt.max_rows))

    def run(batches):
        for batch in batches:
            buckets, weights = [], []
            for i in range(batch.num_rows):
                data, offsets = text_buffer(batch.column(2).slice(i, 1))
                total = np.zeros(1 << opt.bucket_bits)
                for at in range(0, len(data), SEGMENT_BYTES):
                    piece = data[at:at + SEGMENT_BYTES]
                    for _, bucket, good in ngram_buckets(piece, np.array([0, len(piece)]), opt.bucket_bits):
                        total += np.bincount(bucket[good], minlength=len(total))
                used = np.flatnonzero(total)
                buckets.append(used.astype("<u4").tobytes())
                weights.append((total[used] / max(total.sum(), 1)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(buckets, pa.binary()), pa.array(weights, pa.binary())],
                ["draw", "lang", "buckets", "weights"])

    rows = map_arrow(sample, run, "draw double, lang string, buckets binary, weights binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["draw"], r["buckets"]))
    return [(r["lang"], np.frombuffer(r["buckets"], "<u4").astype(np.int64), np.frombuffer(r["weights"], "<f4"))
            for r in rows if len(r["buckets"])]


def train(rows: list, opt: LanguageOptions = LanguageOptions()) -> LanguageModel:
    """Embeddings and softmax by SGD on four fifths of the rows, temperature and
    rejection limit on the rest."""
    languages = sorted({r[0] for r in rows})
    k, size = len(languages), 1 << opt.bucket_bits
    table = np.zeros((size + 1, max(k, 1)), dtype=np.float32)
    if k == 0:
        return LanguageModel([], table, opt.bucket_bits, 1.0, 1.0)
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(opt.seed)
    back = [r for i, r in enumerate(rows) if i % 5 == 4] or rows
    fit = [r for i, r in enumerate(rows) if i % 5 != 4] or rows
    emb = rng.normal(0, 0.1, (size, opt.dimension))
    out = np.zeros((opt.dimension, k))
    steps, done = opt.epochs * len(fit), 0
    for _ in range(opt.epochs):
        for i in rng.permutation(len(fit)).tolist():
            name, index, weight = fit[i]
            rate = opt.rate * (1 - done / steps)
            done += 1
            mean = weight @ emb[index]
            z = mean @ out
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[name]] -= 1
            back_to = out @ p
            out -= 0.1 * rate * np.outer(mean, p)
            emb[index] -= rate * np.outer(weight, back_to)
    table[:size] = emb @ out
    z = np.stack([w @ table[i] for _, i, w in back])
    y = np.array([number[r[0]] for r in back])

    def chances(t: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
        return e / e.sum(axis=1, keepdims=True)

    grid = np.geomspace(0.05, 20, 60)
    loss = [-np.log(np.maximum(chances(t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
    temperature = float(grid[int(np.argmin(loss))])
    p = chances(temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    right = (p.argmax(axis=1) == y)[order]
    precise = np.cumsum(right) / np.arange(1, len(right) + 1) >= opt.target_precision
    limit = float(p.max(axis=1)[order[np.flatnonzero(precise)[-1]]]) if precise.any() else 1.0
    return LanguageModel(languages, table, opt.bucket_bits, temperature, limit)


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` plus ``lang_pred``, ``score`` and ``rejected``; only the text is
    read to score it."""
    docs = drop_names(docs, ("lang_pred", "score", "rejected"))
    # (buckets + 1) x languages floats: its size follows the number of labels
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if keep_text or c != text]

    def run(batches):
        own = shared.value
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            if own.languages:
                names, scores, rejected = own.score(column)
            else:
                names, scores, rejected = [UNDEFINED] * len(column), np.zeros(len(column)), [True] * len(column)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(names, pa.string()), pa.array(scores), pa.array(rejected, pa.bool_())],
                [*kept, "lang_pred", "score", "rejected"])

    return map_arrow(docs, run, extended(docs.select(*[F.col(f"`{c}`") for c in kept]), OUTPUT))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
        opt: LanguageOptions = LanguageOptions()) -> LanguageModel:
    return train(sample_features(docs, key, text, lang, opt), opt)
