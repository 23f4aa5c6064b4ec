"""Order-preserving packing of documents into token sequences.

Documents stay in key order.  A task encodes its range of documents into one
stream of ids and chooses the cuts by dynamic programming over the places
where a cut makes sense: document ends (free), sentence ends (small penalty)
and, inside long runs without a sentence end, every ``hard_every`` tokens
(larger truncation penalty).  With ``f(j)`` the least cost of the stream up to
cut ``j``,

    f(j) = penalty(j) + min over i, 0 < p_j - p_i <= L, of
           f(i) + per_sequence + (0 if p_j - p_i is a power of two else L - (p_j - p_i))

The padded transitions compare ``f(i) + p_i`` over a sliding window of cuts: a
monotone queue gives its minimum in constant time per cut.  The transitions
without padding go back by 2^k tokens, a handful of look-ups.

The stream is solved in chunks of bounded size; the last two sequences of a
chunk are solved again with the next one.  Sequence ids are the task's number
times 2^40 plus a running number.

Edge cases: a NULL text is an empty document (its end id only); rows that
repeat a key are packed each, in text order; NULL keys come first; an empty
table gives no rows.  Columns other than key and text are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import in_key_order, map_arrow
from weblytics.llm.hashing import batches_of, text_buffer
from weblytics.llm.tokens import encoder, sentence_ends, tokenizer_path

SCHEMA = ("doc_id long, start long, length long, doc_tokens long, sequence_id long, "
          "offset long, padded_length long, ids binary")


@dataclass(frozen=True)
class PackOptions:
    """Costs are in padding tokens."""

    length: int = 2048
    end_id: int = 1
    sentence_penalty: int = 8
    hard_penalty: int = 32
    hard_every: int = 128
    per_sequence: int = 16
    smallest_power: int = 6
    chunk_tokens: int = 1 << 19


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence: np.ndarray,
               opt: PackOptions) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts (token positions, 0 first, the stream's end last) and the
    penalty of each."""
    n = len(ids)
    penalty = np.full(n + 1, -1, dtype=np.int64)
    penalty[1:][sentence[ids]] = opt.sentence_penalty
    penalty[0] = penalty[n] = 0
    penalty[doc_ends] = 0
    at = np.flatnonzero(penalty >= 0)
    gaps = np.diff(at)
    extra = (gaps - 1) // opt.hard_every
    if extra.any():
        base = np.repeat(at[:-1], extra)
        step = np.arange(int(extra.sum())) - np.repeat(np.cumsum(extra) - extra, extra) + 1
        penalty[base + step * opt.hard_every] = opt.hard_penalty
        at = np.flatnonzero(penalty >= 0)
    return at, penalty[at]


def best_cuts(at: np.ndarray, penalty: np.ndarray, opt: PackOptions) -> list[int]:
    """Sequence ends of the cheapest division of the stream."""
    exact: dict[int, list[int]] = {}
    power = 1 << opt.smallest_power
    while power < opt.length:
        source = np.searchsorted(at, at - power)
        for j in np.flatnonzero((at >= power) & (at[source] == at - power)).tolist():
            exact.setdefault(j, []).append(int(source[j]))
        power *= 2
    places, costs = at.tolist(), penalty.tolist()
    length, each = opt.length, opt.per_sequence
    # a padded sequence costs nothing more at full length, a power of two or not
    best = [0] * len(places)
    back = [0] * len(places)
    queue: deque[int] = deque([0])
    keys = [0] * len(places)
    for j in range(1, len(places)):
        p = places[j]
        while p - places[queue[0]] > length:
            queue.popleft()
        i = queue[0]
        cost = keys[i] + length - p
        for k in exact.get(j, ()):
            if best[k] < cost:
                i, cost = k, best[k]
        cost += costs[j] + each
        best[j], back[j] = cost, i
        key = keys[j] = cost + p
        while queue and keys[queue[-1]] > key:
            queue.pop()
        queue.append(j)
    ends, j = [], len(places) - 1
    while j > 0:
        ends.append(places[j])
        j = back[j]
    return ends[::-1]


@dataclass
class _Stream:
    """Ids not yet given out, and the documents that they belong to."""

    ids: list = field(default_factory=list)
    keys: list = field(default_factory=list)
    ends: list = field(default_factory=list)    # positions in the stream
    skipped: list = field(default_factory=list)  # tokens of the document given out before
    size: int = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.ids.append(ids)
        self.size += len(ids)
        self.keys.append(key)
        self.ends.append(self.size)
        self.skipped.append(0)


def _pieces(stream: _Stream, last: bool, sentence: np.ndarray, opt: PackOptions, first_id: int):
    """Pack what the stream holds; keeps the tail back unless it is the last.
    Returns (columns of the pieces, number of sequences)."""
    ids = np.concatenate(stream.ids)
    doc_ends = np.asarray(stream.ends, dtype=np.int64)
    ends = best_cuts(*cut_places(ids, doc_ends, sentence, opt), opt)
    if not last:
        ends = ends[:-2]
    if not ends:
        return None, 0
    ends_ = np.asarray(ends, dtype=np.int64)
    begins = np.append(0, ends_[:-1])
    until = int(ends_[-1])
    bounds = np.unique(np.concatenate([[0], ends_, doc_ends[doc_ends <= until]]))
    lo, hi = bounds[:-1], bounds[1:]
    doc = np.searchsorted(doc_ends, lo, side="right")
    seq = np.searchsorted(ends_, lo, side="right")
    doc_begins = np.append(0, doc_ends[:-1])
    skipped = np.asarray(stream.skipped, dtype=np.int64)
    sizes = (ends_ - begins)[seq]
    whole = (sizes & (sizes - 1)) == 0
    raw = ids.astype("<u4").tobytes()
    columns = [
        [stream.keys[d] for d in doc.tolist()],
        lo - doc_begins[doc] + skipped[doc],
        hi - lo,
        (doc_ends - doc_begins + skipped)[doc],
        first_id + seq,
        lo - begins[seq],
        np.where(whole, sizes, opt.length),
        [raw[4 * a:4 * b] for a, b in zip(lo.tolist(), hi.tolist())],
    ]
    # keep the tail
    keep = int(np.searchsorted(doc_ends, until, side="right"))
    stream.ids = [ids[until:]] if until < len(ids) else []
    if keep < len(doc_ends) and doc_begins[keep] < until:
        skipped[keep] += until - doc_begins[keep]
    stream.keys = stream.keys[keep:]
    stream.ends = (doc_ends[keep:] - until).tolist()
    stream.skipped = skipped[keep:].tolist()
    stream.size = len(ids) - until
    return columns, len(ends)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
         options: PackOptions = PackOptions()) -> DataFrame:
    """Pieces of packed sequences: ``doc_id``, ``start`` and ``length`` in the
    document's ids, ``doc_tokens``, ``sequence_id``, ``offset`` in the
    sequence, ``padded_length`` of the sequence and the ids (little-endian
    unsigned 32-bit)."""
    path = path or tokenizer_path()
    opt = options

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, sentence = encoder(path), sentence_ends(path)
        if opt.end_id >= len(sentence):
            sentence = np.append(sentence, np.zeros(opt.end_id + 1 - len(sentence), dtype=bool))
        next_id = TaskContext.get().partitionId() << 40
        stream = _Stream()
        kinds = [pa.int64()] * 7 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset",
                 "padded_length", "ids"]

        def out(last: bool):
            nonlocal next_id
            columns, count = _pieces(stream, last, sentence, opt, next_id)
            next_id += count
            if columns:
                for a in range(0, len(columns[0]), 20_000):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c[a:a + 20_000], k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            for a, b in batches_of(batch.column(1)):
                keys = batch.column(0).slice(a, b - a).to_pylist()
                ids, at = enc.encode(*text_buffer(batch.column(1).slice(a, b - a)))
                for k, doc in enumerate(keys):
                    stream.add(doc, np.append(ids[at[k]:at[k + 1]], np.uint32(opt.end_id)))
                    if stream.size >= opt.chunk_tokens:
                        yield from out(False)
        if stream.size:
            yield from out(True)

    ordered = in_key_order(docs, key, text)
    return map_arrow(ordered, run, SCHEMA)
