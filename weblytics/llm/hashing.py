"""Vectorised words and hashes over the bytes of an Arrow text column.

A batch of texts is one byte buffer plus document offsets.  Words are maximal
runs of bytes of a class, never crossing a document; every word and every
window of words gets a 64-bit hash from prefix sums, so the cost per byte is a
handful of numpy operations and no Python loop runs per word.

Hash of a byte span: ``mix(sum_j T[b_j] * R^j)`` modulo 2^64 with a fixed
random table ``T`` and an odd ``R``; hash of a word window: the same sum over
the words' hashes with another multiplier.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: odd multipliers, both 5 modulo 8 (their powers have the longest period)
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD6E8FEB86659FD95
#: bytes hashed at once; bounds the temporary arrays, not the documents
SEGMENT_BYTES = 1 << 20

_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def word_class(pattern: str) -> np.ndarray:
    """256 booleans: which bytes belong to a word.

    ``"nonspace"``: all but the space and 0x09-0x0D; ``"alnum"``: ASCII digits
    and letters and every byte of a non-ASCII character."""
    member = np.ones(256, dtype=bool)
    if pattern == "nonspace":
        member[[0x20, *range(0x09, 0x0E)]] = False
    elif pattern == "alnum":
        member[:0x80] = False
        for first, last in (("0", "9"), ("a", "z"), ("A", "Z")):
            member[ord(first):ord(last) + 1] = True
    else:
        raise ValueError(pattern)
    return member


#: byte map that lower-cases A-Z only
FOLD_AZ = np.arange(256, dtype=np.uint8)
FOLD_AZ[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2^64, kept between calls."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 4 * SEGMENT_BYTES:
            _POWERS[base] = have
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def _prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), out=out[1:])
    return out


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
                fold: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of the byte spans of ``data``."""
    table = _TABLE if fold is None else _TABLE[fold]
    total = _prefix(table[data], BYTE_BASE)
    back = powers(inverse(BYTE_BASE), len(data) + 1)
    return mix((total[ends] - total[starts]) * back[starts])


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all ``width``-word windows of a word-hash array (in order);
    windows that cross a document are the caller's to mask."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = _prefix(words, WORD_BASE)
    return mix((total[width:] - total[:-width]) * powers(inverse(WORD_BASE), n)
               + np.uint64(width))


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (rows + 1) of a string or binary column, without
    a copy; a null row is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type)
                                  or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


@dataclass
class Words:
    """Words of a batch: byte spans, hashes, and the first word of each document
    (``first`` has one entry more than there are documents)."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    def windows_of(self, width: int) -> np.ndarray:
        """True for each window start that stays inside its document."""
        n = len(self.hashes) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=bool)
        inside = np.ones(n + width, dtype=np.int64)
        inside[:] = 0
        counts = np.diff(self.first)
        valid = counts >= width
        np.add.at(inside, self.first[:-1][valid], 1)
        np.add.at(inside, self.first[1:][valid] - width + 1, -1)
        return np.cumsum(inside)[:n] > 0


def words_of(data: np.ndarray, offsets: np.ndarray, member: np.ndarray,
             fold: np.ndarray | None = None) -> Words:
    """Words of all documents of a buffer, hashed in segments of bounded size."""
    n = len(data)
    edges = np.zeros(n + 1, dtype=bool)
    edges[offsets[offsets <= n]] = True
    starts, ends, hashes = [], [], []
    at = 0
    while at < n:
        stop = min(n, at + SEGMENT_BYTES)
        while stop < n and not edges[stop] and member[data[stop]]:
            # a word runs over the cut: move on to its end
            ahead = data[stop:stop + 4096]
            gap = np.flatnonzero(~member[ahead] | edges[stop:stop + len(ahead)])
            stop += int(gap[0]) if len(gap) else len(ahead)
        part = data[at:stop]
        inside = member[part]
        edge = edges[at:stop + 1]
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:] | edge[1:-1]
        s = np.flatnonzero(opens)
        e = np.flatnonzero(closes) + 1
        hashes.append(span_hashes(part, s, e, fold))
        starts.append(s + at)
        ends.append(e + at)
        at = stop
    none = np.zeros(0, dtype=np.int64)
    s = np.concatenate(starts) if starts else none
    e = np.concatenate(ends) if ends else none
    h = np.concatenate(hashes) if hashes else none.astype(np.uint64)
    return Words(s, e, h, np.searchsorted(s, offsets).astype(np.int64))


def batches_of(column, limit: int = 4 << 20):
    """(first row, last row + 1) ranges of a text column whose bytes stay near
    ``limit``; a longer single document is a range of its own."""
    _, offsets = text_buffer(column)
    rows, at = len(offsets) - 1, 0
    while at < rows:
        stop = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        stop = min(rows, max(stop, at + 1))
        yield at, stop
        at = stop
