"""Whole-text encoding with the ``tokenizers`` library, once per distinct piece.

A byte-level BPE tokenizer with the usual word pattern (an optional space,
then a run of letters, of digits, or of other visible characters) never joins
whitespace to what stands before it, nor a punctuation mark to a letter or
digit before it.  A text can therefore be cut there, and its ids are the ids
of its pieces in order.  Pieces repeat a lot, so each distinct piece is given
to the library once per worker (a bounded cache) and the ids are put together
with numpy.  Pieces that are one word go straight to the library's BPE model,
all others through its whole pipeline.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

from weblytics.llm.hashing import SEGMENT_BYTES, span_hashes

_ALNUM = np.zeros(256, dtype=bool)
for _a, _z in ("09", "az", "AZ"):
    _ALNUM[ord(_a):ord(_z) + 1] = True
#: bytes after which a piece may end at whitespace: visible ASCII
_VISIBLE = np.zeros(256, dtype=bool)
_VISIBLE[0x21:0x7F] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PUNCT = _VISIBLE & ~_ALNUM
#: U+00C0 .. U+00FF without the signs U+00D7 and U+00F7: letters of two bytes
_LATIN = np.zeros(256, dtype=bool)
_LATIN[0x80:0xC0] = True
_LATIN[[0x97, 0xB7]] = False
#: a piece that the word pattern takes whole (as Latin-1 characters)
_ONE_WORD = re.compile(r" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
#: distinct pieces kept per worker, and the longest piece worth keeping
CACHE_ENTRIES = 1_500_000
CACHE_PIECE_BYTES = 64


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer; strings of special tokens in a text are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return tokenizer


@lru_cache(maxsize=2)
def encoder(path: str) -> "Encoder":
    """The worker's encoder for a tokenizer file (its cache lives on)."""
    return Encoder(path)


def _piece_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    cut = np.zeros(len(data), dtype=bool)
    word = _ALNUM[data]
    word[1:] |= (data[:-1] == 0xC3) & _LATIN[data[1:]]
    cut[1:] = (_SPACE[data[1:]] & (_VISIBLE[data] | word)[:-1]) | (_PUNCT[data[1:]] & word[:-1])
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    if len(cut):
        cut[0] = True
    return np.flatnonzero(cut)


class Encoder:
    def __init__(self, path: str):
        self.tokenizer = load(path)
        self.model = self.tokenizer.model
        # the byte alphabet of the vocabulary: printable Latin-1 characters
        # stand for themselves, the rest for U+0100 and on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.starts = np.zeros(0, dtype=np.int64)
        self.sizes = np.zeros(0, dtype=np.int32)
        self.pool = np.zeros(0, dtype=np.uint16)

    def _ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids: list = [None] * len(pieces)
        other = []
        for k, piece in enumerate(pieces):
            text = piece.decode("latin-1")
            if _ONE_WORD.fullmatch(text):
                ids[k] = [t.id for t in self.model.tokenize(text.translate(self.alphabet))]
            else:
                other.append(k)
        found = self.tokenizer.encode_batch_fast([pieces[k].decode() for k in other],
                                                 add_special_tokens=False)
        for k, e in zip(other, found):
            ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
        return flat, sizes

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """uint32 ids of all documents of a buffer, and where each one's begin
        (one entry more than there are documents)."""
        ids, sizes, firsts = [], [], []
        n = len(data)
        starts = _piece_starts(data, offsets)
        bounds = np.append(starts, n)
        at = 0
        while at < len(starts):
            stop = int(np.searchsorted(starts, starts[at] + SEGMENT_BYTES))
            stop = max(stop, at + 1)
            lo = int(starts[at])
            part = data[lo:int(bounds[stop])]
            flat, size = self._segment(part, starts[at:stop] - lo, bounds[at + 1:stop + 1] - lo)
            ids.append(flat)
            sizes.append(size)
            firsts.append(starts[at:stop])
            at = stop
        if not ids:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        size = np.concatenate(sizes)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        first_piece = np.searchsorted(np.concatenate(firsts), offsets)
        return np.concatenate(ids), ends[first_piece]

    def _segment(self, part, starts, ends):
        raw = part.tobytes()
        long = np.flatnonzero(ends - starts > CACHE_PIECE_BYTES)
        h = span_hashes(part, starts, ends)
        keys, first, back = np.unique(h, return_index=True, return_inverse=True)
        have = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), dtype=bool)
        inside = have < len(self.keys)
        known[inside] = self.keys[have[inside]] == keys[inside]
        new = np.flatnonzero(~known)
        if len(new):
            at = first[new]
            flat, sizes = self._ids([raw[s:e] for s, e in zip(starts[at].tolist(), ends[at].tolist())])
            offset = len(self.pool) + np.cumsum(sizes) - sizes
            wide = np.uint32 if flat.size and int(flat.max()) > 0xFFFF else np.uint16
            kind = np.promote_types(self.pool.dtype, wide)
            self.pool = np.concatenate([self.pool.astype(kind, copy=False), flat.astype(kind)])
            place = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, place, keys[new])
            self.starts = np.insert(self.starts, place, offset)
            self.sizes = np.insert(self.sizes, place, sizes.astype(np.int32))
            have = np.searchsorted(self.keys, keys)
        size = self.sizes[have][back].astype(np.int64)
        out_at = np.cumsum(size) - size
        source = self.starts[have][back]
        ids = self.pool[np.repeat(source - out_at, size) + np.arange(int(size.sum()))].astype(np.uint32)
        if len(self.keys) > CACHE_ENTRIES or len(self.pool) > 8 * CACHE_ENTRIES or (len(long) and len(self.pool) > CACHE_ENTRIES):
            self._clear()
        return ids, size


@lru_cache(maxsize=2)
def sentence_ends(path: str) -> np.ndarray:
    """True for each id whose text ends a sentence (. ! ? or a line break)."""
    tokenizer = load(path)
    size = tokenizer.get_vocab_size(with_added_tokens=True)
    texts = tokenizer.decode_batch([[i] for i in range(size)], skip_special_tokens=False)
    return np.array([t.rstrip(" ").endswith((".", "!", "?", "\n")) for t in texts], dtype=bool)
