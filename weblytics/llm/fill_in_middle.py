r"""Fill-in-the-middle transformation.

Every text is cut into prefix, middle and suffix at two unit boundaries and
written in one of three forms::

    plain   the text
    psm     <P>prefix<S>suffix<M>middle
    spm     <S>suffix<P>prefix<M>middle

A unit is a line (``[^\n]*\n|[^\n]+``) or a code point.  The cuts and the form
are drawn from the first four 32-bit groups of ``sha256("<seed>:<id>")``, so
a retried task cuts alike.

Finding a cut: the bytes of a batch are divided into fixed blocks, and a Fenwick
tree over the blocks holds each block's number of unit ends and of code points.
Binary lifting from the highest power of two down finds the block that holds
the k-th unit end (all cuts of a batch descend together), and that one block is
searched for the byte.  Lengths in code points are differences of prefix sums of
the same tree plus the count inside one block.

``transform`` gives the output text; ``restored`` rebuilds the original
from output and form with column functions (the sentinels cannot occur in a
text that is cut, so the output splits at exactly three places).

Edge cases: NULL and empty texts and texts that contain a sentinel stay plain,
with NULL lengths (a NULL text is an empty one); texts of any length are cut
whole; a NULL id is drawn as the empty id, repeated ids draw alike; an empty
table gives no rows; input columns named like output columns are replaced.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weblytics.llm.common import drop_names, extended, map_arrow
from weblytics.llm.hashing import batches_of, text_buffer

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
OUTPUT = "n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class FimOptions:
    """``percent`` of the texts are cut, ``spm_percent`` of those in the spm
    form.  ``block_bytes`` only decides how much is searched locally."""

    seed: int = 7
    unit: str = "line"
    percent: int = 100
    spm_percent: int = 50
    block_bytes: int = 512


class BlockIndex:
    """Fenwick tree over fixed blocks of a byte buffer, with one column for the
    unit ends and one for the code points of each block."""

    def __init__(self, data: np.ndarray, unit: str = "line", block: int = 512):
        if unit not in ("line", "char"):
            raise ValueError(f"unknown unit {unit!r}")
        self.data, self.unit, self.block = data, unit, block
        n = max(1, -(-len(data) // block))
        padded = np.full(n * block, 0x80, np.uint8)     # continuation bytes: neither unit nor code point
        padded[:len(data)] = data
        shaped = padded.reshape(n, block)
        # tree[i] sums the blocks (i - lowbit(i), i]: from prefix sums, for all i at once
        total = np.zeros((n + 1, 2), np.int64)
        np.cumsum(self._ends(shaped).sum(axis=1), out=total[1:, 0])
        np.cumsum(((shaped & 0xC0) != 0x80).sum(axis=1), out=total[1:, 1])
        at = np.arange(n + 1)
        self.tree = total - total[at - (at & -at)]

    def _ends(self, data: np.ndarray) -> np.ndarray:
        # a code point is counted at its first byte
        return data == 10 if self.unit == "line" else (data & 0xC0) != 0x80

    def _before_block(self, blocks: np.ndarray, column: int) -> np.ndarray:
        """Sums of the blocks before each given one."""
        at, out = blocks.copy(), np.zeros(len(blocks), np.int64)
        while at.any():
            out += self.tree[at, column]
            at &= at - 1
        return out

    def before(self, places: np.ndarray, column: int) -> np.ndarray:
        """Unit ends (column 0) or code points (column 1) before byte places."""
        blocks = places // self.block
        out = self._before_block(blocks, column)
        for i, (p, b) in enumerate(zip(places.tolist(), blocks.tolist())):
            part = self.data[b * self.block:p]
            if len(part):
                marks = self._ends(part) if column == 0 else (part & 0xC0) != 0x80
                out[i] += np.count_nonzero(marks)
        return out

    def place_of(self, ranks: np.ndarray) -> np.ndarray:
        """Byte place of the ``rank``-th unit mark (1 is the first) of the buffer."""
        at = np.zeros(len(ranks), np.int64)
        left = ranks.astype(np.int64).copy()
        step = 1 << max(0, len(self.tree) - 1).bit_length()
        while step:
            ahead = at + step
            inside = ahead < len(self.tree)
            held = self.tree[np.where(inside, ahead, 0), 0]
            go = inside & (held < left)      # the mark lies beyond those blocks
            at = np.where(go, ahead, at)
            left -= np.where(go, held, 0)
            step >>= 1
        out = np.empty(len(ranks), np.int64)
        for i, (b, rank) in enumerate(zip(at.tolist(), left.tolist())):
            start = b * self.block
            out[i] = start + np.flatnonzero(self._ends(self.data[start:start + self.block]))[rank - 1]
        return out


def draws(seed: int, key) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return tuple(int.from_bytes(digest[k:k + 4], "big") for k in (0, 4, 8, 12))


def cut_batch(keys: list, data: np.ndarray, offsets: np.ndarray, special: np.ndarray,
              opt: FimOptions) -> tuple[list, ...]:
    """(n, form, prefix_chars, middle_chars, output) lists of a batch of texts."""
    index = BlockIndex(data, opt.unit, opt.block_bytes)
    first, last = offsets[:-1], offsets[1:]
    marks = index.before(offsets, 0)
    # the last line of a text may have no end of its own
    open_end = np.zeros(len(first), bool)
    if opt.unit == "line":
        some = last > first
        open_end[some] = data[last[some] - 1] != 10
    n = np.diff(marks) + open_end
    drawn = np.array([draws(opt.seed, k) for k in keys], np.int64).reshape(-1, 4)
    cut = (last > first) & ~special & (drawn[:, 2] % 100 < opt.percent)
    spm = drawn[:, 3] % 100 < opt.spm_percent
    units = np.sort(drawn[:, :2] % (n + 1)[:, None], axis=1)

    def place(k: np.ndarray) -> np.ndarray:
        """Byte place after the first ``k`` units of each text."""
        out = np.where(k == 0, first, last)
        look = cut & (k > 0) & (k < n)
        if look.any():
            rank = marks[:-1][look] + k[look]
            # a line ends behind its mark, a code point where the next one starts
            out[look] = index.place_of(rank) + 1 if opt.unit == "line" else index.place_of(rank + 1)
        return out

    one, two = place(units[:, 0]), place(units[:, 1])
    chars = [index.before(p, 1) for p in (first, one, two)]
    raw = data.tobytes()
    form, head, mid, out = [], [], [], []
    for i, (a, p, m, z) in enumerate(zip(first.tolist(), one.tolist(), two.tolist(), last.tolist())):
        if not cut[i]:
            form.append("plain"), head.append(None), mid.append(None), out.append(raw[a:z])
            continue
        head.append(int(chars[1][i] - chars[0][i]))
        mid.append(int(chars[2][i] - chars[1][i]))
        form.append("spm" if spm[i] else "psm")
        parts = (SUFFIX, raw[m:z], PREFIX, raw[a:p]) if spm[i] else (PREFIX, raw[a:p], SUFFIX, raw[m:z])
        out.append(b"".join((*parts, MIDDLE, raw[p:m])))
    return n.tolist(), form, head, mid, out


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text",
              opt: FimOptions = FimOptions(), keep_text: bool = False) -> DataFrame:
    """``docs`` plus the columns of ``OUTPUT``."""
    docs = drop_names(docs, [c.split()[0] for c in OUTPUT.split(", ")])
    kept = [c for c in docs.columns if keep_text or c != text]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64()]

    def run(batches):
        for batch in batches:
            for a, b in batches_of(batch.column(batch.schema.get_field_index(text))):
                part = batch.slice(a, b - a)
                texts = part.column(part.schema.get_field_index(text))
                data, offsets = text_buffer(texts)
                special = np.zeros(len(texts), bool)
                for mark in (PREFIX, SUFFIX, MIDDLE):
                    found = pc.fill_null(pc.match_substring(texts, mark.decode()), False)
                    special |= found.to_numpy(zero_copy_only=False)
                keys = part.column(part.schema.get_field_index(key)).to_pylist()
                *numbers, output = cut_batch(keys, data, offsets, special, opt)
                arrays = [part.column(part.schema.get_field_index(c)) for c in kept]
                more = [pa.array(v, k) for v, k in zip(numbers, kinds)]
                yield pa.RecordBatch.from_arrays(
                    [*arrays, *more, pa.array(output, pa.binary()).cast(pa.string())],
                    [*kept, "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_arrow(docs, run, extended(docs.select(*[F.col(f"`{c}`") for c in kept]), OUTPUT))


def restored(output: str = "output", form: str = "form") -> Column:
    """The exact text that an output was made of."""
    parts = F.split(F.col(output), "<[PSM]>", -1)
    return (F.when(F.col(form) == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
            .when(F.col(form) == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
            .otherwise(F.col(output)))
