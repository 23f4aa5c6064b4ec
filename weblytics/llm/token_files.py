"""Token ids in Huffman-coded block files.

1. Documents in key order are encoded; consecutive documents form blocks.
2. Global counts of ids (at most one row per id of the vocabulary) give
   length-limited code lengths by package-merge; the lengths alone define the
   canonical code.
3. Every block is coded on its own.  A block's payload is
   ``magic, documents, tokens, checkpoint distance, payload bytes`` followed by
   the documents' token counts (u32), the bit offset of every
   ``checkpoint``-th token (u64) and the bits (most significant first).
4. Decoding looks the next bits up in a table (id, length); all checkpoints of a
   block are decoded side by side.  Codes have at most 16 bits, or as many as the
   number of used ids needs, and the table covers the longest.

Files are Parquet rows ``(part, block, doc_ids, payload)`` plus one code table
of ``(id, bits)`` in the shared work folder.

Edge cases: a NULL text is an empty document (its end id only); rows that
repeat a key are kept, in the order of their texts' first 64 characters,
then of a hash; NULL keys come first; an empty table
gives no blocks and an empty code.  Columns other than key and text are not
read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weblytics.llm.common import in_key_order, map_arrow, store
from weblytics.llm.hashing import batches_of, text_buffer
from weblytics.llm.tokens import encoder, load, tokenizer_path

MAGIC = b"HTB1"
MAX_BITS = 16
HEADER = "<4sIQIQ"


@dataclass(frozen=True)
class FileOptions:
    end_id: int = 2
    block_tokens: int = 1 << 20
    checkpoint: int = 256


# -- code ---------------------------------------------------------------------

def bit_limit(n_used: int) -> int:
    """Longest code for a number of used ids: one bit to spare beyond ``MAX_BITS``."""
    need = max(n_used - 1, 1).bit_length()
    return MAX_BITS if need <= MAX_BITS else need + 1


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Bits per symbol (0: unused) of an optimal prefix code with at most
    ``limit`` bits, by package-merge."""
    used = np.flatnonzero(counts > 0)
    bits = np.zeros(len(counts), dtype=np.uint8)
    if len(used) == 0:
        return bits
    if len(used) == 1:
        bits[used] = 1
        return bits
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} symbols do not fit into {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    # merged lists from the deepest level up; a list entry is a leaf (True) or
    # a package of two entries of the list below it
    levels = []
    weights = leaves
    is_leaf = np.ones(len(leaves), dtype=bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = len(weights) // 2
        packages = weights[0:2 * pairs:2] + weights[1:2 * pairs:2]
        joined = np.concatenate([leaves, packages])
        leaf = np.concatenate([np.ones(len(leaves), bool), np.zeros(pairs, bool)])
        rank = np.argsort(joined, kind="stable")
        weights, is_leaf = joined[rank], leaf[rank]
    levels.append(is_leaf)
    # the first 2(n - 1) entries of the top list, followed down
    take = 2 * (len(leaves) - 1)
    depth = np.zeros(len(leaves), dtype=np.int64)
    for is_leaf in reversed(levels):
        n_leaves = int(is_leaf[:take].sum())
        depth[:n_leaves] += 1
        take = 2 * (take - n_leaves)
    bits[order] = depth
    return bits


def canonical_codes(bits: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(bits), dtype=np.uint32)
    code, last = 0, 0
    for i in np.lexsort((np.arange(len(bits)), bits)).tolist():
        size = int(bits[i])
        if size == 0:
            continue
        code <<= size - last
        codes[i] = code
        code, last = code + 1, size
    return codes


def decode_table(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every value of as many bits as the longest code has, MAX_BITS
    at least."""
    limit = max(MAX_BITS, int(bits.max(initial=0)))
    ids = np.zeros(1 << limit, dtype=np.uint32)
    sizes = np.zeros(1 << limit, dtype=np.int64)
    order = np.lexsort((np.arange(len(bits)), bits))
    order = order[bits[order] > 0]
    spans = np.left_shift(1, limit - bits[order].astype(np.int64))
    n = int(spans.sum())
    ids[:n] = np.repeat(order, spans)
    sizes[:n] = np.repeat(bits[order].astype(np.int64), spans)
    return ids, sizes


def encode_block(doc_sizes: np.ndarray, ids: np.ndarray, bits: np.ndarray, codes: np.ndarray,
                 checkpoint: int) -> bytes:
    sizes = bits[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    total = int(ends[-1]) if len(ids) else 0
    # a code of up to 25 bits lies in four bytes
    place = (codes[ids].astype(np.uint32) << (32 - sizes - (starts & 7)).astype(np.uint32))
    at = starts >> 3
    n = (total + 7) // 8
    out = np.zeros(n + 4)
    wide = int(sizes.max(initial=0)) > 17       # else the fourth byte is empty
    for k, shift in enumerate((24, 16, 8, 0) if wide else (24, 16, 8)):
        out[:] += np.bincount(at + k, weights=((place >> np.uint32(shift)) & np.uint32(255)),
                              minlength=n + 4)
    head = struct.pack(HEADER, MAGIC, len(doc_sizes), len(ids), checkpoint, n)
    return b"".join([head, doc_sizes.astype("<u4").tobytes(),
                     starts[::checkpoint].astype("<u8").tobytes(),
                     out[:n].astype(np.uint8).tobytes()])


def decode_block(payload: bytes, ids_of: np.ndarray, bits_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token counts of the documents, all ids) of a block."""
    magic, n_docs, n_tokens, checkpoint, n_bytes = struct.unpack_from(HEADER, payload)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize(HEADER)
    doc_sizes = np.frombuffer(payload, "<u4", n_docs, at)
    at += 4 * n_docs
    lanes = -(-n_tokens // checkpoint)
    bit = np.frombuffer(payload, "<u8", lanes, at).astype(np.int64)
    at += 8 * lanes
    raw = np.zeros(n_bytes + 4, dtype=np.uint32)
    raw[:n_bytes] = np.frombuffer(payload, np.uint8, n_bytes, at)
    window = (raw[:-3] << np.uint32(24)) | (raw[1:-2] << np.uint32(16)) | (raw[2:-1] << np.uint32(8)) | raw[3:]
    limit = len(ids_of).bit_length() - 1
    low = np.uint32((1 << limit) - 1)
    out = np.zeros((checkpoint, lanes), dtype=np.uint32)
    short = n_tokens - (lanes - 1) * checkpoint if lanes else 0
    for step in range(min(checkpoint, n_tokens)):
        if step == short:
            bit = bit[:-1]
        byte = bit >> 3
        seen = (window[byte] >> (32 - limit - (bit & 7)).astype(np.uint32)) & low
        out[step, :len(bit)] = ids_of[seen]
        bit = bit + bits_of[seen]
    return doc_sizes, out.T.reshape(-1)[:n_tokens]


# -- Spark --------------------------------------------------------------------

def token_blocks(docs: DataFrame, key: str, text: str, path: str, opt: FileOptions) -> DataFrame:
    """Blocks of consecutive documents: ``part, block, doc_ids, sizes, ids``
    (sizes and ids little-endian, ids with 16 bits where the vocabulary fits)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        keys, parts, block, tokens = [], [], 0, 0

        def out():
            nonlocal keys, parts, block, tokens
            ids = np.concatenate(parts)
            sizes = np.fromiter(map(len, parts), np.uint32, len(parts))
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([block], pa.int64()),
                 pa.array([keys], pa.list_(pa.int64())),
                 pa.array([sizes.astype("<u4").tobytes()], pa.binary()),
                 pa.array([ids.astype("<u4" if wide else "<u2").tobytes()], pa.binary())],
                ["part", "block", "doc_ids", "sizes", "ids"])
            keys, parts, tokens, block = [], [], 0, block + 1
            return row

        wide = _wide(path, opt)
        for batch in batches:
            for a, b in batches_of(batch.column(1)):
                ids, at = enc.encode(*text_buffer(batch.column(1).slice(a, b - a)))
                for k, doc in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    keys.append(doc)
                    parts.append(np.append(ids[at[k]:at[k + 1]], np.uint32(opt.end_id)))
                    tokens += len(parts[-1])
                    if tokens >= opt.block_tokens:
                        yield out()
        if keys:
            yield out()

    ordered = in_key_order(docs, key, text)
    return map_arrow(ordered, run, "part long, block long, doc_ids array<bigint>, sizes binary, ids binary")


def _wide(path: str, opt: FileOptions) -> bool:
    return max(load(path).get_vocab_size(with_added_tokens=True), opt.end_id + 1) > 1 << 16


def id_counts(blocks: DataFrame, wide: bool) -> DataFrame:
    """(id, n) over all blocks; each task sends a row per id at most."""
    def run(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                seen = np.bincount(np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2"))
                if len(seen) > len(total):
                    total = np.pad(total, (0, len(seen) - len(total)))
                total[:len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())],
                                         ["id", "n"])

    return map_arrow(blocks.select("ids"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_files(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None,
                options: FileOptions = FileOptions()) -> tuple[DataFrame, DataFrame]:
    """Encode all documents; returns (block files, code table), both read back."""
    path, opt = path or tokenizer_path(), options
    spark = docs.sparkSession
    wide = _wide(path, opt)
    blocks = store(token_blocks(docs, key, text, path, opt), "token-blocks")
    # at most one row per id of the vocabulary
    counted = id_counts(blocks, wide).collect()
    counts = np.zeros(max([r["id"] for r in counted], default=-1) + 1, dtype=np.int64)
    for r in counted:
        counts[r["id"]] = r["n"]
    bits = code_lengths(counts, bit_limit(len(counted)))
    codes = canonical_codes(bits)
    used = np.flatnonzero(bits)
    code = store(spark.createDataFrame([(int(i), int(bits[i])) for i in used], "id long, bits int")
                 .coalesce(1), "token-code")
    shared = spark.sparkContext.broadcast((bits, codes))

    def run(batches):
        bits, codes = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                sizes = np.frombuffer(batch.column(3)[k].as_buffer(), "<u4")
                ids = np.frombuffer(batch.column(4)[k].as_buffer(), "<u4" if wide else "<u2")
                payload = encode_block(sizes, ids, bits, codes, opt.checkpoint)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(k, 1), batch.column(1).slice(k, 1),
                     batch.column(2).slice(k, 1), pa.array([len(ids)], pa.int64()),
                     pa.array([payload], pa.binary())],
                    ["part", "block", "doc_ids", "n_tokens", "payload"])

    files = store(map_arrow(blocks,
        run, "part long, block long, doc_ids array<bigint>, n_tokens long, payload binary"),
        "token-files")
    return files, code


def read_files(files: DataFrame, code: DataFrame) -> DataFrame:
    """One row per document from the files: ``doc_id, start, n_tokens, ids``
    (``start``: ids of all documents before it; ids little-endian u32)."""
    spark: SparkSession = files.sparkSession
    # at most one row per id of the vocabulary
    rows = code.collect()
    bits = np.zeros(max([r["id"] for r in rows], default=-1) + 1, dtype=np.uint8)
    for r in rows:
        bits[r["id"]] = r["bits"]
    shared = spark.sparkContext.broadcast(decode_table(bits))

    def run(batches):
        ids_of, bits_of = shared.value
        for batch in batches:
            for k in range(batch.num_rows):
                sizes, ids = decode_block(batch.column("payload")[k].as_py(), ids_of, bits_of)
                ends = np.cumsum(sizes.astype(np.int64))
                starts = ends - sizes
                raw = ids.astype("<u4").tobytes()
                n = len(sizes)
                docs = batch.column("doc_ids").slice(k, 1).flatten()
                before = batch.column("before")[k].as_py()
                for a in range(0, n, 5000):
                    b = min(n, a + 5000)
                    yield pa.RecordBatch.from_arrays(
                        [docs.slice(a, b - a), pa.array(before + starts[a:b], pa.int64()),
                         pa.array(sizes[a:b].astype(np.int64)),
                         pa.array([raw[4 * s:4 * e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist())],
                                  pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    # running totals: over a part's blocks, then over the parts (one per task of the writer)
    in_part = Window.partitionBy("part").orderBy("block")
    sizes = files.select("part", "block", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("__n"))
    before_part = parts.select(
        "part", (F.sum("__n").over(Window.orderBy("part")) - F.col("__n")).alias("__before_part"))
    before = (sizes.withColumn("__in", F.sum("n_tokens").over(in_part) - F.col("n_tokens"))
              .join(before_part, "part")
              .select("part", "block", (F.col("__in") + F.col("__before_part")).alias("before")))
    placed = files.join(store(before, "token-offsets"), ["part", "block"])
    return map_arrow(placed, run, "doc_id long, start long, n_tokens long, ids binary")
