"""Packing documents into fixed-length sequences along a space-filling curve.

A document's words are hashed into a vector of ``DIMENSIONS`` signed sums (a random projection of its bag of words),
scaled by the square root of the word count and cut into ``2 ** BITS`` steps per dimension. The Hilbert index of that
point is the sort key: documents near each other on the curve have similar words. Documents are range-partitioned by the
key, sorted, and laid one after another; a sequence is cut whenever it is full. Each range partition starts a sequence
of its own, so no total over all documents is needed, and splits its last, unfilled sequence into sequences whose lengths
are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import append_column, as_text, blocks, release, text_buffer
from .tokens import encoder
from .wordscan import NOT_SPACE, scan

DIMENSIONS, BITS = 4, 8
KEY = "__curve_key"
PIECE = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place along the Hilbert curve of each point (rows of integers below 2**bits), by Skilling's transpose method."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_points(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The projected and quantised word vector of each text; a text without words is at the centre."""
    words = scan(raw, offsets, NOT_SPACE, lower=True)
    counts = words.counts
    out = np.empty((len(counts), DIMENSIONS), np.int64)
    for d in range(DIMENSIONS):
        sign = ((words.hashes >> np.uint64(7 + 11 * d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(sign)])
        sums = total[words.rows[1:]] - total[words.rows[:-1]]
        z = sums / np.sqrt(np.maximum(counts, 1))
        out[:, d] = np.clip(((np.tanh(z / 4) + 1) / 2 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return out


def with_curve_key(docs: DataFrame, text_col: str = "text", key_col: str = KEY) -> DataFrame:
    def key(batch: pa.RecordBatch) -> pa.Array:
        raw, offsets = text_buffer(batch.column(batch.schema.get_field_index(text_col)))
        parts = [hilbert_index(curve_points(raw[offsets[a] : offsets[b]], offsets[a : b + 1]), BITS) for a, b in blocks(offsets)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *parts]))

    return append_column(docs, key_col, T.LongType(), key)


class _Packer:
    """Lays ids out in sequences; rows come out when their sequence is complete."""

    def __init__(self, length: int, first_id: int):
        self.length, self.next_id, self.used = length, first_id, 0
        self.open: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> Iterator[tuple]:
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(self.length - self.used, total - start)
            self.open.append((doc_id, start, n, ids[4 * start : 4 * (start + n)], total, self.next_id, self.used))
            start, self.used = start + n, self.used + n
            if self.used == self.length:
                yield from self.open
                self.open, self.used, self.next_id = [], 0, self.next_id + 1

    def close(self) -> Iterator[tuple]:
        left, rows = self.used, self.open
        sizes = [1 << b for b in range(self.length.bit_length(), -1, -1) if left >> b & 1]
        size, offset = (sizes.pop(0), 0) if sizes else (0, 0)
        for doc_id, start, n, ids, total, _, _ in rows:
            while n:
                take = min(n, size - offset)
                yield doc_id, start, take, ids[: 4 * take], total, self.next_id, offset
                ids, start, n, offset = ids[4 * take :], start + take, n - take, offset + take
                if offset == size:
                    self.next_id += 1
                    size, offset = (sizes.pop(0), 0) if sizes else (0, 0)


def pack_along_curve(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    Every row of ``docs`` is packed, repeated ids included (each row separately); equal keys are ordered by id, then by
    a hash of the text, nulls first. A null or empty text is its end id alone. Extra columns are ignored; an empty table
    gives no pieces. Sequence ids are unique but not consecutive across range partitions.
    """
    rows = as_text(docs, text_col).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = with_curve_key(rows).repartitionByRange(F.col(KEY), F.col("doc_id"), tie).sortWithinPartitions(KEY, "doc_id", tie)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, False).stream
        end = end_id.to_bytes(4, "little")
        packer = _Packer(length, TaskContext.get().partitionId() << 36)
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
            out.clear()
            return batch

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode(batch.column(1), 4 << 20), strict=True):
                out.extend(packer.add(doc_id, ids + end))
                if len(out) >= 2000:
                    yield flush()
        out.extend(packer.close())
        yield flush()
        release()

    return ordered.select("doc_id", "text").mapInArrow(pack, PIECE)
