"""Packing along a space-filling curve.

A document's hashed words are projected to four dimensions, the point gets a 60-bit Hilbert key, and documents are sorted
by range of (key, doc_id). Each range is one stream of ids that is cut every `capacity` ids, so neighbours on the curve share
sequences and only the last sequence of a range is not full. Copies have one key; their doc_ids still spread them over ranges.

Null or empty texts are their end id alone. Rows with equal doc_id are packed each for itself. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T
from morphotab.llm import tokens

CAPACITY = 4096
DIMENSIONS, DEPTH = 4, 15


def hilbert(points: np.ndarray, depth: int) -> np.ndarray:
    """Hilbert keys of integer points (rows) with `depth` bits a coordinate, by Skilling's transform."""
    x = [points[:, i].astype(np.int64) for i in range(points.shape[1])]
    q = 1 << (depth - 1)
    while q > 1:
        p = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (depth - 1)
    while q > 1:
        turn = np.where((x[-1] & q) != 0, turn ^ (q - 1), turn)
        q >>= 1
    key = np.zeros_like(x[0])
    for bit in range(depth - 1, -1, -1):
        for v in x:
            key = key << 1 | ((v ^ turn) >> bit & 1)
    return key


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in T.slices(batches):
        data, offsets = T.utf8(batch.column("text"))
        starts, ends, firsts = T.word_spans(data, offsets)
        h = T.span_hashes(T.LOWER[data], starts, ends)
        n = np.maximum(1, np.diff(firsts))
        points = []
        for k in range(DIMENSIONS):
            z = T.row_sums((h >> np.uint64(k) & np.uint64(1)).astype(np.int64) * 2 - 1, firsts) / np.sqrt(n)
            points.append(np.clip((np.tanh(z / 4) + 1) / 2 * (1 << DEPTH), 0, (1 << DEPTH) - 1).astype(np.int64))
        yield batch.append_column("key", pa.array(hilbert(np.stack(points, 1), DEPTH)))


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ids: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, the piece's ids (little-endian)."""
    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * ids

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, cache = (tokens.SMALL_SLICE_BYTES, tokens.SMALL_CACHE) if ids else (tokens.SLICE_BYTES, tokens.CACHE)
        encode = tokens.encoder(vocabulary, False, cache).encode
        end = np.array([tokens.END_ID], "<u4").tobytes()
        sequence, used = TaskContext.get().partitionId() << 32, 0
        for batch in T.slices(batches, size=size):
            rows = []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text")), strict=True):
                own += end
                total, at = len(own) // 4, 0
                while at < total:
                    if used == capacity:
                        sequence, used = sequence + 1, 0
                    n = min(total - at, capacity - used)
                    piece = own[4 * at : 4 * (at + n)]
                    rows.append((doc_id, at, n, zlib.crc32(piece), total, sequence, used, *[piece] * ids))
                    at, used = at + n, used + n
            names = [f.split()[0] for f in fields.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if x == "ids" else pa.int64()) for c, x in zip(zip(*rows, strict=True), names, strict=True)], names)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_keys, "doc_id long, text string, key long")
    ordered = keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "text")
    return ordered.select("doc_id", "text").mapInArrow(pack, fields)
