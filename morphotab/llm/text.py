"""Helpers shared by the text operators: Arrow slices, words and their hashes, tables in the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 2 << 20  # text a task looks at in one numpy step
BLOCK_BYTES = 1 << 20  # bytes hashed in one step
WORD = r"[^\x20\x09-\x0D]+"

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = 0x9E3779B97F4A7C15 | 5  # odd, so it has an inverse modulo 2**64
_STEP = np.uint64(_BASE)
_BACK = np.uint64(pow(_BASE, -1, 1 << 64))
BYTE_KEYS = np.random.default_rng(42).integers(1, 1 << 63, 256, dtype=np.uint64)
#: As BYTE_KEYS, but ASCII punctuation counts as nothing.
LETTER_KEYS = BYTE_KEYS.copy()
LETTER_KEYS[[b for b in range(33, 127) if not chr(b).isalnum()]] = 0
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where the session names none, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: its lineage is cut, and its size is known to the planner."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs`, all columns, whose doc_id is not among `ids` (one column doc_id); rows without doc_id stay.

    The ids may be a fixed share of the rows, so they are not broadcast at any size.
    """
    return docs.join(ids.hint("shuffle_hash"), "doc_id", "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % n, F.lit(0))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in pieces of about `size` bytes of text, one row at least; a null text becomes empty."""
    for batch in batches:
        k = batch.schema.get_field_index(column)
        batch = batch.set_column(k, column, pc.fill_null(batch.column(k), ""))
        sizes = np.cumsum(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False)) if batch.num_rows else []
        at = 0
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + size, "right")))
            yield batch.slice(at, end - at)
            at = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the n + 1 offsets of its rows in them."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (n + 1 entries)."""
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    end = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    first[begin] = inside[begin]
    last[end] = inside[end]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        ahead, back = np.full(size, _STEP), np.full(size, _BACK)
        ahead[0] = back[0] = 1
        _powers = (np.cumprod(ahead, dtype=np.uint64), np.cumprod(back, dtype=np.uint64))
    return _powers


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray = BYTE_KEYS) -> np.ndarray:
    """64-bit hashes of spans that follow one another: a polynomial in the byte keys from prefix sums, then mixed."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        stop = max(at + 1, int(np.searchsorted(ends, base + BLOCK_BYTES, "right")))
        size = int(ends[stop - 1] - base)
        ahead, back = _tables(size + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(keys[data[base : base + size]] * ahead[:size], out=sums[1:])
        a = starts[at:stop] - base
        out[at:stop] = (sums[ends[at:stop] - base] - sums[a]) * back[a]
        at = stop
    return mix(out)


def row_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of `values` over the rows that begin at `firsts` (n + 1 entries); an empty row sums to 0."""
    sums = np.concatenate(([0], np.cumsum(values)))
    return sums[firsts[1:]] - sums[firsts[:-1]]


class Tally:
    """Counts by 64-bit key, held as sorted arrays and handed out when they have grown past a limit."""

    def __init__(self, limit: int = 1 << 19):
        self.limit, self.keys, self.counts = limit, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        both = np.concatenate((self.keys, found))
        self.keys, back = np.unique(both, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate((self.counts, n)), len(self.keys)).astype(np.int64)

    def full(self) -> bool:
        return len(self.keys) > self.limit

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.keys, self.counts
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return out
