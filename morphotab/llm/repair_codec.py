"""Token ids in files, compressed by Re-Pair.

Texts are encoded where they are read and stored as 16-bit ids, so that texts are never shuffled. Documents are then sorted by
range of doc_id and their ids, each closed by an end id, are gathered into shards of about `shard_ids` ids at ends of
documents. In a shard, frequent pairs of neighbouring ids are replaced by new symbols until no pair stands LEAST times
without overlap; each round takes the most frequent pairs such that no symbol ends one pair and begins another, so that
replacements of different pairs never overlap, and in a run of one symbol every other place. A shard is one row of a
Parquet table in a shared folder:

    part, seq, n_ids   place of the shard: range of doc_id, number in it; number of its ids
    doc_ids, lengths   of its documents, 64-bit and 32-bit
    pairs              left and right of each rule, 32-bit; rule k is the symbol FIRST + k
    expansion          number of ids that each rule stands for, 32-bit
    symbols            what is left, 32-bit, or 16-bit if all fit (column `narrow`)
    places             ids before every EVERY-th symbol, 64-bit, for random access

All integers are little-endian. `decode` gives any range of a shard's ids and expands only the symbols that it touches.

Null or empty texts are their end id alone. Rows with equal doc_id follow one another. An empty table gives no shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from morphotab.llm import text as T
from morphotab.llm import tokens

SHARD_IDS = 1 << 21
PAIRS = 4096  # rules of a round at most; further pairs wait for the next one
LEAST = 64  # times a pair occurs, at least
FIRST = 50_257
EVERY = 1024
FEW = 1 << 17  # places whose pairs are counted by sorting
BINS = 20
FIELDS = "part long, seq long, n_ids long, doc_ids binary, lengths binary, pairs binary, expansion binary, symbols binary, narrow boolean, places binary"


def _bins(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return ((left * np.uint32(0x9E3779B1)) ^ (right * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D) >> np.uint32(32 - BINS)


def _frequent(x: np.ndarray, live: np.ndarray, exact: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """Frequent pairs of neighbours, none of which begins with the end of another; the places to replace, the number of
    the pair at each, and those of the places `live` whose pairs may be frequent.

    Pairs are counted by hash, and one of each hash is looked at, which is quick while there are many; if `exact`, all are.
    """
    if exact:
        bins = np.unique(x[live].astype(np.uint64) << np.uint64(32) | x[live + 1], return_inverse=True)[1]
        counts = np.bincount(bins)
    else:
        bins = _bins(x[live], x[live + 1])
        counts = np.bincount(bins, minlength=1 << BINS)
    crowded = counts >= LEAST
    on = crowded[bins]
    live, bins = live[on], bins[on]
    top = np.flatnonzero(crowded)
    if not exact:
        top = top[np.argsort(-counts[top], kind="stable")][: 2 * PAIRS]
    wanted = np.full(len(counts), -1, np.int32)
    wanted[top] = np.arange(len(top), dtype=np.int32)
    rank = wanted[bins]
    at, rank = live[rank >= 0], rank[rank >= 0]
    place = np.zeros(len(top), np.int64)
    place[rank] = at  # some pair of each hash, nearly always its most frequent
    left, right = x[place], x[place + 1]
    good = (x[at] == left[rank]) & (x[at + 1] == right[rank])
    good &= ~_overlapping(at, (left == right)[rank] & good)
    at, rank = at[good], rank[good]
    n = np.bincount(rank, minlength=len(top))
    out, firsts, seconds = [], set(), set()
    number = np.full(len(top), -1, np.int32)
    for k, a, b, j in sorted(zip(n.tolist(), left.tolist(), right.tolist(), range(len(top)), strict=True), reverse=True):
        if k < LEAST or len(out) == PAIRS:
            break
        if a not in seconds and b not in firsts and (a != b or a not in firsts and a not in seconds):
            number[j] = len(out)
            out.append((a, b))
            firsts.add(a)
            seconds.add(b)
    number = number[rank]
    return out, at[number >= 0], number[number >= 0], live


def _overlapping(at: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """Which of the places `at` begin at the second symbol of a pair of two alike symbols that is itself replaced."""
    out = np.zeros(len(at), bool)
    mine = np.flatnonzero(alike)
    if len(mine):
        place, k = at[mine], np.arange(len(mine))
        new = np.ones(len(mine), bool)
        new[1:] = np.diff(place) != 1  # neighbouring places of alike pairs hold one symbol
        out[mine] = (k - np.maximum.accumulate(np.where(new, k, 0))) % 2 == 1
    return out


def compress(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is left of the ids, and the rules' pairs (n, 2); no pair stands LEAST times in what is left."""
    x, rules = ids.astype(np.uint32), []
    live = np.arange(len(x) - 1)  # a pair that is not frequent never gets so, hence only pairs beside new symbols join
    exact = False
    while len(live):
        new, at, number, live = _frequent(x, live, exact := exact or len(live) < FEW)
        if not new:
            if exact:
                break
            exact = True
            continue
        x[at] = (FIRST + len(rules) + number).astype(np.uint32)
        keep = np.ones(len(x), bool)
        keep[at + 1] = False
        mine = np.zeros(len(x), bool)
        mine[live] = True
        x, mine = x[keep], mine[keep]
        at = at - np.arange(len(at))
        mine[at] = True
        mine[at[at > 0] - 1] = True
        live = np.flatnonzero(mine[:-1])
        rules += new
        exact = False
    return x, np.array(rules, np.uint32).reshape(-1, 2)


def expansions(pairs: np.ndarray) -> np.ndarray:
    """Number of ids that each rule stands for; a rule uses earlier ones only."""
    out: list[int] = []
    for a, b in pairs.tolist():
        out.append((out[a - FIRST] if a >= FIRST else 1) + (out[b - FIRST] if b >= FIRST else 1))
    return np.array(out, np.int64)


def expand(symbols: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    x = symbols.astype(np.uint32)
    while len(at := np.flatnonzero(x >= FIRST)):
        rule = x[at] - FIRST
        wide = np.ones(len(x), np.int64)
        wide[at] = 2
        place = at + np.arange(len(at))
        x = np.repeat(x, wide)
        x[place], x[place + 1] = pairs[rule, 0], pairs[rule, 1]
    return x


def _shard(seq: int, doc_ids: list, ids: list[bytes]) -> tuple:
    x, pairs = compress(np.frombuffer(b"".join(ids), "<u2"))
    size = expansions(pairs)
    each = np.ones(len(x), np.int64)
    big = x >= FIRST
    each[big] = size[x[big] - FIRST]
    places = (np.cumsum(each) - each)[::EVERY]
    narrow = not len(x) or int(x.max()) < 1 << 16
    named = np.array([-1 << 63 if d is None else d for d in doc_ids], "<i8")
    lengths = np.array([len(i) // 2 for i in ids], "<u4")
    return (TaskContext.get().partitionId(), seq, int(lengths.astype(np.int64).sum()), named.tobytes(), lengths.tobytes(), pairs.astype("<u4").tobytes(), size.astype("<u4").tobytes(), x.astype("<u2" if narrow else "<u4").tobytes(), narrow, places.astype("<u8").tobytes())


def write_shards(docs: DataFrame, vocabulary: str, path: str, shard_ids: int = SHARD_IDS) -> None:
    """Writes the shards of all documents to `path`, in ascending doc_id order."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, blanks=True).encode
        end = np.array([tokens.END_ID], "<u2").tobytes()
        for batch in T.slices(batches, size=tokens.SLICE_BYTES):
            ids = [np.frombuffer(own, "<u4").astype("<u2").tobytes() + end for own in encode(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in FIELDS.split(", ")]
        row = lambda seq: pa.RecordBatch.from_pylist([dict(zip(names, _shard(seq, doc_ids, ids), strict=True))])
        doc_ids, ids, size, seq = [], [], 0, 0
        for batch in batches:
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                doc_ids.append(doc_id)
                ids.append(own)
                size += len(own) // 2
                if size >= shard_ids:
                    yield row(seq)
                    doc_ids, ids, size, seq = [], [], 0, seq + 1
        if doc_ids:
            yield row(seq)

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(encoded, "doc_id long, ids binary")
    ordered = T.stored(ids, "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(run, FIELDS).write.option("compression", "zstd").parquet(path)


def decode(shard: dict, start: int = 0, length: int | None = None) -> np.ndarray:
    """Ids `start` to `start + length` of a shard row."""
    pairs = np.frombuffer(shard["pairs"], "<u4").reshape(-1, 2)
    symbols = np.frombuffer(shard["symbols"], "<u2" if shard["narrow"] else "<u4")
    if start == 0 and length is None:
        return expand(symbols, pairs)
    places = np.frombuffer(shard["places"], "<u8").astype(np.int64)
    total = int(np.frombuffer(shard["lengths"], "<u4").astype(np.int64).sum())
    stop = total if length is None else min(total, start + length)
    if start >= stop:
        return np.zeros(0, np.uint32)
    a, b = np.searchsorted(places, start, "right") - 1, np.searchsorted(places, stop, "left")
    out = expand(symbols[a * EVERY : b * EVERY], pairs)
    return out[start - places[a] : stop - places[a]]


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files alone."""
    files = spark.read.schema(FIELDS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                ids = decode(shard).astype("<u4").tobytes()
                lengths = np.frombuffer(shard["lengths"], "<u4").astype(np.int64)
                ends = np.cumsum(lengths)
                doc_ids = np.frombuffer(shard["doc_ids"], "<i8")
                crc = [zlib.crc32(ids[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                n = len(doc_ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, mask=doc_ids == -1 << 63), pa.array([shard["part"]] * n, pa.int64()), pa.array([shard["seq"]] * n, pa.int64()), ends - lengths, lengths, pa.array(crc, pa.int64())],
                    ["doc_id", "part", "seq", "at", "n_tokens", "ids_crc32"],
                )

    rows = files.mapInArrow(run, "doc_id long, part long, seq long, at long, n_tokens long, ids_crc32 long")
    sizes = files.select("part", "seq", "n_ids")
    total = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row for each range of doc_id
    before = total.select(F.col("part").alias("p"), (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    base = sizes.withColumn("inside", inside).join(before, F.col("part") == F.col("p")).select("part", "seq", (F.col("base") + F.col("inside")).alias("base"))
    return rows.join(base, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes the shards into the shared folder and reads them back."""
    path = f"{T.shared_folder(docs.sparkSession)}/llm-ids-{uuid.uuid4().hex}"
    write_shards(docs, vocabulary, path, shard_ids)
    return read_shards(docs.sparkSession, path)
