"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the presence of lower-cased words without punctuation, of neighbouring pairs, of pairs with one word between,
and of beginnings of words (so that inflected forms share features), hashed to 2 ** 24 coordinates. Every coordinate has its own learning rate, and an L1 penalty keeps most weights at
exactly zero; what is left is broadcast as (index, weight). The fit reads a sample of about `sample` labelled rows, chosen by
a hash of doc_id, as one stream in hash order, `epochs` times; all documents are scored.

Null or empty texts get the score of the bias alone. A doc_id with several labels counts as toxic if one of them does; null
labels are left out. Without labels every score is 0.5 and the prediction 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T

SPACE_BITS = 24
SAMPLE = 30_000
EPOCHS = 3
STEMS = (3, 4, 5, 6)  # bytes at the beginning of a longer word
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.01
_PAIR, _SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(64 - SPACE_BITS)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Row and coordinate of each feature occurrence of a slice; coordinate 0 is the bias."""
    data, offsets = T.utf8(batch.column("text"))
    starts, ends, firsts = T.word_spans(data, offsets)
    lower = T.LOWER[data]
    h = T.span_hashes(lower, starts, ends, T.LETTER_KEYS)
    row = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
    rows, found = [np.arange(batch.num_rows), row], [np.zeros(batch.num_rows, np.uint64), h >> SHIFT]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        found.append(T.mix(h[:-gap][same] * salt + h[gap:][same]) >> SHIFT)
    for size in STEMS:
        long = ends - starts > size
        rows.append(row[long])
        found.append(T.mix(T.span_hashes(lower, starts[long], starts[long] + size) + np.uint64(size)) >> SHIFT)
    return np.concatenate(rows), np.concatenate(found).astype(np.int64)


class Ftrl:
    """Per-coordinate FTRL-proximal state for 0/1 features."""

    def __init__(self, size: int = 1 << SPACE_BITS):
        self.z, self.n = np.zeros(size, np.float32), np.zeros(size, np.float32)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    model = Ftrl()
    for batch in T.slices(batches):
        rows, found = features(batch)
        order = np.argsort(rows, kind="stable")
        cuts = np.searchsorted(rows[order], np.arange(batch.num_rows + 1))
        for k, label in enumerate(batch.column("label").to_pylist()):
            model.learn(np.unique(found[order[cuts[k] : cuts[k + 1]]]), label)
    at = np.flatnonzero(np.abs(model.z) > L1)
    yield pa.RecordBatch.from_arrays([at, model.weights(at).astype(np.float64)], ["at", "weight"])


def toxicity_weights(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """at, weight: the coordinates with a weight other than zero; labels: doc_id, label (0 or 1)."""
    one = labels.where("label IS NOT NULL").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    one = T.stored(one, "labels")
    dealt = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    one = one.where(dealt < int((1 << 30) * min(1.0, sample / max(1, one.count()))))
    chosen = docs.select("doc_id", "text").join(F.broadcast(one), "doc_id")  # about `sample` rows of 12 bytes
    again = chosen.select("text", "label", dealt.alias("dealt"), F.explode(F.array(*(F.lit(k) for k in range(epochs)))).alias("epoch"))
    return again.repartition(1).sortWithinPartitions("epoch", "dealt", "text").select("text", "label").mapInArrow(_fit, "at long, weight double")


def toxicity_scores(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, sample: int = SAMPLE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, held_out, score, predicted; labels of rows held out are never read. labels: doc_id, label."""
    spark = docs.sparkSession
    held_out = T.remainder(F.col("doc_id"), 5) == 0 if held_out is None else held_out
    seen = labels.where(~F.coalesce(held_out, F.lit(False)))
    rows = toxicity_weights(docs, seen, sample, epochs).toPandas()
    sent = spark.sparkContext.broadcast((rows["at"].to_numpy(np.int64), rows["weight"].to_numpy(np.float32)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << SPACE_BITS, np.float32)
        table[sent.value[0]] = sent.value[1]
        for batch in T.slices(batches):
            row, at = features(batch)
            hit = table[at] != 0
            once = np.unique(row[hit] << SPACE_BITS | at[hit])
            total = np.bincount(once >> SPACE_BITS, table[once & (1 << SPACE_BITS) - 1], batch.num_rows)
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), p, (p >= 0.5).astype(np.int32)], ["doc_id", "held_out", "score", "predicted"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return own.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
