"""LM scoring: a log-bilinear model trained in numpy with noise-contrastive estimation.

Words are counted over the whole training part. The output layer has `OUTPUTS` symbols: the end of a text, the most frequent
words, and classes of the other words by their last letters. The model gives P(symbol | two symbols before); a word of a
class takes its share of the class, (c + 1) / (N_class + V_class + 1), so that known words and one unknown word a class sum
to 1. Symbol trigrams of the whole training part are counted by Spark; there are at most OUTPUTS ** 3 of them whatever the
input, so the fit itself is bounded. One batched matrix product then gives the normalised log-probabilities of all
contexts.

Token counts are looked up in a broadcast of at most `FREQUENT` words, chosen by count; all other words are joined with
the sharded count table. Words are keyed by 64-bit hashes.

Null or empty texts have one token, the end. Rows with equal doc_id are scored each for itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T

OUTPUTS = 160
SINGLES = 96  # of the outputs: the end of a text and the most frequent words
FREQUENT = 1 << 18
END = np.uint64(0)  # key of the end token
_SUFFIX = np.random.default_rng(7).integers(0, OUTPUTS - SINGLES, 1 << 16)
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def _words(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys and classes of all tokens of a slice, each text closed by an end token, and where the texts begin."""
    data, offsets = T.utf8(batch.column("text"))
    data = T.LOWER[data]
    starts, ends, firsts = T.word_spans(data, offsets)
    keys = np.maximum(T.span_hashes(data, starts, ends), np.uint64(1))
    last = ends - 1
    last = np.where(_PUNCTUATION[data[last]] & (last > starts), last - 1, last) if len(last) else last
    tail = data[np.maximum(last - 1, starts)].astype(np.int64) * 256 + data[last] if len(last) else last
    classes = SINGLES + _SUFFIX[tail]
    stops = firsts[1:]
    firsts = firsts + np.arange(len(firsts))
    return np.insert(keys, stops, END), np.insert(classes, stops, 0), firsts


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = T.Tally()

    def rows() -> pa.RecordBatch:
        keys, counts = tally.take()
        return pa.RecordBatch.from_arrays([keys.view(np.int64), counts], ["word", "c"])

    for batch in T.slices(batches):
        keys, classes, _ = _words(batch)
        # the class depends on the word alone; it rides in the low byte of the key
        tally.add((keys & ~np.uint64(0xFF)) | classes.astype(np.uint64))
        if tally.full():
            yield rows()
    yield rows()


def _symbols(keys: np.ndarray, classes: np.ndarray, singles: np.ndarray) -> np.ndarray:
    """Output symbols of tokens; singles: sorted keys of the single words, in pairs (key, symbol)."""
    out = classes.copy()
    if len(singles[0]):
        at = np.minimum(np.searchsorted(singles[0], keys), len(singles[0]) - 1)
        hit = singles[0][at] == keys
        out[hit] = singles[1][at[hit]]
    return out


def _contexts(symbols: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Code of the two symbols before each token; before a text stand ends."""
    one = np.concatenate(([0], symbols[:-1]))
    two = np.concatenate(([0, 0], symbols[:-2]))[: len(symbols)]
    begin = firsts[:-1]
    one[begin] = 0
    two[begin] = 0
    second = begin + 1
    two[second[second < firsts[1:]]] = 0
    return two * OUTPUTS + one


def _keyed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, classes, firsts = _words(batch)
    return (keys & ~np.uint64(0xFF)) | classes.astype(np.uint64), classes, firsts


def fit(codes: np.ndarray, counts: np.ndarray, dim: int = 24, noise: int = 64, steps: int = 1500, batch: int = 4096, seed: int = 1) -> dict[str, np.ndarray]:
    """Log-bilinear parameters from trigram codes and their counts, by noise-contrastive estimation with Adagrad."""
    rng = np.random.default_rng(seed)
    total = np.cumsum(counts.astype(np.float64))
    target = codes % OUTPUTS
    share = np.bincount(target, counts, OUTPUTS) + 1.0
    share /= share.sum()
    p = {
        "R": rng.normal(0, 0.1, (OUTPUTS, dim)),
        "C": np.stack([np.eye(dim), np.eye(dim)]) * 0.5,
        "Q": rng.normal(0, 0.1, (OUTPUTS, dim)),
        "b": np.log(share),
    }
    if not len(codes):
        return p
    grown = {k: np.full(v.shape, 1e-3) for k, v in p.items()}
    shift = np.log(noise * share)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(steps):
        picked = codes[np.searchsorted(total, rng.random(batch) * total[-1], "right")]
        two, one, t = picked // OUTPUTS**2, picked // OUTPUTS % OUTPUTS, picked % OUTPUTS
        n = rng.choice(OUTPUTS, noise, p=share)
        r2, r1 = p["R"][two], p["R"][one]
        r = r2 @ p["C"][0] + r1 @ p["C"][1]
        gt = sigmoid((r * p["Q"][t]).sum(1) + p["b"][t] - shift[t]) - 1
        gn = sigmoid(r @ p["Q"][n].T + p["b"][n] - shift[n])
        gr = gt[:, None] * p["Q"][t] + gn @ p["Q"][n]
        g = {k: np.zeros(v.shape) for k, v in p.items()}
        np.add.at(g["Q"], t, gt[:, None] * r)
        np.add.at(g["Q"], n, gn.T @ r)
        np.add.at(g["b"], t, gt)
        np.add.at(g["b"], n, gn.sum(0))
        np.add.at(g["R"], two, gr @ p["C"][0].T)
        np.add.at(g["R"], one, gr @ p["C"][1].T)
        g["C"][0], g["C"][1] = r2.T @ gr, r1.T @ gr
        rate = 0.15 * (1 - step / steps) + 0.005
        for k in p:
            d = g[k] / batch
            grown[k] += d * d
            p[k] -= rate * d / np.sqrt(grown[k])
    return p


def log10_table(p: dict[str, np.ndarray]) -> np.ndarray:
    """log10 P(symbol | two symbols before) for all contexts, normalised: one matrix product and a softmax."""
    left, right = p["R"] @ p["C"][0], p["R"] @ p["C"][1]
    r = (left[:, None, :] + right[None, :, :]).reshape(-1, left.shape[1])
    s = (r @ p["Q"].T + p["b"]).astype(np.float32)
    s -= s.max(1, keepdims=True)
    s -= np.log(np.exp(s).sum(1, keepdims=True))
    return s / np.float32(np.log(10))


def lm_scores(docs: DataFrame, held_out: Column | None = None, steps: int = 1500) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; the model learns from rows not held out."""
    spark = docs.sparkSession
    held_out = T.remainder(F.col("doc_id"), 7) == 2 if held_out is None else held_out
    docs = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out")).select("text")

    counts = T.stored(train.mapInArrow(_count, "word long, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    by_class = counts.groupBy((F.col("word").bitwiseAND(0xFF)).cast("int").alias("cls")).agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()
    n_all, v_all = sum(r.n for r in by_class), sum(r.v for r in by_class)

    # the lowest count class from which on at most FREQUENT words are left
    level = F.floor(F.log2("c") * 8).cast("int")
    left, least = FREQUENT, 1 << 62
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count("*").alias("v"), F.min("c").alias("c")).collect(), key=lambda r: -r.level):
        left -= r.v
        if left < 0:
            break
        least = r.c
    top = counts.where(F.col("c") >= least).toArrow()
    words, known = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.argsort(words)
    words, known = words[order], known[order]

    # single words: the end and the most frequent others
    ranked = np.lexsort((words, -known))
    chosen = words[ranked[words[ranked] != END]][: SINGLES - 1]
    single = np.concatenate(([END], np.sort(chosen)))
    singles = (single, np.arange(len(single)))

    def trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(OUTPUTS**3, np.int64)
        for batch in T.slices(batches):
            keys, classes, firsts = _keyed(batch)
            s = _symbols(keys, classes, singles)
            seen += np.bincount(_contexts(s, firsts) * OUTPUTS + s, minlength=OUTPUTS**3)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([at, seen[at]], ["code", "c"])

    seen = train.mapInArrow(trigrams, "code long, c long").groupBy("code").agg(F.sum("c").alias("c")).orderBy("code").toArrow()
    model = fit(seen["code"].to_numpy(), seen["c"].to_numpy(), steps=steps)

    # what a class has apart from the single words in it
    n_class, v_class = np.zeros(OUTPUTS), np.zeros(OUTPUTS)
    for r in by_class:
        n_class[r.cls] += r.n
        v_class[r.cls] += r.v
    if len(words):
        at = np.minimum(np.searchsorted(words, single), len(words) - 1)
        counted = words[at] == single
        np.subtract.at(n_class, (single[counted] & np.uint64(0xFF)).astype(np.int64), known[at[counted]])
        np.subtract.at(v_class, (single[counted] & np.uint64(0xFF)).astype(np.int64), 1)
    share = np.log10(n_class + v_class + 1)
    sent = spark.sparkContext.broadcast((words, np.log10(known + 1.0), singles, model, share))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, logs, singles, model, share = sent.value
        table = log10_table(model)
        for batch in T.slices(batches):
            keys, classes, firsts = _keyed(batch)
            s = _symbols(keys, classes, singles)
            model_score = table[_contexts(s, firsts), s].astype(np.float64)
            at = np.minimum(np.searchsorted(words, keys), max(0, len(words) - 1))
            hit = words[at] == keys if len(words) else np.zeros(len(keys), bool)
            log_c = np.where(hit, logs[at], 0.0) if len(words) else np.zeros(len(keys))
            model_score += np.where(s >= SINGLES, log_c - share[s], 0.0)
            # the other words of a row, each once with its number
            row = np.repeat(np.arange(batch.num_rows), np.diff(firsts))[~hit]
            rest = keys[~hit].view(np.int64)
            order = np.lexsort((rest, row))
            row, rest = row[order], rest[order]
            new = np.ones(len(rest), bool)
            new[1:] = (rest[1:] != rest[:-1]) | (row[1:] != row[:-1])
            at_new = np.flatnonzero(new)
            times = np.diff(np.append(at_new, len(rest)))
            lists = np.searchsorted(row[at_new], np.arange(batch.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    np.diff(firsts),
                    T.row_sums(hit.astype(np.int64), firsts),
                    T.row_sums(log_c, firsts),
                    T.row_sums(model_score, firsts),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(rest[at_new])),
                    pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(times.astype(np.int64))),
                ],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "words", "times"],
            )

    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, words array<long>, times array<long>"
    scored = T.stored(docs.mapInArrow(score, fields).withColumn("row", F.monotonically_increasing_id()), "scored")
    rest = (
        scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w"))
        .select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
        .join(counts.where(F.col("c") < least), "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("logs"))
    )
    more, logs = F.coalesce("more", F.lit(0)), F.coalesce("logs", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + more).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * F.log10(F.lit(float(n_all + v_all + 1)))).alias("base_score"),
        (F.col("score") + logs).alias("score"),
    )
