"""Quality by perplexity under interpolated modified Kneser-Ney models of trusted text: words in context, unknown words by spelling.

Word n-grams (pairs unless told otherwise) of the trusted texts are counted by Spark. Continuation counts, discounts, totals of contexts
and the interpolation with the next lower order are joins and groupings of count tables that stay sharded, whatever their size. A document's
distinct n-grams, but for those that 64 marks at each word show to be unseen, meet these tables shard by shard, and the gains of those that were seen add up to its probability:

    log2 P(text) = sum of log2 gamma(context) + log2 P(word) over its words + sum of log2 P(word | context) / (gamma(context) P(word)) over n-grams seen

Two bounded parts are broadcast: the single words (the `VOCABULARY` most frequent ones, with their probabilities) and the `FREQUENT` most
frequent n-grams, so that no key is hot where they meet. Shards are ranges of pairs of near equal weight. N-grams go to them packed, many in a row:
in order, as differences, some three bytes each. Words outside the vocabulary are the symbol UNKNOWN times their probability as spelled.

Spelling is a second model, of order 4 over 48 symbols: lower-case letters, classes of other bytes of the UTF-8 text, a mark in place
of a word that equals the word before it and of the blanks between, and the end of a text. There are at most 48 ** 4 of its n-grams.
Perplexity is by symbol of this spelling.

Both models learn from four fifths of the trusted texts. A document is kept if its perplexity is at most its language's threshold: the
`quantile` of the perplexities of the other fifth's texts in that language, times `margin`. Both are taken as if `prior` symbols of the language's median
perplexity stood before the text, so that a text of a few words is not judged by chance. Languages with fewer than `least` such texts, and null languages,
use the threshold over all of them. Without such text everything with words is kept.

Null texts, and texts without a word, are never kept. Decisions are by row; a filtering stage drops a doc_id if
any of its rows is rejected, and keeps rows without doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphotab.llm import text as T

ORDER, SIZE = 4, 48
END, AGAIN = 0, 1
LEAST_DISCOUNT = 0.1
BITS = 20  # of a word's number in an n-gram's code
PAIR = (1 << 2 * BITS) - 1
VOCABULARY = (1 << BITS) - 2
EDGE, UNKNOWN = 0, 1  # numbers of the beginning and end of a text, and of words outside the vocabulary
FREQUENT = 1 << 18
BLOCK = 1 << 18  # n-grams of documents that are sent to the shards together
MARKS = 1 << 25  # bits that tell trusted ids from others
SHARD_BYTES = 1 << 25  # text whose n-grams are looked up in one shard
SLICE_BYTES = 1 << 18  # text spelled in one step, at some 100 bytes of memory a byte


def _byte_symbols() -> np.ndarray:
    out = np.full(256, 9)
    out[T.SPACE] = 2
    for symbol, chars in ((3, "\n"), (4, "."), (5, ","), (6, "!"), (7, "|"), (8, "#$%&*@^~<>{}[]\\=+_`"), (10, "0123456789"), (11, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")):
        out[[ord(c) for c in chars]] = symbol
    out[ord("a") : ord("z") + 1] = np.arange(12, 38)
    out[0x80:0xC0] = 40 + (np.arange(64) >> 3)
    out[0xC0:] = 39
    out[0xC3] = 38
    return out


SYMBOLS = _byte_symbols()


def grams(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all 4-grams of the spelling of a slice, one for each symbol of a text with its end, where texts begin, and
    to which token each symbol belongs: a word with the blanks before it, or the end of a text with the blanks before that.
    """
    data, offsets = T.utf8(batch.column("text"))
    symbols = SYMBOLS[data]
    starts, ends, firsts = T.word_spans(data, offsets)
    h = T.span_hashes(data, starts, ends, T.LETTER_KEYS)
    row = np.repeat(np.arange(batch.num_rows), np.diff(firsts))
    again = np.flatnonzero((h[1:] == h[:-1]) & (row[1:] == row[:-1])) + 1
    # of a repeated word and the blanks before it only a mark is left
    step = np.zeros(len(data) + 1, np.int8)
    step[ends[again - 1]] += 1
    step[ends[again]] -= 1
    keep = np.cumsum(step[:-1]) == 0
    keep[ends[again - 1]] = True
    symbols[ends[again - 1]] = AGAIN
    symbols = symbols[keep]
    token = np.cumsum(np.bincount(ends, minlength=len(data) + 1))[:-1][keep]
    offsets = np.concatenate(([0], np.cumsum(T.row_sums(keep.astype(np.int64), offsets))))
    # each text stands between three ends before and one behind it
    sizes = np.diff(offsets)
    padded = np.zeros(len(symbols) + ORDER * batch.num_rows, np.int64)
    places = np.arange(len(symbols)) + np.repeat(ORDER * np.arange(batch.num_rows) + ORDER - 1, sizes)
    padded[places] = symbols
    tokens = np.zeros(len(padded), np.int64)
    tokens[places] = token + np.repeat(np.arange(batch.num_rows), sizes)
    tokens[offsets[1:] + ORDER * np.arange(1, batch.num_rows + 1) - 1] = firsts[1:] + np.arange(batch.num_rows)
    codes = padded.copy()
    for back in range(1, ORDER):
        codes[back:] += padded[:-back] * SIZE**back
    real = np.ones(len(padded), bool)
    real[(offsets[:-1] + ORDER * np.arange(batch.num_rows))[:, None] + np.arange(ORDER - 1)] = False
    return codes[real], offsets + np.arange(batch.num_rows + 1), tokens[real]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(SIZE**ORDER, np.int64)
    for batch in T.slices(batches, size=SLICE_BYTES):
        np.add.at(seen, grams(batch)[0], 1)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([at, seen[at]], ["gram", "c"])


def _discounts(n: list[int]) -> list[float]:
    """Modified Kneser-Ney discounts of counts 1, 2 and 3 or more, from how often counts 1 to 4 occur; LEAST_DISCOUNT at least, so that nothing has probability 0."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(k, max(LEAST_DISCOUNT, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else LEAST_DISCOUNT for k in (1, 2, 3)]


def _counted(counts: DataFrame, n: Column | int = 1) -> list[int]:
    """How often counts 1 to 4 occur; n: for how many a row stands."""
    found = counts.agg(*(F.sum(F.when(F.col("c") == k, n)) for k in (1, 2, 3, 4))).first()
    return [x or 0 for x in found]


def _taken(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def kneser_ney(texts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: (gram, p) of the n-grams seen, and (context, gamma), the weight of the next lower order."""
    counts = [T.stored(texts.select("text").mapInArrow(_count, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "grams")]
    for order in range(ORDER - 1, 0, -1):  # in how many ways an n-gram continues the word before it
        counts.insert(0, T.stored(counts[0].groupBy((F.col("gram") % SIZE**order).alias("gram")).agg(F.count("*").alias("c")), "grams"))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, own in enumerate(counts, 1):
        d = _discounts(_counted(own))
        keyed = own.select("gram", "c", F.floor(F.col("gram") / SIZE).alias("context"), _taken(d).alias("less"))
        context = T.stored(keyed.groupBy("context").agg(F.sum("c").alias("total"), F.sum("less").alias("left")), "contexts")
        alpha = keyed.join(context, "context").withColumn("alpha", (F.col("c") - F.col("less")) / F.col("total")).withColumn("gamma", F.col("left") / F.col("total"))
        if out:
            lower = out[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("lower"))
            alpha = alpha.withColumn("suffix", F.col("gram") % SIZE ** (order - 1)).join(lower, "suffix")
        else:
            alpha = alpha.withColumn("lower", F.lit(1 / SIZE))
        seen = T.stored(alpha.select("gram", (F.col("alpha") + F.col("gamma") * F.col("lower")).alias("p")), "probabilities")
        out.append((seen, context.select("context", (F.col("left") / F.col("total")).alias("gamma"))))
    return out


def log2_table(model: list[tuple[DataFrame, DataFrame]]) -> np.ndarray:
    """log2 P(symbol | three symbols before) of all n-grams; unseen ones get the lower order's share."""
    p = np.full(1, 1 / SIZE)
    for order, (seen, context) in enumerate(model, 1):
        c, s = context.toPandas(), seen.toPandas()
        gamma = np.ones(SIZE ** (order - 1))
        gamma[c["context"].to_numpy(np.int64)] = c["gamma"].to_numpy(float)
        lower = np.resize(p, SIZE**order) if order > 1 else np.full(SIZE, p[0])
        p = lower * np.repeat(gamma, SIZE)
        p[s["gram"].to_numpy(np.int64)] = s["p"].to_numpy(float)
    return np.log2(p).astype(np.float32)


def _word_keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = T.utf8(batch.column("text"))
    starts, ends, firsts = T.word_spans(data, offsets)
    return T.span_hashes(data, starts, ends), firsts


def _tallies(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """How often the keys of the slices occur; a key may come several times."""
    tally = T.Tally()

    def taken() -> tuple[np.ndarray, np.ndarray]:
        keys, counts = tally.take()
        return keys.view(np.int64), counts

    for batch in batches:
        tally.add(keys_of(batch).view(np.uint64))
        if tally.full():
            yield taken()
    yield taken()


def _tallied(batches: Iterator[pa.RecordBatch], keys_of: Callable[[pa.RecordBatch], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """gram, c: how often the keys of the slices occur; a key may come in several rows."""
    return (pa.RecordBatch.from_arrays([*x], ["gram", "c"]) for x in _tallies(T.slices(batches), keys_of))


def least_count(counts: DataFrame, most: int, n: Column | int = 1) -> int:
    """The least count `c` that may be asked for if at most `most` rows shall be left; n: for how many a row stands."""
    level = F.floor(F.log2("c") * 8).alias("level")
    left, least = most, 1 << 62
    for r in sorted(counts.groupBy(level).agg(F.sum(F.lit(n) if isinstance(n, int) else n).alias("n"), F.min("c").alias("c")).collect(), key=lambda r: -r.level):
        left -= r.n
        if left < 0:
            break
        least = r.c
    return least


def vocabulary(texts: DataFrame, most: int = VOCABULARY) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of the most frequent words, `most` at most, and how often the word of each number occurs; the word at place k has number k + 2."""

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        found, firsts = _word_keys(batch)
        return np.insert(found, firsts[1:], 0)  # an end of each text

    counts = T.stored(texts.select("text").mapInArrow(lambda batches: _tallied(batches, keys), "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "words")
    words = counts.where("gram <> 0")
    ends, total = counts.agg(F.sum(F.when(F.col("gram") == 0, F.col("c"))), F.sum("c")).first()
    found = words.where(F.col("c") >= least_count(words, most)).toArrow()
    found_keys, c = found["gram"].to_numpy().view(np.uint64), found["c"].to_numpy()
    by = np.argsort(found_keys)
    return found_keys[by], np.concatenate(([ends or 0, (total or 0) - (ends or 0) - c.sum()], c[by]))


def numbers(batch: pa.RecordBatch, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of a slice, each text closed by EDGE, and where the texts begin."""
    keys, firsts = _word_keys(batch)
    at = np.searchsorted(words, keys)
    known = words[np.minimum(at, len(words) - 1)] == keys if len(words) else np.zeros(len(keys), bool)
    return np.insert(np.where(known, at + 2, UNKNOWN), firsts[1:], EDGE), firsts + np.arange(len(firsts))


def word_codes(number: np.ndarray, firsts: np.ndarray, order: int) -> np.ndarray:
    """Code of the n-gram that ends at each word; before a text stand EDGEs."""
    place = np.arange(len(number)) - np.repeat(firsts[:-1], np.diff(firsts))
    codes = number.copy()
    for back in range(1, order):
        codes[back:] |= np.where(place[back:] >= back, number[:-back], EDGE) << (BITS * back)
    return codes


def _packed(x: np.ndarray) -> bytes:
    """64-bit numbers as bytes: all first bytes, all second ones and so on, compressed; small numbers take little room."""
    return pa.compress(np.ascontiguousarray(x.astype(np.int64, copy=False).view(np.uint8).reshape(-1, 8).T), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view(np.int64).ravel()


#: n-grams of one shard in order, as differences, and a number for each
PACKED = "shard int, n int, gram binary, c binary"


def _bounds(weights: np.ndarray, shards: int) -> np.ndarray:
    """Codes of pairs that cut all pairs into ranges of near equal weight, if the words of a pair have these weights and nothing to do with each other."""
    up = np.concatenate(([0], np.cumsum(weights))) / max(1, weights.sum())
    at = np.arange(1, shards) / shards
    first = np.clip(np.searchsorted(up, at, "right") - 1, 0, len(weights) - 1)
    within = (at - up[first]) / np.maximum(up[first + 1] - up[first], 1e-300)
    second = np.clip(np.searchsorted(up, within, "right") - 1, 0, len(weights) - 1)
    return np.sort(first << BITS | second)


def _cut(grams: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of their n-grams, in order; the last two words decide."""
    shard = np.searchsorted(bounds, grams & PAIR, "right")
    by = np.lexsort((grams, shard))
    cuts = np.searchsorted(shard[by], np.arange(len(bounds) + 2))
    return ((k, by[cuts[k] : cuts[k + 1]]) for k in np.flatnonzero(np.diff(cuts)).tolist())


def _rows(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> dict[str, pa.Array]:
    """Columns of PACKED from shards, their n-grams in order, and numbers."""
    return {
        "shard": pa.array([k for k, _, _ in rows], pa.int32()),
        "n": pa.array([len(g) for _, g, _ in rows], pa.int32()),
        "gram": pa.array([_packed(np.diff(g, prepend=0)) for _, g, _ in rows], pa.binary()),
        "c": pa.array([_packed(c) for _, _, c in rows], pa.binary()),
    }


def _opened(table: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for n, gram, c in zip(*(table.column(x).to_pylist() for x in ("n", "gram", "c")), strict=True):
        yield np.cumsum(_unpacked(gram, n)), _unpacked(c, n)


def _merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all rows of one shard, each once, with the sum of its numbers."""
    parts = [*_opened(table), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    gram, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(gram, kind="stable")
    gram, c = gram[by], c[by]
    first = np.flatnonzero(np.diff(gram, prepend=-1))
    return gram[first], np.add.reduceat(c, first) if len(first) else c


def _dealt(df: DataFrame, counts: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, np.ndarray]]], bounds: np.ndarray) -> DataFrame:
    """PACKED, dealt out by shard later, of the n-grams and numbers that `counts` makes of the rows."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for gram, c in counts(batches):
            yield pa.RecordBatch.from_pydict(_rows([(k, gram[at], c[at]) for k, at in _cut(gram, bounds)]))

    return df.mapInArrow(deal, PACKED)


def _sharded(dealt: DataFrame) -> DataFrame:
    """PACKED with one row for each shard."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return pa.Table.from_pydict(_rows([(key[0].as_py(), *_merged(table))]))

    return dealt.groupBy("shard").applyInArrow(merge, PACKED)


def _plain(df: DataFrame, least: int = 1) -> DataFrame:
    """gram, c of packed n-grams with this count at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for gram, c in _opened(batch):
                yield pa.RecordBatch.from_arrays([gram[c >= least], c[c >= least]], ["gram", "c"])

    return df.mapInArrow(run, "gram long, c long")


def _by_first(df: DataFrame, size: int, *names: str) -> list[np.ndarray]:
    """These of total, n1, n2, n3 and mask by number of the packed pairs' first words: the sum of the counts, how many pairs
    have count 1, 2 and more, marks of the second words.
    """

    def sums(table: pa.Table) -> pa.Table:
        gram, c = _merged(table)
        word = gram >> BITS
        first = np.flatnonzero(np.diff(word, prepend=-1))
        out = {x: np.add.reduceat(own.astype(np.int64), first) for x, own in (("total", c), ("n1", c == 1), ("n2", c == 2), ("n3", c > 2))}
        out |= {"mask": np.bitwise_or.reduceat(np.uint64(1) << (gram & 63).astype(np.uint64), first).view(np.int64)}
        return pa.table({"word": word[first].astype(np.int32)} | {x: out[x].astype(kinds[x]) for x in names})

    kinds = {"total": np.int64, "n1": np.int32, "n2": np.int32, "n3": np.int32, "mask": np.int64}
    # one Python function a stage: each further one takes as many more processes as an executor has cores
    found = df.groupBy("shard").applyInArrow(sums, ", ".join(["word int", *(f"{x} {'long' if kinds[x] is np.int64 else 'int'}" for x in names)])).toArrow()
    # a word whose pairs are in several shards has several rows
    word, out = found["word"].to_numpy(), [np.zeros(size, np.uint64 if x == "mask" else np.int64) for x in names]
    for x, own in zip(names, out, strict=True):
        (np.bitwise_or if x == "mask" else np.add).at(own, word, found[x].to_numpy().astype(own.dtype))
    return out


def _reversed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for gram, _ in _opened(batch):
            yield gram >> BITS | (gram & (1 << BITS) - 1) << BITS, np.ones(len(gram), np.int64)


def _with_contexts(rows: DataFrame) -> DataFrame:
    """context, gram, c, and for its context: total of the counts, how many n-grams have count 1, 2 and more."""
    of = Window.partitionBy("context")
    # dealt out by context once, for the counts and for the totals
    summed = rows.withColumn("context", F.shiftright("gram", BITS)).repartition("context").groupBy("context", "gram").agg(F.sum("c").alias("c"))
    n = [F.sum(test.cast("long")).over(of).alias(f"n{k}") for k, test in ((1, F.col("c") == 1), (2, F.col("c") == 2), (3, F.col("c") > 2))]
    return T.stored(summed.select("context", "gram", "c", F.sum("c").over(of).alias("total"), *n), "contexts")


def _less(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.select([c == 0, c == 1, c == 2], [0.0, *d[:2]], d[2])


def _mask(number: Column) -> Column:
    """64 marks, one for all numbers with the same remainder."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), number.bitwiseAND(63).cast("int"))).alias("mask")


def _gains(gram: np.ndarray, c: np.ndarray, d: list[float], left: np.ndarray, single: np.ndarray) -> np.ndarray:
    """log2 by which pairs with counts c are likelier than their second word alone, times the weight of the first."""
    first, second = gram >> BITS, gram & (1 << BITS) - 1
    return np.log2(1 + (c - _less(c, d)) / (left[first] * np.exp2(single[second].astype(np.float64))))


class WordModel:
    """A Kneser-Ney model of word n-grams: sharded tables of n-grams seen, and what is broadcast."""

    def __init__(self, texts: DataFrame, order: int = 2, most_words: int = VOCABULARY, most_grams: int = FREQUENT, shards: int = 16):
        if not 2 <= order <= 3:
            raise ValueError("n-grams of two or three words have a code")
        self.order = order
        words, weights = vocabulary(texts, most_words)
        spark = texts.sparkSession
        sent = spark.sparkContext.broadcast(words)
        self.bounds = bounds = _bounds(weights, shards)
        rows = texts.select("text")
        if order == 3:
            triples = _with_contexts(rows.mapInArrow(lambda batches: _tallied(batches, lambda batch: word_codes(*numbers(batch, sent.value), 3)), "gram long, c long"))
            # in how many ways a pair continues the word before it
            rows = triples.select(F.col("gram").bitwiseAND(PAIR).alias("gram"))
            keys: Callable[[pa.RecordBatch], np.ndarray] = lambda batch: batch.column("gram").to_numpy()
        else:
            keys = lambda batch: word_codes(*numbers(batch, sent.value), 2)
        pairs = T.stored(_sharded(_dealt(rows, lambda batches: _tallies(batches if order == 3 else T.slices(batches), keys), bounds)), "pairs")

        # single words by the words before them; what they leave goes half to UNKNOWN
        size = len(words) + 2
        c, before = _by_first(_dealt(pairs, _reversed, bounds), size, "total", "mask")
        d, total = _discounts([int((c == k).sum()) for k in (1, 2, 3, 4)]), max(1.0, c.sum())
        less = _less(c, d)
        p = np.full(size, 0.5 / size)
        p[UNKNOWN] += 0.5
        p *= less.sum() / total if c.any() else 1.0
        p += (c - less) / total
        single = np.log2(p).astype(np.float32)

        by_count = T.stored(_plain(pairs).groupBy("c").agg(F.count("*").alias("n")), "counts")
        d = _discounts(_counted(by_count, F.col("n")))
        totals, *n, behind = _by_first(pairs, size, "total", "n1", "n2", "n3", "mask")
        left = sum(x * k for x, k in zip(n, d, strict=True))
        gamma = np.where(totals > 0, left / np.maximum(totals, 1), 1.0)

        #: gram, c, value: log2 by which an n-gram seen is likelier than its next lower order gives, or the weight of that order
        values: DataFrame | None = None
        if order == 3:
            shared = spark.sparkContext.broadcast((left, totals, p, d))

            def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                left, totals, p, d = shared.value
                for batch in batches:
                    for gram, c in _opened(batch):
                        first = gram >> BITS
                        yield pa.RecordBatch.from_arrays([gram, (c - _less(c, d) + left[first] * p[gram & (1 << BITS) - 1]) / totals[first]], ["suffix", "lower"])

            own = _discounts(_counted(triples))
            taken, rest = _taken(own), own[0] * F.col("n1") + own[1] * F.col("n2") + own[2] * F.col("n3")
            weights3 = triples.groupBy("context").agg(F.max("total").alias("c"), F.max(rest / F.col("total")).alias("gamma"))
            joined = triples.withColumn("suffix", F.col("gram").bitwiseAND(PAIR)).join(pairs.mapInArrow(lower, "suffix long, lower double"), "suffix")
            parts = [
                weights3.select(F.col("context").bitwiseOR(F.lit(1 << 60).cast("long")).alias("gram"), "c", F.log2("gamma").alias("value")),
                joined.select(F.col("gram").bitwiseOR(F.lit(2 << 60).cast("long")).alias("gram"), "c", F.log2(1 + (F.col("c") - taken) / (rest * F.col("lower"))).alias("value")),
            ]
            values = T.stored(parts[0].unionAll(parts[1]), "values")
            by_count = by_count.unionAll(triples.groupBy("c").agg(F.count("*").alias("n")))
        least = least_count(by_count, most_grams, F.col("n"))
        top = _plain(pairs, least).toArrow()
        gram, gains = top["gram"].to_numpy(), _gains(top["gram"].to_numpy(), top["c"].to_numpy(), d, left, single)
        #: the n-grams seen by shard, with the counts of pairs and the bits of other values
        self.seen = pairs
        if values is not None:
            more = values.where(F.col("c") >= least).toArrow()
            gram, gains = np.concatenate((gram, more["gram"].to_numpy())), np.concatenate((gains, more["value"].to_numpy()))

            def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
                return ((batch.column("gram").to_numpy(), batch.column("value").to_numpy().view(np.int64)) for batch in batches)

            self.seen = pairs.unionAll(T.stored(_sharded(_dealt(values.select("gram", "value"), bits, bounds)), "values"))
        by = np.argsort(gram)
        self.discounts = d
        #: keys of words; by number: log2 of P(word) and of gamma(word), what is left for single words behind it, marks of the words seen before and behind; frequent n-grams in order, their values
        self.shared = words, single, np.log2(gamma).astype(np.float32), left.astype(np.float32), np.stack((before, behind)), gram[by], gains[by]


def _asked(number: np.ndarray, firsts: np.ndarray, order: int, masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of a slice, in a row, the tagged codes of all that is looked up for it, and which of them may have been seen.

    A pair was not seen, nor anything that ends with it, unless each of its words is marked at the other. Nothing seen is left out.
    """
    out = [word_codes(number, firsts, 2)]
    before = out[0] >> BITS
    marks = masks[0][number] >> (before & 63).astype(np.uint64) & masks[1][before] >> (number & 63).astype(np.uint64)
    maybe = [(marks & np.uint64(1)).astype(bool)]
    for k in range(3, order + 1):
        codes = word_codes(number, firsts, k)
        out += [codes | (2 * (k - 2)) << 60, codes >> BITS | (2 * (k - 2) - 1) << 60]
        maybe += [maybe[0], np.ones(len(codes), bool)]
    return np.stack(out, 1), np.stack(maybe, 1)


def perplexities(docs: DataFrame, table: np.ndarray, model: WordModel, most: int = BLOCK) -> DataFrame:
    """doc_id, lang, n_words, n_symbols, log2_prob, perplexity; table: log2 probabilities of spelling, most: n-grams a task sends to the shards together."""
    order, bounds, discounts = model.order, model.bounds, model.discounts
    sent = docs.sparkSession.sparkContext.broadcast((table, *model.shared))
    kinds = {"doc_id": pa.int64(), "lang": pa.string(), "n_words": pa.int64(), "n_symbols": pa.int64(), "base": pa.float64()}
    own = "doc_id long, lang string, n_words long, n_symbols long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, words, single, gamma, _, masks, frequent, values = sent.value
        at, rows = TaskContext.get().partitionId() << 33, 0  # the first row of a block, and how many it has
        block: list[tuple[np.ndarray, ...]] = []

        def asked_of_block() -> pa.RecordBatch:
            row, gram, times = (np.concatenate(x) for x in zip(*block, strict=True))
            cuts = [(k, at) for k, at in _cut(gram, bounds)]
            out = _rows([(k, gram[by], times[by]) for k, by in cuts])
            out |= {"row": pa.array([_packed(row[by]) for _, by in cuts], pa.binary()), "at": pa.array([at] * len(cuts), pa.int64())}
            return pa.RecordBatch.from_pydict(out | {x: pa.nulls(len(cuts), kind) for x, kind in kinds.items()})

        for batch in T.slices(batches, size=SLICE_BYTES):
            codes, symbols, token = grams(batch)
            number, firsts = numbers(batch, words)
            spelled = np.bincount(token, table[codes], len(number))
            before = word_codes(number, firsts, 2) >> BITS
            log2 = single[number] + gamma[before] + np.where(number == UNKNOWN, spelled, 0.0)
            asked, maybe = _asked(number, firsts, order, masks)
            row = np.repeat(np.arange(batch.num_rows), np.diff(firsts) * asked.shape[1])[maybe.ravel()]
            asked = asked[maybe]
            found = np.minimum(np.searchsorted(frequent, asked), max(0, len(frequent) - 1))
            hit = frequent[found] == asked if len(frequent) else np.zeros(len(asked), bool)
            gain = np.bincount(row[hit], values[found[hit]] if len(frequent) else None, batch.num_rows)
            # the other n-grams of a text, each once with its number
            row, asked = row[~hit], asked[~hit]
            by = np.lexsort((asked, row))
            row, asked = row[by], asked[by]
            new = np.flatnonzero(np.concatenate((np.ones(min(1, len(row)), bool), (asked[1:] != asked[:-1]) | (row[1:] != row[:-1]))))
            block.append((row[new] + rows, asked[new], np.diff(np.append(new, len(row)))))
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array(np.arange(n) % (len(bounds) + 1), pa.int32()),
                    "n": pa.array(np.arange(rows, rows + n), pa.int32()),
                    **{x: pa.nulls(n, pa.binary()) for x in ("gram", "c", "row")},
                    "at": pa.array(np.full(n, at)),
                    "doc_id": batch.column("doc_id"),
                    "lang": batch.column("lang"),
                    "n_words": np.diff(firsts) - 1,
                    "n_symbols": np.diff(symbols),
                    "base": T.row_sums(log2.astype(np.float64), firsts) + gain,
                }
            )
            rows += n
            if sum(len(x[0]) for x in block) >= most or rows >= BLOCK:
                yield asked_of_block()
                at, rows, block = at + rows, 0, []
        if block:
            yield asked_of_block()

    def looked_up(asked: pa.Table, seen: pa.Table) -> pa.Table:
        """What the n-grams of a shard add to the rows of each block; documents pass through."""
        _, _, single, _, left, _, _, _ = sent.value
        keys, c = _merged(seen)
        pairs = int(np.searchsorted(keys, PAIR, "right"))
        values = np.concatenate((_gains(keys[:pairs], c[:pairs], discounts, left, single), c[pairs:].view(np.float64)))
        docs = asked.filter(pc.is_valid(asked["base"])).select(["at", "n", "row", *kinds])
        asked = asked.filter(pc.is_null(asked["base"]))
        out = []
        for (gram, times), row, n, at in zip(_opened(asked), asked["row"].to_pylist(), asked["n"].to_pylist(), asked["at"].to_pylist(), strict=True):
            found = np.minimum(np.searchsorted(keys, gram), max(0, len(keys) - 1))
            hit = keys[found] == gram if len(keys) else np.zeros(n, bool)
            row, back = np.unique(_unpacked(row, n)[hit], return_inverse=True)
            gain = np.bincount(back, times[hit] * values[found[hit]], len(row)).astype(np.float32)
            out.append((at, len(row), _packed(np.diff(row, prepend=0)) + gain.tobytes()))
        gains = {x: pa.array([r[k] for r in out], docs.schema.field(x).type) for k, x in enumerate(("at", "n", "row"))}
        return pa.concat_tables([docs, pa.Table.from_pydict(gains | {x: pa.nulls(len(out), kind) for x, kind in kinds.items()})])

    def added(table: pa.Table) -> pa.Table:
        """The documents of one block with all their gains."""
        docs, gains = table.filter(pc.is_valid(table["base"])), table.filter(pc.is_null(table["base"]))
        place = docs["n"].to_numpy()
        sums = np.zeros(place.max(initial=-1) + 1)
        for n, data in zip(gains["n"].to_pylist(), gains["row"].to_pylist(), strict=True):
            cut = len(data) - 4 * n
            sums[np.cumsum(_unpacked(data[:cut], n))] += np.frombuffer(data[cut:], np.float32)
        return docs.select([x for x in kinds if x != "base"]).append_column("log2_prob", pa.array(docs["base"].to_numpy() + sums[place]))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    asked = texts.mapInArrow(run, f"{PACKED}, row binary, at long, {own}, base double")
    gains = asked.groupBy("shard").cogroup(model.seen.groupBy("shard")).applyInArrow(looked_up, f"at long, n int, row binary, {own}, base double")
    scored = gains.groupBy("at").applyInArrow(added, f"{own}, log2_prob double")
    return scored.withColumn("perplexity", F.pow(F.lit(2.0), -F.col("log2_prob") / F.col("n_symbols")))


def learned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose doc_id is among `ids` (one column doc_id, each once): a left semi join that moves no texts.

    Two marks for each id, `MARKS` bits at most, tell which rows can be meant; only the ids of these are joined with `ids`.
    The few that are not among them are taken out of the rows, by a join whose way their number decides.
    """
    bits = min(MARKS.bit_length() - 1, max(16, 5 + ids.count().bit_length()))
    h = F.xxhash64(F.col("doc_id").cast("string"))
    places = [F.shiftright(h, by).bitwiseAND((1 << bits) - 1) for by in (0, 32)]
    marks = T.stored(ids.select(F.explode(F.array(*places)).alias("place")).groupBy(F.shiftright("place", 6).alias("word")).agg(_mask(F.col("place"))), "marks")
    maybe = docs.where("doc_id IS NOT NULL").select("*", *(p.alias(f"place{k}") for k, p in enumerate(places)))
    for k in range(2):
        place = F.col(f"place{k}")
        bit = F.call_function("shiftrightunsigned", F.col("mask"), place.bitwiseAND(63).cast("int")).bitwiseAND(1)
        maybe = maybe.join(F.broadcast(marks), F.shiftright(place, 6) == F.col("word")).where(bit == 1).drop("word", "mask")
    maybe = maybe.select(*docs.columns)
    wrong = T.stored(maybe.select("doc_id").distinct().join(ids, "doc_id", "left_anti"), "not-learned")
    return maybe.join(wrong, "doc_id", "left_anti")


def quality(docs: DataFrame, trusted: DataFrame, quantile: float = 0.995, margin: float = 1.03, least: int = 50, prior: int = 32, order: int = 2) -> DataFrame:
    """doc_id, lang, n_words, n_symbols, log2_prob, perplexity, threshold, kept; trusted: the doc_ids of trusted texts, order: of word n-grams."""
    trusted = T.stored(trusted.select("doc_id").where("doc_id IS NOT NULL").distinct(), "trusted")
    other = T.remainder(F.col("doc_id"), 5) == 0
    texts = T.stored(learned(docs.where(~other).select("doc_id", "text"), trusted.where(~other)).select("text"), "texts")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    model = WordModel(texts, order, shards=max(16, size // SHARD_BYTES))
    scored = T.stored(perplexities(docs, log2_table(kneser_ney(texts)), model), "perplexities")
    sure = T.stored(scored.where("n_words > 0").join(trusted.where(other), "doc_id", "left_semi"), "sure")

    def at(q: float, x: Column) -> Column:
        return F.percentile_approx(x, q, 10_000)

    middles = T.stored(sure.groupBy("lang").agg(at(0.5, F.col("perplexity")).alias("middle"), F.count("*").alias("n")).where(F.col("n") >= least).select(F.col("lang").alias("of"), "middle"), "middles")
    all_middle = sure.agg(at(0.5, F.col("perplexity")).alias("m")).first()["m"]

    def judged(rows: DataFrame) -> DataFrame:
        m = F.coalesce(F.col("middle"), F.lit(all_middle).cast("double"), F.col("perplexity"))
        seen = F.pow(F.lit(2.0), (prior * F.log2(m) - F.col("log2_prob")) / (F.col("n_symbols") + prior))
        return rows.join(middles, F.col("lang") == F.col("of"), "left").drop("of").withColumn("seen", seen)

    sure = T.stored(judged(sure), "judged")
    cut = (at(quantile, F.col("seen")) * margin).alias("cut")
    cuts = T.stored(sure.where("middle IS NOT NULL").groupBy("lang").agg(cut).select(F.col("lang").alias("of"), "cut"), "cuts")
    every = sure.agg(cut).first()["cut"]
    threshold = F.coalesce(F.col("cut"), F.lit(every).cast("double"))
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("seen") <= threshold, F.lit(True))
    joined = judged(scored).join(cuts, F.col("lang") == F.col("of"), "left")
    return joined.select("doc_id", "lang", "n_words", "n_symbols", "log2_prob", "perplexity", threshold.alias("threshold"), kept.alias("kept"))


def good(docs: DataFrame, trusted: DataFrame, **how) -> DataFrame:
    """The rows of `docs` whose doc_id has no rejected row."""
    bad = T.stored(quality(docs, trusted, **how).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "rejected")
    return T.without(docs, bad)
