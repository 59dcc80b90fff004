"""Benchmark decontamination by spaced-seed hashing, with DataFrame functions only.

Texts are lower-cased and cut into words of letters and digits. A seed is a fixed mask over a window of words; positions that
it ignores may differ. Windows of all documents and of all benchmark items are hashed under every seed and joined on
the hash. Each hit names an alignment (document position minus item position), which is then verified word by word: an
item is found in a document if at least `share` of the item's words stand at their places, or if some stretch of
`stretch` words does so for at least 4 in 5.

Items of fewer words than the longest of the `seeds` but at least five use the six `LIGHT` seeds, three words within five. None of
their accepted alignments is missed: of each five words in a row at least three would have to differ, and then fewer than 3 in 5 of the
item's words stand at their places (for a `share` of 0.6 or more). Documents are hashed under the light seeds only if there are such items. Items of one
to four words are hashed whole, beside all windows of their lengths in the documents, so they are found anywhere, but only unchanged.

The benchmark side is broadcast if its measured number of hashes is at most BROADCAST_ROWS; otherwise the same join runs by
shuffle. Null or empty texts and items have no words and never match. Repeated rows count once for each doc_id and item_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T

SEEDS = ("110101011", "11100110001", "1101100001011")
LIGHT = ("111", "1101", "1011", "11001", "10101", "10011")
LIGHT_FROM = 5  # words; of fewer, no three can be spared
BROADCAST_ROWS = 4_000_000  # 20 bytes each
STRETCH = 20


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _windows(number: int, seed: str, fits: Column) -> Column:
    """Places and hashes of all windows under a seed, of the array `h0` of word hashes, if it `fits`."""
    care = [i for i, c in enumerate(seed) if c == "1"]
    hashed = F.transform(
        F.sequence(F.lit(0), F.size("h0") - len(seed)),
        lambda at: F.struct(at.alias("at"), F.xxhash64(F.lit(number), *(F.get(F.col("h0"), at + i) for i in care)).alias("h")),
    )
    return F.when(fits & (F.size("h0") >= len(seed)), hashed).otherwise(F.array().cast("array<struct<at:int,h:bigint>>"))


def _hashes(words: DataFrame, seeds: list[tuple[int, str, Column]], *keep: str) -> DataFrame:
    """One row for each window and seed: the columns to keep, `at` (first word) and `h`; seeds: number, mask, which rows use it."""
    each = F.concat(*(_windows(*seed) for seed in seeds))
    return words.select(*keep, F.explode(each).alias("w")).select(*keep, "w.at", "w.h")


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("h0", F.transform("words", lambda w: F.xxhash64(w)))


def contamination(docs: DataFrame, benchmark: DataFrame, seeds: tuple[str, ...] = SEEDS, share: float = 0.6, stretch: int = STRETCH) -> DataFrame:
    """doc_id, item_id, doc_start (word), item_words, same_words: the best alignment of each item found in a document."""
    items = benchmark.select("item_id", _words(F.col("text")).alias("words")).distinct()
    n, many = F.size("words"), max(map(len, seeds))
    items = items.withColumn("short", F.when(n < LIGHT_FROM, n))
    heavy = list(enumerate(seeds))
    light = [(len(seeds) + k, seed) for k, seed in enumerate(LIGHT)]
    whole = [(-k, "1" * k) for k in range(1, LIGHT_FROM)]
    of_items = [(k, seed, n >= many) for k, seed in heavy] + [(k, seed, (n >= LIGHT_FROM) & (n < many)) for k, seed in light]
    of_items += [(k, seed, n == len(seed)) for k, seed in whole]
    tests = T.stored(_hashes(_hashed(items), of_items, "item_id", "short").distinct(), "seeds")
    # at most LIGHT_FROM lengths and one flag
    lengths = {r.n for r in items.select(F.when(n < many, F.greatest(F.lit(0), F.least(n, F.lit(LIGHT_FROM)))).alias("n")).distinct().collect()}
    of_docs = heavy + (light if LIGHT_FROM in lengths else []) + [(k, seed) for k, seed in whole if len(seed) in lengths]
    items = items.drop("short")
    if tests.count() <= BROADCAST_ROWS:
        tests = F.broadcast(tests)
    texts = docs.select("doc_id", _words(F.col("text")).alias("words"))
    train = _hashes(_hashed(texts), [(k, seed, F.lit(True)) for k, seed in of_docs], "doc_id")
    hits = train.join(tests.withColumnRenamed("at", "item_at"), "h").select("doc_id", "item_id", "short", (F.col("at") - F.col("item_at")).alias("shift"))
    # all places of a short item are alike, so its first one stands for them
    one = F.when(F.col("short").isNull(), F.col("shift")).alias("place")
    hits = hits.groupBy("doc_id", "item_id", "short", one).agg(F.min("shift").alias("shift")).select("doc_id", "item_id", "shift")
    hits = T.stored(hits.distinct(), "hits")

    found = docs.select("doc_id", "text").join(hits.select(F.col("doc_id").alias("hit_id")).distinct(), F.col("doc_id") == F.col("hit_id"), "left_semi")
    found = found.select("doc_id", _words(F.col("text")).alias("doc_words"))
    whole = hits.join(found, "doc_id").join(items.withColumnRenamed("words", "item_words"), "item_id")
    start = F.greatest(F.col("shift"), F.lit(0))
    # the item's words that fall into the document, beside the document's words at their places
    skipped = start - F.col("shift")
    pairs = F.arrays_zip(
        F.slice("item_words", skipped + 1, F.size("item_words")).alias("a"),
        F.slice("doc_words", start + 1, F.greatest(F.size("item_words") - skipped, F.lit(0))).alias("b"),
    )
    whole = whole.select("doc_id", "item_id", start.alias("doc_start"), F.size("item_words").alias("item_words"), F.transform(pairs, lambda p: (F.coalesce(p["a"] == p["b"], F.lit(False))).cast("int")).alias("same"))
    total = F.aggregate("same", F.lit(0), lambda a, x: a + x)
    best = F.when(
        F.size("same") >= stretch,
        F.array_max(F.transform(F.sequence(F.lit(1), F.size("same") - stretch + 1), lambda i: F.aggregate(F.slice("same", i, stretch), F.lit(0), lambda a, x: a + x))),
    ).otherwise(0)
    whole = whole.select("doc_id", "item_id", "doc_start", "item_words", total.alias("same_words"), best.alias("best"))
    whole = whole.where((F.col("same_words") >= share * F.col("item_words")) | (F.col("best") >= 0.8 * stretch))
    first = F.max(F.struct("same_words", (-F.col("doc_start")).alias("back"), "item_words")).alias("m")
    return whole.groupBy("doc_id", "item_id").agg(first).select(
        "doc_id", "item_id", (-F.col("m.back")).alias("doc_start"), F.col("m.item_words").alias("item_words"), F.col("m.same_words").alias("same_words")
    )


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of `docs` in which no benchmark item is found."""
    bad = T.stored(contamination(docs, benchmark, **how).select("doc_id").distinct(), "leaks")
    return T.without(docs, bad)
