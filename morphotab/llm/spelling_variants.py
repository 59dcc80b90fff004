"""Words that differ by one code point, found in tries of letter-group counts.

A word's vector counts its code points by group (code point modulo GROUPS). One replaced code point moves one count from a
group to another, one inserted adds one. The words of a part of the vocabulary are arranged in a trie, one level for each group;
blocks of words go down to the leaves one block after the other, words of a block together level by level, and each word may spend
one surplus and then one deficit: a near word is longer by one (surplus spent), or as long (both or none spent). A surplus must be spent on an earlier level than the
deficit, and equal vectors are taken in the order of the words, so each pair is met from one side. Words at the leaves are looked up by
their first and last halves, one of which the pair shares, and verified.

The vocabulary is dealt by the first levels of its vectors, by more levels where a part would hold more than LEAF words or a
thousandth of all words, whichever is more: at most a thousand parts are split on each level, so that plan is small at any
size. Each word is sent to all parts that its budget reaches; a part that more than PIECE words come to is copied, and they are dealt over
its copies. A task holds one part's words and one block.

Null texts have no words; a null doc_id counts as empty text before the colon of the deletion's hash; repeated rows are counted
each; an empty table gives no rows. Other columns are not read. A run's length is bounded by a row's only.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T

GROUPS = 16
DEPTHS = (2, 4, 8, 16)  # levels of the trie by which the vocabulary is dealt
LEAF = 30_000
PARTS = 1000
PIECE = 50_000
WIDTH = 31  # longer words are compared as strings
COUNTED = 200_000  # different words that a task counts before it hands them on
BLOCK = 50_000  # words that search a part together
SMALL = 64
STEP = 1 << 15  # pairs verified at once
_SALT = np.uint64(0x9E3779B97F4A7C15)
LETTERS = "A-Za-zÀ-ÿ"


def word_counts(docs: DataFrame, shortest: int = 7, every: int = 0) -> DataFrame:
    """word, n of all runs of letters, A-Z lower-cased, of at least `shortest` code points.

    With `every`, a run whose crc32 of `<doc_id>:<run>` that number divides loses the code point at that hash modulo its length.
    """
    letters = re.compile(f"[{LETTERS}]{{{max(1, shortest)},}}").findall

    def shortened(run: str, seed: int) -> str:
        h = zlib.crc32(run.encode(), seed)
        return run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def taken() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return out

        for batch in T.slices(batches):
            data, offsets = T.utf8(batch.column("text"))
            raw, cuts = data.tobytes().lower(), offsets.tolist()  # bytes: A-Z only
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), cuts, cuts[1:], strict=False):
                words = letters(raw[a:b].decode())
                if every:
                    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                    words = [w for w in (shortened(w, seed) for w in words) if len(w) >= shortest]
                counts.update(words)
            if len(counts) > COUNTED:
                yield taken()
        yield taken()

    parts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def vectors(words: list[str]) -> np.ndarray:
    """Counts of each word's code points by group."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), sizes)
    return np.bincount(row * GROUPS + codes % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS).astype(">u4")


def _keys(vecs: np.ndarray, depth: int) -> list[bytes]:
    raw, size = np.ascontiguousarray(vecs[:, :depth]).tobytes(), 4 * depth
    return [raw[at : at + size] for at in range(0, len(raw), size)]


def _options(width: int, state: int) -> list[tuple[np.ndarray, int]]:
    """What can be added to `width` counts, with the state after it: 0 nothing spent, 1 the surplus, 2 the deficit too."""
    unit, out = np.eye(width, dtype=np.int64), [(np.zeros(width, np.int64), state)]
    if state == 0:
        out += [(unit[i], 1) for i in range(width)]
        out += [(unit[i] - unit[j], 2) for i in range(width) for j in range(i + 1, width)]
    if state == 1:
        out += [(-unit[j], 2) for j in range(width)]
    return out


def homes(vecs: np.ndarray, split: set[bytes]) -> list[bytes]:
    """The part of the vocabulary that each vector belongs to."""
    out = _keys(vecs, DEPTHS[0])
    for a, b in zip(DEPTHS, DEPTHS[1:], strict=False):
        deeper = [k for k, key in enumerate(out) if len(key) == 4 * a and key in split]
        for k, key in zip(deeper, _keys(vecs[deeper], b), strict=True):
            out[k] = key
    return out


def routes(vecs: np.ndarray, split: set[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Rows and parts: all parts in which a near word of a row's vector can be."""
    stack = [(0, np.arange(len(vecs)), vecs.astype(np.int64), 0)]
    while stack:
        at, rows, near, state = stack.pop()
        a, b = (DEPTHS[at - 1] if at else 0), DEPTHS[at]
        for change, then in _options(b - a, state):
            block = near[:, a:b] + change
            ok = (block >= 0).all(1)
            moved = near[ok].copy()
            moved[:, a:b] = block[ok]
            keys = _keys(moved.astype(">u4"), b)
            deeper = np.fromiter((k in split for k in keys), bool, len(keys))
            yield rows[ok][~deeper], [k for k, d in zip(keys, deeper.tolist(), strict=True) if not d]
            if deeper.any():
                stack.append((at + 1, rows[ok][deeper], moved[deeper], then))


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted or replaced code point turns `a` into `b`."""
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


class Trie:
    """The words of one part by the counts of their letter groups, one level for each group."""

    def __init__(self, words: list[str]):
        vecs = vectors(words).astype(np.int64)
        self.words, self.codes = words, Codes(words)
        self.base = int(vecs.max()) + 3
        node = np.zeros(len(words), np.int64)
        self.children: list[np.ndarray] = []  # of a level: node * base + count, in order; a child's place is its node
        self.tables: list[np.ndarray] = []  # the same as tables from key to child, if counts are small
        nodes = 1
        for level in range(GROUPS):
            found, node = np.unique(node * self.base + vecs[:, level] + 1, return_inverse=True)
            self.children.append(found)
            if self.base <= SMALL:
                self.tables.append(np.full(nodes * self.base, -1))
                self.tables[-1][found] = np.arange(len(found))
            nodes = len(found)
        self.heads, tails = self.codes.halves(0)
        self.index = []  # words at the leaves by their halves
        for side in (self.heads, tails):
            key = T.mix(side + node.astype(np.uint64) * _SALT)
            order = np.argsort(key, kind="stable")
            keys, first, many = np.unique(key[order], return_index=True, return_counts=True)
            self.index.append((keys, first, many, order))

    def child(self, level: int, nodes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The nodes' children with these counts, -1 for none."""
        key = nodes * self.base + np.maximum(counts, 0)  # no child has 0, as counts are held one higher
        if self.tables:
            return self.tables[level][key]
        at = np.minimum(np.searchsorted(self.children[level], key), len(self.children[level]) - 1)
        return np.where(self.children[level][at] == key, at, -1)

    def leaves(self, vecs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Rows of `vecs`, leaves that their budget reaches, and the state at the leaf."""
        none = np.zeros(0, np.int64)
        now = [(np.arange(len(vecs)), np.zeros(len(vecs), np.int64)), (none, none), (none, none)]  # by state
        for level in range(GROUPS):
            then: list[list[tuple[np.ndarray, np.ndarray]]] = [[], [], []]
            for state, change, after in ((0, 0, 0), (0, 1, 1), (1, 0, 1), (1, -1, 2), (2, 0, 2)):
                rows, nodes = now[state]
                child = self.child(level, nodes, np.minimum(vecs[rows, level] + change + 1, self.base - 1))
                hit = child >= 0
                then[after].append((rows[hit], child[hit]))
            now = [(np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])) for found in then]
        for state, (rows, nodes) in enumerate(now):
            yield rows, nodes, state

    def near(self, words: list[str]) -> Iterator[tuple[int, int]]:
        """(place in `words`, place in the trie's words) of all near pairs, each pair of the vocabulary from one side."""
        codes = Codes(words)
        halves = {0: codes.halves(0), 1: codes.halves(1)}
        for rows, leaves, state in self.leaves(vectors(words).astype(np.int64)):
            longer = int(state == 1)
            for side in (0, 1):
                key = T.mix(halves[longer][side][rows] + leaves.astype(np.uint64) * _SALT)
                found, first, many, order = self.index[side]
                place = np.minimum(np.searchsorted(found, key), len(found) - 1)
                met = found[place] == key
                q, first, many = rows[met], first[place[met]], many[place[met]]
                q, at = np.repeat(q, many), np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                k = order[at]
                for cut in range(0, len(q), STEP):
                    a, b = q[cut : cut + STEP], k[cut : cut + STEP]
                    if side:  # pairs with equal heads have been met
                        other = halves[longer][0][a] != self.heads[b]
                        a, b = a[other], b[other]
                    hit = codes.one_edit(a, self.codes, b, longer)
                    for i, j in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
                        if state or words[i] < self.words[j]:
                            yield i, j


class Codes:
    """The code points of words: of words up to WIDTH as a matrix, of longer ones as strings only."""

    def __init__(self, words: list[str]):
        self.words, self.sizes = words, np.fromiter(map(len, words), np.int64, len(words))
        row = np.repeat(np.arange(len(words)), self.sizes)
        place = np.arange(len(row)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        self.matrix = np.zeros((len(words), WIDTH + 1), np.uint32)
        self.matrix[row[place < WIDTH], place[place < WIDTH]] = codes[place < WIDTH]

    def halves(self, longer: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the first and the last half that a word shares with near words as long as it, or longer by one."""
        cuts = ((self.sizes - 1 + longer) // 2).tolist()
        heads = np.fromiter((hash(w[:c]) for w, c in zip(self.words, cuts, strict=True)), np.int64, len(cuts))
        tails = np.fromiter((hash(w[len(w) - c :]) for w, c in zip(self.words, cuts, strict=True)), np.int64, len(cuts))
        return heads.view(np.uint64), tails.view(np.uint64)

    def one_edit(self, rows: np.ndarray, other: Codes, others: np.ndarray, longer: int) -> np.ndarray:
        """Whether one replaced code point, or one inserted if `longer`, turns the words `rows` into the `others`."""
        sizes = self.sizes[rows]
        ok = other.sizes[others] == sizes + longer
        a, b = self.matrix[rows], other.matrix[others]
        differ = a != b
        if longer:
            before = np.where(differ.any(1), differ.argmax(1), WIDTH)  # code points in common at the beginning
            place = np.arange(WIDTH)
            ok &= ~((a[:, :WIDTH] != b[:, 1:]) & (place >= before[:, None]) & (place < sizes[:, None])).any(1)
        else:
            ok &= differ.sum(1) == 1
        for i in np.flatnonzero(sizes + longer > WIDTH).tolist():
            ok[i] = one_edit(self.words[rows[i]], other.words[others[i]])
        return ok


def _plan(words: DataFrame) -> tuple[int, set[bytes]]:
    """The parts that are dealt by more levels: at most PARTS on each level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_keys(vectors(batch.column(0).to_pylist()), GROUPS), pa.binary())], ["vec"])

    n = words.count()
    limit, split = max(LEAF, n // PARTS), set()
    for depth in DEPTHS[:-1]:
        key = F.substring("vec", 1, 4 * depth)
        large = words.select("word").mapInArrow(run, "vec binary").groupBy(key.alias("key")).count().where(F.col("count") > limit)
        more = {bytes(r.key) for r in large.collect()}  # at most PARTS rows
        if not more:
            break
        split |= more
    return n, split


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: all ordered pairs of `words` (word, n; each word once) that differ by one code point."""
    _, split = _plan(words)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["home", "asks", "word", "n"]
        for batch in batches:
            own = batch.column("word").to_pylist()
            vecs = vectors(own)
            yield pa.RecordBatch.from_arrays([pa.array(homes(vecs, split), pa.binary()), pa.array(np.zeros(len(own), np.int8)), *batch.columns], names)
            for rows, keys in routes(vecs, split):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.ones(len(rows), np.int8)), *(c.take(pa.array(rows)) for c in batch.columns)], names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, trie = None, None
        own: tuple[list[str], list[int]] = ([], [])
        asking: tuple[list[str], list[int]] = ([], [])

        def found() -> pa.RecordBatch:
            pairs = list(trie.near(asking[0]))
            q, k = [i for i, _ in pairs], [j for _, j in pairs]
            a, b, m, n = [asking[0][i] for i in q], [own[0][j] for j in k], [asking[1][i] for i in q], [own[1][j] for j in k]
            return pa.RecordBatch.from_arrays([pa.array(a + b, pa.string()), pa.array(b + a, pa.string()), pa.array(n + m, pa.int64())], ["word", "near", "near_n"])

        for batch in batches:
            home, piece, asks, word, n = (batch.column(c) for c in ("home", "piece", "asks", "word", "n"))
            turn = pc.or_(pc.or_(pc.not_equal(home[1:], home[:-1]), pc.not_equal(piece[1:], piece[:-1])), pc.not_equal(asks[1:], asks[:-1]))
            cuts = [0, *(np.flatnonzero(turn.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                key = home[a].as_py(), piece[a].as_py()
                if current != key and asking[0]:
                    yield found()
                    asking = ([], [])
                if current != key:
                    own, current, trie = ([], []), key, None
                into = asking if asks[a].as_py() else own
                into[0].extend(word[a:b].to_pylist())
                into[1].extend(n[a:b].to_pylist())
                if asking[0]:
                    trie = trie or Trie(own[0])
                if len(asking[0]) >= BLOCK:
                    yield found()
                    asking = ([], [])
        if asking[0]:
            yield found()

    routed = T.stored(words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(route, "home binary, asks byte, word string, n long"), "routes")
    load = routed.groupBy("home").agg(F.sum("asks").alias("q"), F.count("*").alias("all")).where("all > q")  # parts that hold words
    load = load.select("home", F.ceil(F.greatest(F.col("q"), F.lit(1)) / PIECE).cast("int").alias("pieces"))
    dealt = routed.join(load, "home").withColumn("of", F.pmod(F.hash("word"), "pieces"))
    every = F.when(F.col("asks") == 1, F.array("of")).otherwise(F.sequence(F.lit(0), F.col("pieces") - 1))
    dealt = dealt.select("home", F.explode(every).alias("piece"), "asks", "word", "n")
    return dealt.repartition("home", "piece").sortWithinPartitions("home", "piece", "asks").mapInArrow(search, "word string, near string, near_n long")


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, times: int = 10, every: int = 0) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words of at least `shortest` code points and `least` occurrences.

    A word's form is its most frequent near word (ties: the smallest) if that occurs `times` as often; following forms gives its root.
    """
    words = T.stored(word_counts(docs, shortest, every).where(F.col("n") >= least), "words")
    near = T.stored(near_words(words), "near-words")
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    own = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), (-F.col("best.less")).alias("best_n"), "best.near")
    fits = F.col("best_n") >= times * F.col("n")
    own = T.stored(own.select("word", F.when(fits, F.col("near")).alias("form"), "n", "n_near", F.when(fits, F.col("best_n")).alias("form_n")), "forms")
    # each step to a form multiplies n, so a chain has at most log(largest n) of them; each join doubles the steps known
    most = words.agg(F.max("n")).first()[0] or 1
    steps = math.ceil(math.log2(max(2.0, 1 + math.log(most) / math.log(times))))
    links = own.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(steps):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = T.stored(links.join(further, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "roots")
    return own.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
