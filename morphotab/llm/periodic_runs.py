"""Periodic runs of words by a descending-LCP Kruskal over the suffixes of each document.

Suffixes are sorted by doubling, neighbours in that order carry their LCP, and the classes of suffixes that share a beginning
are united by decreasing LCP with union-find; each class holds its positions in order, and the smaller is inserted into the
larger. Two positions at distance p that become neighbours in the class of LCP L, p at most L, begin a square: the words from
the first one on have smallest period p for p + L words. The leftmost such pair of a run gives the run once and exactly, so
pairs whose preceding words agree are left out.

A run of length max(least, times * p) or more has L of at least max(least - p, (times - 1) * p), which is 16 or more for
24 and 3. Only documents in which some window of that many words repeats are sorted, and only such suffixes are united.
Words are compared by 64-bit hashes. A task holds a slice of texts of a few megabytes, or one longer text, at some 200 bytes
a word of the documents that have repeated windows.

Every row of `docs` gives one row, repeated rows too; doc_id keeps its type and may be null. A null or empty text has no words and no runs.
An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as ST

from morphotab.llm import text as T

LEAST, TIMES = 24, 3
_SALT = np.uint64(0x9E3779B97F4A7C15)


def least_lcp(least: int, times: int) -> int:
    """The smallest LCP of the pair that begins a run."""
    return max(1, min(max(least - p, (times - 1) * p) for p in range(1, max(2, least + 1))))


def repeated_windows(codes: np.ndarray, width: int) -> np.ndarray:
    """Whether the window of `width` codes from each place on occurs elsewhere too; windows over the end do not."""
    n = len(codes)
    if n <= width:
        return np.zeros(n, bool)
    whole, size = codes, 1  # hashes of windows of a power of two
    while 2 * size <= width:
        whole = T.mix(whole[: len(whole) - size] * _SALT + whole[size:])
        size *= 2
    m = n - width + 1
    if size < width:
        whole = T.mix(whole[:m] * _SALT + whole[width - size : width - size + m])
    order = np.argsort(whole, kind="stable")
    same = whole[order[1:]] == whole[order[:-1]]
    out = np.zeros(n, bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def suffix_order(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the order of their suffixes, and the LCP of each place with the next one of that order."""
    n = len(codes)
    rank = np.unique(codes, return_inverse=True)[1]
    levels = [rank.astype(np.int32)]
    while rank.max() < n - 1:
        size = 1 << (len(levels) - 1)
        key = rank.astype(np.int64) * (n + 1)
        key[: n - size] += rank[size:] + 1
        rank = np.unique(key, return_inverse=True)[1]
        levels.append(rank.astype(np.int32))
    order = np.argsort(rank)
    a, b = order[:-1].copy(), order[1:].copy()
    lcp = np.zeros(n - 1, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        inside = np.flatnonzero(np.maximum(a, b) < n)
        step = np.zeros(n - 1, np.int64)
        step[inside] = (levels[k][a[inside]] == levels[k][b[inside]]).astype(np.int64) << k
        a, b, lcp = a + step, b + step, lcp + step
    return order, lcp


def seeds(order: np.ndarray, lcp: np.ndarray, floor: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """(place, later place, L): pairs that become neighbours in a class of LCP L, close enough to begin a long run."""
    edges = np.flatnonzero(lcp >= floor)
    edges = edges[np.argsort(-lcp[edges], kind="stable")]
    touched = np.unique(np.concatenate((edges, edges + 1)))
    at, where = np.searchsorted(touched, edges).tolist(), order[touched].tolist()
    index = dict(zip(where, range(len(where)), strict=True))
    parent, sets = list(range(len(where))), [[p] for p in where]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def settled() -> None:  # only pairs that are still neighbours when all of the level is united
        for i, j in fresh:
            own = sets[find(index[i])]
            if own[bisect_left(own, i) + 1] == j:
                out.append((i, j, level))

    out: list[tuple[int, int, int]] = []
    fresh: list[tuple[int, int]] = []
    level = 0
    for e, value in zip(at, lcp[edges].tolist(), strict=True):
        if value != level:
            if fresh:
                settled()
                fresh = []
            level, reach = value, value // (times - 1)
        x, y = find(e), find(e + 1)
        if len(sets[x]) < len(sets[y]):
            x, y = y, x
        large, small = sets[x], sets[y]
        parent[y], sets[y] = x, []
        places = [bisect_left(large, p) for p in small]
        last = len(small) - 1
        for k, (p, q) in enumerate(zip(small, places, strict=True)):
            if q and (not k or places[k - 1] != q) and p - large[q - 1] <= reach and p - large[q - 1] + value >= least:
                fresh.append((large[q - 1], p))
            if q < len(large) and (k == last or places[k + 1] != q) and large[q] - p <= reach and large[q] - p + value >= least:
                fresh.append((p, large[q]))
        if last < 16:
            for p, q in zip(reversed(small), reversed(places), strict=True):
                large.insert(q, p)
        else:
            large += small
            large.sort()  # two sorted stretches: one merge
    if fresh:
        settled()
    return out


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs, by start and period; equal codes are equal words of one document."""
    if len(codes) < 2:
        return []
    floor = least_lcp(least, times)
    found = seeds(*suffix_order(codes), floor, least, times)
    return sorted((i, j - i + L, j - i) for i, j, L in found if not i or codes[i - 1] != codes[j - 1])


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (start, length, period: by start, then period), collapsed: the words that no run drops.

    A run is a stretch of words with smallest period q and a length of max(least, times * q) or more that cannot be extended;
    `collapsed` leaves out the words of each run after its first q and joins the rest by one blank.
    """
    floor = least_lcp(least, times)
    one = ST.StructType([ST.StructField(c, ST.LongType()) for c in ("start", "length", "period")])
    fields = [("doc_id", docs.schema["doc_id"].dataType), ("n_words", ST.LongType()), ("runs", ST.ArrayType(one)), ("collapsed", ST.StringType())]
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, offsets = T.utf8(batch.column("text"))
            starts, ends, firsts = T.word_spans(data, offsets)
            sizes = np.diff(firsts)
            row = np.repeat(np.arange(len(sizes)), sizes)
            codes = T.mix(T.span_hashes(data, starts, ends) + row.astype(np.uint64) * _SALT)
            some = np.zeros(len(sizes), bool)
            some[row[repeated_windows(codes, floor)]] = True  # documents with repeated windows
            places = np.flatnonzero(some[row])
            found: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
            for start, length, period in runs_of(codes[places], least, times):
                at = places[start]
                found[row[at]].append((int(at - firsts[row[at]]), length, period))
            raw, cuts, texts = data.tobytes(), offsets.tolist(), []
            for k, own in enumerate(found):
                words = raw[cuts[k] : cuts[k + 1]].split()
                if own:
                    change = np.zeros(len(words) + 1, np.int64)
                    for start, length, period in own:
                        change[start + period] += 1
                        change[start + length] -= 1
                    words = compress(words, (np.cumsum(change[:-1]) == 0).tolist())
                texts.append(b" ".join(words).decode())
            rows = [[{"start": s, "length": n, "period": p} for s, n, p in own] for own in found]
            arrays = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(rows, kind), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])

    return docs.select("doc_id", "text").mapInArrow(run, ST.StructType([ST.StructField(*f) for f in fields]))
