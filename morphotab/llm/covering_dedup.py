"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets a non-zero vector of radius + 1 bits; a table keeps the bits whose vector has odd parity with the
table's own vector. Any `radius` vectors have a common orthogonal one, so two fingerprints that differ in at most `radius`
bits agree in all kept bits of one table at least: no pair is missed.

Work is done on distinct fingerprints. Tables of at most `crowd` fingerprints a bucket compare them pairwise. Members of
fuller buckets are linked without pairs: two fingerprints differ in at most 2 * t bits exactly if some value lies within t
flips of both, and all that share such a value are linked with its smallest one; at most 2081 distinct fingerprints (for t = 2)
can share one value, whatever the input. Links become components by alternating stars on tables in the shared folder.

With a wanted `similarity` the texts themselves decide: two are linked if the Jaccard similarity of their sets of word shingles is
at least that. Covering tables would need about a thousand rows a text to reach such pairs (they differ in 15 % of the bits
at 0.8), so candidates come from bands of minima of the hashed shingles, pairs whose SimHashes differ by far too much are left out, and the
sets of the others are compared.

Null and empty texts have fingerprint zero. Rows with equal doc_id are kept as they are; a null doc_id never becomes a
component's id unless its whole component has none.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.llm import text as T

BITS = 64
CROWD = 256
SEED = 42
STEP = 1 << 15  # shingles hashed at once
ROWS = 5  # minima in a band
MISSED = 1e-4  # share of pairs at the wanted similarity that no band finds
SLACK = 8  # standard deviations of differing bits before a pair is left out by its SimHashes
NAMELESS = 1 << 62  # numbers from here on stand for texts without a doc_id


def _shingles(text: bytes, width: int) -> Iterator[np.ndarray]:
    """XXH64 of the lower-cased text's word shingles, repeats included, STEP at a time."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    a, b = starts[:n].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, STEP):
        yield np.array([digest(joined[i:j], SEED) for i, j in zip(a[at : at + STEP], b[at : at + STEP], strict=True)], np.uint64)


def _votes(parts: Iterable[np.ndarray], prints: int) -> list[int]:
    votes, n = np.zeros((prints, BITS), np.int64), 0
    for h in parts:
        n += len(h)
        for k in range(prints):
            h = T.mix(h + np.uint64(k)) if k else h
            votes[k] += np.unpackbits(h.view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.uint16)  # STEP ones at most
    return np.packbits(2 * votes > n, axis=1).view(np.int64)[:, 0].tolist()


def fingerprint(text: bytes, width: int, prints: int = 1) -> list[int]:
    """SimHashes of the lower-cased text's word shingles, repeats included: of their XXH64, then of remixed hashes."""
    return _votes(_shingles(text, width), prints)


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """The different hashed shingles of a text, sorted."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingles(text, width)]))


def n_bands(similarity: float) -> int:
    """Bands of ROWS minima of which sets that similar share none with a probability below MISSED."""
    return math.ceil(math.log(MISSED) / math.log1p(-(similarity**ROWS))) if similarity < 1 else 1


def bands(shingles: np.ndarray, n: int) -> list[int]:
    """One hash for each band of ROWS minima of the shingles under odd multipliers; none for an empty set."""
    if not len(shingles):
        return []
    factors = np.random.default_rng(SEED).integers(0, 1 << 63, n * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(n * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 1 << 10):
        np.minimum(least, (shingles[at : at + (1 << 10), None] * factors).min(0), out=least)
    out = np.arange(n, dtype=np.uint64)
    for column in least.reshape(n, ROWS).T:
        out = T.mix(out + T.mix(column))
    return out.view(np.int64).tolist()


def fingerprints(docs: DataFrame, width: int = 4, prints: int = 1) -> DataFrame:
    """doc_id and fps, the signed fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            data, offsets = T.utf8(batch.column("text"))
            raw = data.tobytes()
            fps = [fingerprint(raw[a:b], width, prints) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.list_(pa.int64()))], ["doc_id", "fps"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fps array<long>")


def masks(radius: int, bits: int = BITS) -> list[int]:
    """The kept bits of each of the 2 ** (radius + 1) - 1 tables over the lowest `bits`, as signed longs."""
    top = 1 << (radius + 1)
    vectors = [1 + i % (top - 1) for i in range(bits)]
    out = [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, top)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in out]


def flips(t: int) -> list[int]:
    """All values with at most `t` bits set, as signed longs."""
    found, last = {0}, {0}
    for _ in range(t):
        last = {x | 1 << i for x in last for i in range(BITS) if not x >> i & 1}
        found |= last
    return [x - (1 << BITS) if x >> (BITS - 1) else x for x in sorted(found)]


def links(prints: DataFrame, radius: int = 4, crowd: int = CROWD, bits: int = BITS) -> DataFrame:
    """k, a, b: links a < b between distinct fingerprints (k, fp) that connect all pairs of a k within `radius` bits."""
    tables = masks(radius, bits)
    kept = F.array(*(F.lit(m) for m in tables))
    # a bucket is known by one hash; rows of other tables that a collision brings into it are told apart below
    bucket = lambda t: F.xxhash64("k", F.lit(t), F.col("fp").bitwiseAND(F.lit(tables[t])))
    each = F.explode(F.array(*(F.struct(bucket(t).alias("bucket"), F.lit(t).cast("byte").alias("tab")) for t in range(len(tables)))))
    rows = prints.select(F.col("k").cast("short").alias("k"), "fp", each.alias("b")).select("b.bucket", "b.tab", "k", "fp")
    crowded = T.stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    inside = T.stored(rows.join(crowded, "bucket"), "members")
    few = inside.where(F.col("n") <= crowd)
    at = ["bucket", "tab", "k"]
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    # a pair that shares several tables is linked in the first of them only
    sooner = F.exists(F.slice(kept, F.lit(1), F.col("tab").cast("int")), lambda m: F.col("a").bitwiseXOR(F.col("b")).bitwiseAND(m) == 0)
    pairs = few.select(*at, F.col("fp").alias("a")).join(few.select(*at, F.col("fp").alias("b")), at).where((F.col("a") < F.col("b")) & near & ~sooner)
    return pairs.select("k", "a", "b").union(_through_balls(inside.where(F.col("n") > crowd).select("k", "fp").distinct(), radius)).distinct()


def _through_balls(prints: DataFrame, radius: int) -> DataFrame:
    """Links among fingerprints through the values within half the radius of them; an odd radius crosses one more bit."""
    half, odd = divmod(radius, 2)
    around = lambda t: F.explode(F.transform(F.array(*(F.lit(x) for x in flips(t))), lambda x: F.col("fp").bitwiseXOR(x)))
    near = prints.select("k", "fp", around(half).alias("z"))
    if odd:
        wide = prints.select("k", F.col("fp").alias("b"), around(half + 1).alias("z"))
        return near.withColumnRenamed("fp", "a").join(wide, ["k", "z"]).where("a < b").select("k", "a", "b").distinct()
    centre = near.groupBy("k", "z").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return near.join(centre, ["k", "z"]).where("a < fp").select("k", "a", F.col("fp").alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """node, label: each node of the links (u, v) with the smallest node that it is connected with."""
    edges = T.stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        again = large.join(small, "u")
        edges = T.stored(
            again.select(F.col("v").alias("u"), F.col("m").alias("v")).union(again.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges"
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        state = tuple(now)


def near_duplicates(
    docs: DataFrame, width: int = 4, radius: int = 4, crowd: int = CROWD, prints: int = 1, bits: int = BITS, similarity: float | None = None
) -> DataFrame:
    """doc_id, fingerprint (hexadecimal; of the first, if several), component_id: the smallest doc_id that links reach.

    With several independent fingerprints, texts are linked if the lowest `bits` of any of them differ in at most `radius`
    bits. With a `similarity`, texts are linked if the Jaccard similarity of their shingles is at least that; the fingerprints
    are then those of the different shingles, and `radius`, `crowd` and `bits` are of no account.
    """
    if similarity is not None:
        return similar_texts(docs, width, similarity, prints)
    own = T.stored(fingerprints(docs, width, prints), "fingerprints")
    nameless = F.lit(NAMELESS) + F.call_function("shiftrightunsigned", F.xxhash64("fps"), F.lit(3))
    nodes = T.stored(own.groupBy("fps").agg(F.coalesce(F.min("doc_id"), nameless).alias("node")), "nodes")
    low = F.col("fp").bitwiseAND(F.lit((1 << bits) - 1 if bits < BITS else -1)).alias("fp")
    each = nodes.select("node", F.posexplode("fps").alias("k", "fp")).select("node", "k", low)
    named = T.stored(each.groupBy("k", "fp").agg(F.min("node").alias("u")), "prints")
    found = links(named.select("k", "fp"), radius, crowd, bits)
    ends = found.join(named.withColumnRenamed("fp", "a"), ["k", "a"]).join(named.select("k", F.col("fp").alias("b"), F.col("u").alias("v")), ["k", "b"])
    edges = ends.select("u", "v")
    if prints > 1:  # one fingerprint may be shared by several nodes
        edges = edges.union(each.join(named, ["k", "fp"]).where("node <> u").select("u", F.col("node").alias("v")))
    label = components(edges).withColumnRenamed("node", "at")
    done = nodes.join(label, F.col("node") == F.col("at"), "left").select("fps", F.coalesce("label", "node").alias("id"))
    joined = own.join(done, "fps")
    return joined.select("doc_id", hexadecimal(F.col("fps")[0]).alias("fingerprint"), F.when(F.col("id") < NAMELESS, F.col("id")).alias("component_id"))


def differing_share(similarity: float) -> float:
    """Share of SimHash bits in which sets of equal size and this Jaccard similarity are expected to differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def sketches(docs: DataFrame, width: int, similarity: float, prints: int) -> DataFrame:
    """doc_id, node (a hash of the set of shingles), fps (SimHashes of the set) and bands."""
    n = n_bands(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            nodes, fps, found = [], [], []
            for raw in _raw(batch):
                h = shingle_set(raw, width)
                nodes.append(_node(h))
                fps.append(_votes((h[at : at + STEP] for at in range(0, len(h), STEP)), prints))
                found.append(bands(h, n))
            arrays = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(fps, pa.list_(pa.int64())), pa.array(found, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "node", "fps", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, node long, fps array<long>, bands array<long>")


def _raw(batch: pa.RecordBatch) -> Iterator[bytes]:
    data, offsets = T.utf8(batch.column("text"))
    raw = data.tobytes()
    return (raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(shingles.tobytes()) - (1 << 63)


def _sets(docs: DataFrame, own: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and shingles of the nodes `wanted`, read again from one of the rows that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in T.slices(batches):
            sets = [shingle_set(raw, width) for raw in _raw(batch)]
            yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "shingles"])

    ids = own.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.join(ids, "doc_id", "left_semi").union(rows.where("doc_id is null"))
    sets = texts.select("text").mapInArrow(run, "node long, shingles array<long>").join(wanted, "node", "left_semi")
    return T.stored(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def _alike(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float, prints: int) -> DataFrame:
    """The pairs (u, v) of nodes whose sets of shingles are similar enough; those with far too different SimHashes are not compared."""
    bits, share = BITS * prints, differing_share(similarity)
    most = bits * share + SLACK * math.sqrt(bits * share * (1 - share))
    ends = lambda df, c: (df.select(F.col("node").alias("u"), F.col(c).alias("p")), df.select(F.col("node").alias("v"), F.col(c).alias("q")))
    p, q = ends(nodes, "fps")
    differing = F.aggregate(F.zip_with("p", "q", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, d: n + d)
    near = pairs.join(p, "u").join(q, "v").where(differing <= most).select("u", "v")
    p, q = ends(sets, "shingles")
    common = F.size(F.array_intersect("p", "q"))
    near = near.join(p, "u").join(q, "v").select("u", "v", common.alias("n"), (F.size("p") + F.size("q") - common).alias("all"))
    return near.where(F.col("n") / F.col("all") >= similarity).select("u", "v")


def _apart(members: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (u, v) of nodes that share a bucket and are not yet connected, whatever the size of the bucket.

    The members with a bucket's most frequent label are not compared with one another, so a large group costs its size times the rest.
    """
    known = members.join(label, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    groups = known.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket")
    mixed = T.stored(groups.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels")).where("labels > 1").select("bucket", "main"), "mixed")
    known = T.stored(known.join(mixed, "bucket"), "known")
    rest = known.where("label <> main").select("bucket", F.col("node").alias("x"), F.col("label").alias("lx"))
    every = known.select("bucket", F.col("node").alias("y"), F.col("label").alias("ly"), (F.col("label") == F.col("main")).alias("m"))
    both = rest.join(every, "bucket").where((F.col("lx") != F.col("ly")) & (F.col("m") | (F.col("x") < F.col("y"))))
    return both.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def similar_texts(docs: DataFrame, width: int = 5, similarity: float = 0.8, prints: int = 8) -> DataFrame:
    """As near_duplicates, with links between all texts found in a common band whose shingles have at least this Jaccard similarity.

    Each bucket's members are compared with its smallest one first; then all pairs that this leaves unconnected are compared, so
    that the groups are those of comparing all pairs.
    """
    own = T.stored(sketches(docs, width, similarity, prints), "sketches")
    nodes = T.stored(own.groupBy("node").agg(F.first("fps").alias("fps"), F.first("bands").alias("bands")), "nodes")
    rows = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = T.stored(rows.join(shared, "bucket"), "members")
    sets = _sets(docs, own, members.select("node").distinct(), width)
    heads = members.groupBy("bucket").agg(F.min("node").alias("u"))
    stars = members.join(heads, "bucket").where("u < node").select("u", F.col("node").alias("v")).distinct()
    edges = T.stored(_alike(stars, nodes, sets, similarity, prints), "stars")
    label = components(edges)
    edges = edges.union(_alike(_apart(members, label), nodes, sets, similarity, prints))
    label = components(edges)
    done = T.stored(own.select("doc_id", "node", F.col("fps")[0].alias("fp")).join(label, "node", "left").select("doc_id", "fp", F.coalesce("label", "node").alias("label")), "labels")
    least = done.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return done.join(least, "label").select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, width: int = 5, prints: int = 8, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs` that carry the smallest doc_id of their group of near copies, each such doc_id once.

    Rows without a doc_id stay, but for those whose group has a member with one.
    """
    found = similar_texts(docs, width, similarity, prints).select("doc_id", "component_id")
    gone = T.stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "copies")
    return T.without(docs, gone)


def near_deduplicated(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """The rows of `docs` that carry the smallest doc_id of their group by near_duplicates, all columns; repeated rows of that doc_id stay.

    Rows without a doc_id stay.
    """
    found = near_duplicates(docs, width, radius).where("doc_id <> component_id")
    return T.without(docs, T.stored(found.select("doc_id").distinct(), "copies"))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
