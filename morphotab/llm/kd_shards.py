"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

The law is `bytes`: sizes of shards near equal. Units are groups of equal texts, so that copies share a shard; a group
above 1/256 of a shard's target is cut into parts of at most about that size by a hash of doc_id. A node of the tree
that still holds several shards is split at the weighted median (or the share of its left shards) along the
metadata dimension with the widest range in it: logarithm of the size, source, language or first doc_id, each scaled to 24 bits
and followed by 24 bits of the unit's hash, so that ties split too. The median is found from sums of bytes over 2 ** 16 ranges
of the coordinate, refined twice; only these sums and the ranges of a node reach the driver, never units.

Null texts have size 1, as empty ones; null languages and sources are one value each. Rows with equal doc_id and
text get slots of their own. An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphotab.llm import text as T

DIMENSIONS = ("size", "source", "lang", "id")
PART = 256  # parts of a shard's target that one unit may have
NUMBERED = 4096  # ranges in which the rows of a shard are numbered
STEP, STEPS = 16, 3


def _scaled(x: Column, low: float, high: float) -> Column:
    return F.floor((x - low) / F.lit(max(high - low, 1e-9)) * ((1 << 24) - 1)).cast("long")


def _hash24(x: Column) -> Column:
    return F.coalesce(F.pmod(F.xxhash64(x), F.lit(1 << 24)), F.lit(0))


def split_points(units: DataFrame, shards: int) -> Column:
    """An expression over the coordinates of `units` (bytes and a 48-bit long for each dimension) that gives the shard."""
    # a node: first shard, number of shards, condition; a split: (dimension, bound) by node
    place = F.lit(0)
    nodes = {0: shards}
    while any(k > 1 for k in nodes.values()):
        at = units.withColumn("node", place)
        ranges = at.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max)))).collect()
        open_nodes = {r.node: r for r in ranges if nodes[r.node] > 1}
        widest = {n: max(DIMENSIONS, key=lambda d, r=r: (r[f"max_{d}"] >> 24) - (r[f"min_{d}"] >> 24)) for n, r in open_nodes.items()}
        goal = {n: r.bytes * (nodes[n] // 2) / nodes[n] for n, r in open_nodes.items()}
        prefix, below = dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0)
        by_node = lambda values: F.coalesce(*(F.when(F.col("node") == n, v) for n, v in values.items()))
        bound: dict[int, int] = {}
        for step in range(STEPS if open_nodes else 0):
            rest = STEP * (STEPS - 1 - step)
            coordinate = by_node({n: F.col(d) for n, d in widest.items()})
            seen = at.where(F.col("node").isin(list(open_nodes))).withColumn("x", F.shiftright(coordinate, rest))
            seen = seen.where(F.shiftright("x", STEP) == by_node({n: F.lit(p) for n, p in prefix.items()}))
            sums = seen.groupBy("node", "x").agg(F.sum("bytes").alias("bytes")).collect()
            for n in open_nodes:
                for x, size in sorted((r.x, r.bytes) for r in sums if r.node == n):
                    if below[n] + size >= goal[n]:
                        prefix[n] = x
                        if not rest:  # the unit at the median goes to the side that comes nearer to the goal
                            bound[n] = x + (below[n] + size - goal[n] < goal[n] - below[n])
                        break
                    below[n] += size
        for n in [n for n, k in nodes.items() if k > 1]:
            left = nodes[n] // 2
            nodes[n + left], nodes[n] = nodes[n] - left, left
            if n in bound:
                place = F.when((place == n) & (F.col(widest[n]) >= bound[n]), n + left).otherwise(place)
    return place


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law)."""
    text = F.coalesce("text", F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "lang", "source", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h")
    )
    slim = T.stored(slim, "slim")
    same = ["h", "crc", "size"]
    groups = T.stored(slim.groupBy(*same).agg(F.count("*").alias("n")), "groups")
    part = max(1.0, (groups.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0) / count / PART)
    # at most count * PART groups are larger than that
    large = F.broadcast(groups.where(F.col("n") * F.col("size") > part).select(*same, F.ceil(F.col("n") * F.col("size") / F.lit(part)).alias("parts")))
    cut = slim.join(large, same, "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.lit(0))).drop("parts")
    units = cut.groupBy(*same, "part").agg(F.sum("size").alias("bytes"), F.min("lang").alias("lang"), F.min("source").alias("source"), F.min("doc_id").alias("id"))
    units = T.stored(units, "units")
    r = units.agg(F.min("size"), F.max("size"), F.min("id"), F.max("id")).first()
    tie = _hash24(F.concat_ws(" ", "h", "part"))
    primary = {
        "size": _scaled(F.log2("size"), *(0.0 if v is None else math.log2(v) for v in r[:2])),
        "source": _hash24(F.col("source")),
        "lang": _hash24(F.col("lang")),
        "id": F.coalesce(_scaled(F.col("id"), r[2] or 0, r[3] or 0), F.lit(0)),
    }
    placed = units.select("h", "crc", F.col("size").alias("unit_size"), "part", "bytes", *((F.shiftleft(c, 24) + tie).alias(d) for d, c in primary.items()))
    shard = split_points(placed, count)
    placed = T.stored(placed.select("h", "crc", F.col("unit_size").alias("size"), "part", shard.cast("int").alias("shard")), "placed")
    rows = cut.join(placed, [*same, "part"]).select("doc_id", "size", "crc", "shard", F.pmod(F.xxhash64("doc_id", "h"), F.lit(NUMBERED)).alias("range"))
    rows = T.stored(rows, "rows")
    counts = rows.groupBy("shard", "range").agg(F.count("*").alias("n"))
    before = counts.select("shard", "range", (F.sum("n").over(Window.partitionBy("shard").orderBy("range")) - F.col("n")).alias("before"))
    number = F.row_number().over(Window.partitionBy("shard", "range").orderBy("doc_id", "crc"))
    numbered = rows.withColumn("number", number).join(F.broadcast(before), ["shard", "range"])
    return numbered.select(
        "doc_id",
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("number") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
