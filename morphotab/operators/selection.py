"""Exact order statistics by radix selection: only histograms are shuffled.

A double becomes a 64-bit integer of the same order. A pass counts the rows of each facet by the leading bits, 16 more in
each pass, and only in the cells that hold a wanted position; all facets and positions are looked for together. With many cells to
look into, a pass takes fewer bits, so that a task holds some `CELLS` counts, whatever the number of rows and facets. When no such cell
holds more than `finish` rows, nor all of them more than `CELLS`, the next pass counts their values themselves.

The narrow table of facets and keys, and the few cells found by a pass, are written to the shared folder: the passes then read
two columns instead of computing their input again, and the planner knows how small the cells are when it joins them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphotab.functions.columns import col, key_struct
from morphotab.functions.nulls import finite
from morphotab.sources.shared import written

FINISH = 1 << 16
STEP, LEAST_STEP = 16, 4
CELLS = 1 << 18  # counts that a pass may have in one task
_MANTISSA = 1 << 52


def order_key(x: Column) -> Column:
    """A long that orders as the finite double x does: its IEEE bits, mirrored for negative numbers."""
    a = F.abs(x)
    guess = F.floor(F.log2(F.when(a > 0, a)))
    low = F.when(F.pow(F.lit(2.0), guess) > a, guess - 1).when(F.pow(F.lit(2.0), guess + 1) <= a, guess + 1).otherwise(guess)
    exponent = F.greatest(low, F.lit(-1022))
    # the divisor is a power of two, so the quotient is exact
    unit = a / F.pow(F.lit(2.0), exponent)
    bits = ((exponent + 1022) * _MANTISSA + (unit * float(_MANTISSA)).cast("long")).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(x > 0, bits).otherwise(-bits)


def key_value(key: Column) -> Column:
    """The double with this order key."""
    bits = F.abs(key)
    exponent = F.greatest(F.floor(bits / F.lit(_MANTISSA).cast("decimal(20,0)")).cast("long"), F.lit(1).cast("long"))
    unit = (bits - (exponent - 1) * _MANTISSA).cast("double") / float(_MANTISSA)
    value = unit * F.pow(F.lit(2.0), (exponent - 1023).cast("double"))
    return F.when(key < 0, -value).otherwise(value)


def _step(cells: int) -> int:
    """Bits of a pass that looks into so many cells."""
    return max(LEAST_STEP, min(STEP, (CELLS // max(1, cells)).bit_length() - 1))


def selected_keys(rows: DataFrame, positions: Callable[[Column], dict[str, Column]], finish: int = FINISH) -> DataFrame:
    """`_key`, `_n`, `_name`, `_cell`, `_pos`: the keys at 1-based positions of every facet.

    `rows` has `_key` (a struct) and `_bits` (a long, not NULL), and is read once. `positions` maps a facet's size to named
    positions. `_pos` is the position among the rows with the same key.
    """
    spark = rows.sparkSession
    rows = written(rows.select("_key", "_bits"), "keys")
    shift, wanted = 64 - _step(rows.select("_key").distinct().count()), None
    while True:
        cell = F.shiftright("_bits", shift)
        if wanted is None:
            counts = rows.groupBy("_key", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_in"))
            facets = counts.groupBy("_key").agg(F.sum("_in").alias("_n"))
            named = F.explode(F.array(*[F.struct(F.lit(k).alias("_name"), p.cast("long").alias("_pos")) for k, p in positions(F.col("_n")).items()]))
            asked = facets.select("_key", "_n", named.alias("w")).select("_key", "_n", "w.*", F.lit(0).cast("long").alias("_parent"))
            counts = counts.withColumn("_parent", F.lit(0).cast("long"))
        else:
            asked = wanted.select("_key", "_n", "_name", "_pos", F.col("_cell").alias("_parent"))
            open_cells = wanted.select("_key", F.col("_cell").alias("_parent")).distinct()
            inside = rows.withColumn("_parent", F.shiftright("_bits", before)).join(open_cells, ["_key", "_parent"])
            counts = inside.groupBy("_key", "_parent", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_in"))
        up_to = F.sum("_in").over(Window.partitionBy("_key", "_parent").orderBy("_cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ends = counts.withColumn("_up_to", up_to)
        here = (F.col("_pos") > F.col("_up_to") - F.col("_in")) & (F.col("_pos") <= F.col("_up_to"))
        found = asked.join(ends, ["_key", "_parent"]).where(here)
        found = found.select("_key", "_n", "_name", "_cell", (F.col("_pos") - F.col("_up_to") + F.col("_in")).alias("_pos"), "_in")
        if shift == 0:
            return found.drop("_in")
        wanted = written(found, "cells")
        before = shift
        most, cells = wanted.agg(F.max("_in"), F.count_distinct("_key", "_cell")).first()
        shift = 0 if (most or 0) <= min(finish, CELLS // max(1, cells)) else max(0, shift - _step(cells))


def order_statistics(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    positions: Callable[[Column], dict[str, Column]],
    finish: int = FINISH,
) -> DataFrame:
    """Values at given 1-based positions of the sorted facet, with `_n` the facet's size: `_key`, `_n` and the names."""
    x = finite(col(value).cast("double"))
    rows = df.select(key_struct(keys).alias("_key"), x.alias("_x")).where(F.col("_x").isNotNull())
    found = selected_keys(rows.select("_key", order_key(F.col("_x")).alias("_bits")), positions, finish)
    names = list(positions(F.lit(1)))
    at = key_value(F.col("_cell"))
    return found.groupBy("_key").agg(F.max("_n").alias("_n"), *[F.max(F.when(F.col("_name") == n, at)).alias(n) for n in names])


def quantiles(df: DataFrame, value: str, keys: Sequence[str], probs: dict[str, float], finish: int = FINISH) -> DataFrame:
    """Linearly interpolated quantiles (type 7) per facet, exact: `_key`, `_n` and one column per name."""

    def place(n: Column, p: float) -> Column:
        return (n - 1) * F.lit(p)

    def positions(n: Column) -> dict[str, Column]:
        out = {}
        for name, p in probs.items():
            out[f"_{name}_lo"] = F.floor(place(n, p)) + 1
            out[f"_{name}_hi"] = F.ceil(place(n, p)) + 1
        return out

    found = order_statistics(df, value, keys, positions, finish)
    lo = {name: F.col(f"_{name}_lo") for name in probs}
    hi = {name: F.col(f"_{name}_hi") for name in probs}
    part = {name: place(F.col("_n"), p) - F.floor(place(F.col("_n"), p)) for name, p in probs.items()}
    return found.select("_key", "_n", *[(lo[k] + part[k] * (hi[k] - lo[k])).alias(k) for k in probs])


def hinges(df: DataFrame, value: str, keys: Sequence[str] = (), finish: int = FINISH) -> DataFrame:
    """Tukey's hinges per facet: `_key`, `_n`, `lower_hinge`, `upper_hinge`."""

    def positions(n: Column) -> dict[str, Column]:
        depth = F.floor((n + 3) / 2) / F.lit(2.0)
        lo, hi = F.floor(depth), F.ceil(depth)
        return {"_l1": lo, "_l2": hi, "_u1": n + 1 - lo, "_u2": n + 1 - hi}

    found = order_statistics(df, value, keys, positions, finish)
    return found.select(
        "_key",
        "_n",
        ((F.col("_l1") + F.col("_l2")) / 2).alias("lower_hinge"),
        ((F.col("_u1") + F.col("_u2")) / 2).alias("upper_hinge"),
    )
