"""Exact ranks without a single-task sort.

A window over a facet with a third of all rows would sort that third in one task.
Here every facet is cut into value ranges first, so the work per task is bounded by
the range, not by the facet:

1. values are counted per facet and distinct value (map-side combine, so a value
   that fills a third of the table is one row per task);
2. the leading 16 bits of a value's order key name its coarse range. A range with more than
   `most` distinct values is cut by 16 more bits, and so on down to single values: a tree of
   splits that grows with the data. The ranges to cut are few (one for every `most` values and
   level); they are met by equi-joins on the range, so no row carries a list of splits;
3. ranges are ranked by a window on (facet, range) and shifted by the number of rows in the
   ranges before: within a coarse range first, then among at most 65,536 coarse ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from morphotab.functions.columns import col, cols, key_struct
from morphotab.functions.nulls import finite
from morphotab.operators.selection import STEP, order_key
from morphotab.sources.shared import written

MOST = 1 << 18


def _counts(df: DataFrame, value: str, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    x = finite(col(value).cast("double"))
    return (
        df.select(key_struct(keys).alias("_key"), *cols(by), x.alias("_x"))
        .where(F.col("_x").isNotNull())
        .groupBy("_key", "_x", *cols(by))
        .agg(F.count(F.lit(1)).alias("_n"))
    )


def _ranged(counts: DataFrame, most: int) -> DataFrame:
    """The counts with `_top` (coarse range) and `_range` (first key of the finest range that a value lies in)."""
    ranged = counts.withColumn("_bits", order_key(F.col("_x")))
    top = F.shiftright("_bits", 64 - STEP)
    ranged = ranged.withColumns({"_top": top, "_range": F.shiftleft(top, 64 - STEP)})
    full = ranged.groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_values")).where(F.col("_values") > most)
    for shift in range(64 - 2 * STEP, -1, -STEP):
        cut = written(full.select("_key", "_range", F.lit(True).alias("_cut")), "splits")
        if cut.isEmpty():
            break
        fine = F.shiftleft(F.shiftright("_bits", shift), shift)
        joined = ranged.join(cut, ["_key", "_range"], "left")
        ranged = joined.withColumn("_range", F.when(F.col("_cut"), fine).otherwise(F.col("_range")))
        within = ranged.where("_cut").groupBy("_key", "_range").agg(F.count(F.lit(1)).alias("_values"))
        full = within.where(F.col("_values") > most)
        ranged = ranged.drop("_cut")
    return ranged.drop("_bits")


def ranked_values(
    df: DataFrame,
    value: str,
    keys: Sequence[str] = (),
    by: Sequence[str] = (),
    most: int = MOST,
) -> DataFrame:
    """One row per (keys, value, by) with its count and where the value stands in its facet.

    Columns: `_key` (struct of keys), `by`, `_x`, `_n`, `_below` (rows of the facet with a
    smaller value), `_ties` (rows with this value) and `_total`. Missing values are left out.
    The counts are written to the shared folder, as the ranges are measured on them first.
    """
    ranged = _ranged(written(_counts(df, value, keys, by), "counts"), most)
    ranges = ranged.groupBy("_key", "_top", "_range").agg(F.sum("_n").alias("_in_range"))
    tops = ranges.groupBy("_key", "_top").agg(F.sum("_in_range").alias("_in_top"))
    earlier = lambda by, at: Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        "_key",
        "_top",
        F.coalesce(F.sum("_in_top").over(earlier(["_key"], "_top")), F.lit(0)).alias("_before_top"),
        F.sum("_in_top").over(Window.partitionBy("_key")).alias("_total"),
    )
    inside = F.coalesce(F.sum("_in_range").over(earlier(["_key", "_top"], "_range")), F.lit(0))
    offsets = (
        ranges.withColumn("_inside", inside)
        .join(tops, ["_key", "_top"])
        .select("_key", "_range", "_total", (F.col("_before_top") + F.col("_inside")).alias("_offset"))
    )
    here = Window.partitionBy("_key", "_range")
    up_to = here.orderBy("_x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        ranged.drop("_top")
        .withColumn("_up_to", F.sum("_n").over(up_to))
        .withColumn("_ties", F.sum("_n").over(Window.partitionBy("_key", "_range", "_x")))
        .join(offsets, ["_key", "_range"])
        .withColumn("_below", F.col("_offset") + F.col("_up_to") - F.col("_ties"))
        .drop("_range", "_offset", "_up_to")
    )


def average_rank() -> Column:
    """Rank shared by all rows with the same value."""
    return F.col("_below") + (F.col("_ties") + 1) / F.lit(2.0)


def key_columns(keys: Sequence[str]) -> list[Column]:
    """The facet columns back from the key struct."""
    return [F.col("_key").getField(k).alias(k) for k in keys]


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = (), most: int = MOST) -> DataFrame:
    """Average rank of every distinct value per facet: keys, value, n, rank."""
    return ranked_values(df, value, keys, most=most).select(
        *key_columns(keys), F.col("_x").alias(value), F.col("_n").alias("n"), average_rank().alias("rank")
    )
