"""Threshold bins and reproducible samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from morphotab.functions.columns import col, cols, key_struct
from morphotab.operators.selection import FINISH, selected_keys
from morphotab.sources.shared import written

POINTS = 10_000  # points shown in a panel


def bin_column(value: str) -> str:
    return f"Bin -  {value}"


def parse_cuts(text: str) -> list[str]:
    """'0, 1' -> ['0', '1'], as written but in numeric order."""
    return sorted((part.strip() for part in text.split(",")), key=float)


def bin_thresholds(
    df: DataFrame, value: str, cuts: str | Sequence[float], null_label: str | None = "above"
) -> DataFrame:
    """Label each row by the right-closed interval its value falls into.

    Labels are `<= a`, `(a,b]` and `> z`. Missing values join `> z`; pass another
    `null_label` (or None) to set them apart. `Bin Order` gives the order of the labels.
    """
    marks = parse_cuts(cuts if isinstance(cuts, str) else ",".join(f"{c:g}" for c in cuts))
    labels = [f"<= {marks[0]}"]
    labels += [f"({a},{b}]" for a, b in zip(marks, marks[1:])]
    above = f"> {marks[-1]}"
    order = None
    for i, mark in enumerate(marks):
        hit = col(value) <= float(mark)
        order = F.when(hit, i) if order is None else order.when(hit, i)
    order = order.otherwise(len(marks))
    missing = col(value).isNull() | F.isnan(col(value))
    if null_label != "above":
        order = F.when(~missing, order)
    names = F.array(*[F.lit(t) for t in [*labels, above]])
    label = F.get(names, F.col("Bin Order"))
    if null_label not in ("above", None):
        label = F.coalesce(label, F.lit(null_label))
    return df.withColumn("Bin Order", order).withColumn(bin_column(value), label)


def sample_points(df: DataFrame, keys: Sequence[str], fraction: float) -> DataFrame:
    """The rows whose keys' hash falls into the wanted fraction: a predicate on the row, so that a rerun draws the same ones."""
    drawn = F.substring(F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys])), 1, 8)
    return df if fraction >= 1 else df.where(drawn < f"{int(fraction * 2**32):08x}")


def sample_exactly(df: DataFrame, panels: Sequence[str], keys: Sequence[str], points: int = POINTS, finish: int = FINISH) -> DataFrame:
    """`points` rows of every panel, or all of a smaller one: those whose keys have the smallest hashes.

    The hash of the last row to be drawn comes from the selection, so rows are neither sorted nor gathered by panel; of rows
    with just that hash the first ones in the order of their columns are drawn. A rerun draws the same rows.
    """
    digits = F.substring(F.md5(F.concat_ws("|", *[col(k).cast("string") for k in keys])), 1, 15)
    drawn = df.withColumns({"_key": key_struct(panels), "_bits": F.conv(digits, 16, 10).cast("long")})
    last = selected_keys(drawn, lambda n: {"last": F.least(n, F.lit(points))}, finish)
    last = written(last.select("_key", F.col("_cell").alias("_last"), "_pos"), "thresholds")
    drawn = drawn.join(last, "_key")
    ties = Window.partitionBy("_key").orderBy(*cols(df.columns))
    at_last = drawn.where("_bits = _last").withColumn("_row", F.row_number().over(ties)).where("_row <= _pos")
    return drawn.where("_bits < _last").select(*cols(df.columns)).unionAll(at_last.select(*cols(df.columns)))
