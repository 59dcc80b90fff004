"""Row and column selection."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphotab.functions.columns import categorical_columns, col, cols, numeric_columns
from morphotab.functions.nulls import is_finite
from morphotab.schema import CHANNEL, OBJECT_ID
from morphotab.sources.shared import written

IN_LIST = 1000


def level_lists(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Sorted levels of the columns in long form: Variable, Level. NULL is no level."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("Variable"), col(c).alias("Level")) for c in columns]))
    return (
        df.select(pairs.alias("p")).select("p.*").where(F.col("Level").isNotNull()).distinct()
        .orderBy("Variable", "Level")
    )


def select_levels(df: DataFrame, levels: Mapping[str, Sequence[str] | DataFrame], most: int = IN_LIST) -> DataFrame:
    """Rows whose value is among the chosen levels, in every column named.

    Up to `most` levels are a predicate that reaches the scan. More of them, or the first column of a table, become a table
    in the shared folder that the rows meet in a semi-join: the planner knows its size, broadcasts it if that is small, and else
    joins by shuffle, with the Bloom filter that it builds from the smaller side. NULL is no level.
    """
    for name, chosen in levels.items():
        if not isinstance(chosen, DataFrame) and len(chosen) <= most:
            df = df.where(col(name).isin(list(chosen)))
            continue
        if not isinstance(chosen, DataFrame):
            chosen = df.sparkSession.createDataFrame(pd.DataFrame({"level": list(chosen)}), "level string")
        table = chosen.select(col(chosen.columns[0]).cast("string").alias("_level")).where("_level IS NOT NULL").distinct()
        table = written(table, "levels")
        df = df.join(table, col(name) == F.col("_level"), "left_semi")
    return df


def select_numeric(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Drop the numeric columns that are not named; all other columns stay."""
    dropped = set(numeric_columns(df)) - set(keep)
    return df.select(*[col(c) for c in df.columns if c not in dropped])


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.select(*cols(names))


def range_filter(
    df: DataFrame, value: str, lower: float, upper: float, channel: str | None = None
) -> DataFrame:
    """Rows with lower <= value <= upper; with a channel, rows of other channels pass untouched."""
    inside = col(value).between(lower, upper)
    if channel is None:
        return df.where(inside)
    return df.where(~col(CHANNEL).eqNullSafe(channel) | inside)


def rect_filter(
    df: DataFrame,
    x: str,
    y: str,
    x_limits: tuple[float, float],
    y_limits: tuple[float, float],
) -> DataFrame:
    return df.where(col(x).between(*x_limits) & col(y).between(*y_limits))


def finite_range(df: DataFrame, columns: Sequence[str], jointly: bool = False) -> DataFrame:
    """Smallest and largest finite value per column: Variable, Min, Max.

    With `jointly`, only rows count in which all the columns are finite (the ranges of a scatter plot).
    """
    if jointly:
        for c in columns:
            df = df.where(is_finite(col(c)))
    aggs = []
    for i, c in enumerate(columns):
        x = F.when(is_finite(col(c)), col(c))
        aggs += [F.min(x).alias(f"lo_{i}"), F.max(x).alias(f"hi_{i}")]
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("Variable"), F.col(f"lo_{i}").alias("Min"), F.col(f"hi_{i}").alias("Max"))
            for i, c in enumerate(columns)
        ]
    )
    return df.agg(*aggs).select(F.explode(rows).alias("r")).select("r.*")


def lift_zeros(df: DataFrame, value: str) -> DataFrame:
    """Replace zeros by the smallest positive value of the table, for logarithmic axes."""
    smallest = df.agg(F.min(F.when(col(value) > 0, col(value))).alias("smallest")).scalar()
    return df.withColumn(value, F.when(col(value) == 0, smallest).otherwise(col(value)))


def dedup_group_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per combination of the categorical columns, the one with the smallest object id.

    Used for variables that repeat the same value on every object of a group. The pick is
    an aggregation, so groups shrink before they are shuffled.
    """
    keys = list(columns or categorical_columns(df))
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in [OBJECT_ID] if c in rest]
    order += [c for c in rest if c not in order]
    # the least row in the order object id, then the other columns: a fixed choice
    first = F.min(F.struct(*[col(c) for c in order])).alias("_row")
    picked = df.groupBy(*cols(keys)).agg(first)
    return picked.select(*[F.col("_row").getField(c).alias(c) if c in rest else col(c) for c in df.columns])
