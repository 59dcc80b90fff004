"""Helpers for addressing columns by display name."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphotab.schema import OBJECT_ID


def col(name: str) -> Column:
    """Column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def cols(names: Sequence[str]) -> list[Column]:
    return [col(n) for n in names]


def key_struct(names: Sequence[str]) -> Column:
    """One grouping value for several columns.

    Struct values compare field by field with NULL equal to NULL, so a plain
    equality join on it is NULL-safe and keeps the partitioning of a window
    or an aggregation on the same struct.
    """
    return F.struct(*cols(names)) if names else F.struct(F.lit(0).alias("_all"))


def partition(names: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*cols(names))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def categorical_columns(df: DataFrame, with_id: bool = False) -> list[str]:
    """String columns in alphabetical order; the object id is no category."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return sorted(n for n in names if with_id or n != OBJECT_ID)


def snake(name: str) -> str:
    return re.sub(r"[^0-9a-z]+", "_", name.lower()).strip("_")


def snake_case(df: DataFrame) -> DataFrame:
    """Rename every column to lower_snake_case."""
    return df.toDF(*[snake(n) for n in df.columns])


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; used where results of different sum orders are compared."""
    return df.select(
        *[
            F.round(col(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else col(f.name)
            for f in df.schema.fields
        ]
    )
