"""Outliers of a variable by Tukey's fences over the whole selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.functions.columns import col
from morphotab.operators.selection import FINISH, hinges

FENCE = 1.5


def fences(df: DataFrame, value: str, coef: float = FENCE, finish: int = FINISH) -> DataFrame:
    """One row `low`, `high`: hinges minus / plus `coef` hinge spreads."""
    spread = F.col("upper_hinge") - F.col("lower_hinge")
    return hinges(df, value, finish=finish).select(
        (F.col("lower_hinge") - coef * spread).alias("low"), (F.col("upper_hinge") + coef * spread).alias("high")
    )


def _outside(df: DataFrame, value: str, coef: float, finish: int) -> Column:
    bounds = fences(df, value, coef, finish).select(F.struct("low", "high").alias("fences")).scalar()
    return (col(value) < bounds["low"]) | (col(value) > bounds["high"])


def outliers(df: DataFrame, value: str, coef: float = FENCE, finish: int = FINISH) -> DataFrame:
    """Rows whose value lies outside the fences."""
    return df.where(_outside(df, value, coef, finish))


def remove_outliers(
    df: DataFrame, value: str, coef: float = FENCE, finish: int = FINISH
) -> DataFrame:
    """All other rows, including those without a value; the table as it is if the column was dropped."""
    if value not in df.columns:
        return df
    return df.where(~F.coalesce(_outside(df, value, coef, finish), F.lit(False)))
