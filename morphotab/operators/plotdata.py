"""Tables behind the 1-D and 2-D plots."""

from __future__ import annotations

from pyspark.sql import DataFrame

from morphotab import schema as S
from morphotab.functions.columns import categorical_columns, col, cols
from morphotab.functions.nulls import safe_ln
from morphotab.operators.catalog import group_variables
from morphotab.operators.select import dedup_group_values, range_filter, rect_filter

IMAGE_COLUMNS = [S.IMAGE, S.TREATMENT, S.GENOTYPE]


def plot_data_1d(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    limits: tuple[float, float],
    reference: str | None = S.NUCLEUS,
) -> DataFrame:
    """Rows behind a 1-D plot. A group variable appears once per group, not once per object."""
    data = range_filter(df, value, *limits)
    shown = list(dict.fromkeys([*IMAGE_COLUMNS, value, fill, split]))
    if value in group_variables(reference):
        data = dedup_group_values(data, categorical_columns(data)).select(*cols(shown)).dropDuplicates()
    return data.select(*cols(shown))


def scatter_data(
    df: DataFrame,
    x: str,
    y: str,
    facet: str,
    x_limits: tuple[float, float],
    y_limits: tuple[float, float],
    color: str | None = None,
) -> DataFrame:
    """Rows behind a scatter plot, with the logarithms of both variables."""
    shown = [*IMAGE_COLUMNS, x, y, facet] + ([color] if color else [])
    return rect_filter(df, x, y, x_limits, y_limits).select(
        *cols(list(dict.fromkeys(shown))), safe_ln(col(x)).alias(f"Log({x})"), safe_ln(col(y)).alias(f"Log({y})")
    )
