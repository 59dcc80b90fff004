"""Reading and writing measurement tables."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphotab import schema as S
from morphotab.functions.columns import col, cols
from morphotab.functions.nulls import finite
from morphotab.operators.clean import leading_order

STRING_COLUMNS = [*S.KEYS, S.IMAGE_SUBSET, S.TIME]


def table_schema(header: Sequence[str], text_columns: Sequence[str] = ()) -> T.StructType:
    """Schema of a measurement file: keys and labels are strings, everything else is a double."""
    texts = {*STRING_COLUMNS, *text_columns}
    return T.StructType([T.StructField(n, T.StringType() if n in texts else T.DoubleType()) for n in header])


def import_table(df: DataFrame) -> DataFrame:
    """Bring a table into shape: labels as strings, numbers finite, 'NA' for no channel, keys first, no doubles."""
    named = [c for c in df.columns if c.strip() and not re.fullmatch(r"_c\d+", c)]
    df = df.select(*cols(named))
    for name in STRING_COLUMNS:
        if name in df.columns:
            df = df.withColumn(name, col(name).cast("string"))
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            df = df.withColumn(field.name, finite(col(field.name)))
    df = df.withColumn(S.CHANNEL, F.coalesce(col(S.CHANNEL), F.lit(S.MISSING_CHANNEL)))
    return leading_order(df).dropDuplicates()


def read_table(spark: SparkSession, path: str, text_columns: Sequence[str] = ()) -> DataFrame:
    """Read measurement CSV files with a common header; column names are kept as they are written.

    A column is numeric if all its values are numbers, else text; keys, labels and `text_columns` are always text.
    """
    raw = spark.read.option("header", True).option("nullValue", "NA").csv(path)
    open_names = [c for c in raw.columns if c not in {*STRING_COLUMNS, *text_columns}]
    bad = [F.max(col(c).isNotNull() & col(c).try_cast("double").isNull()).alias(str(k)) for k, c in enumerate(open_names)]
    found = raw.agg(*bad).first() if bad else ()
    texts = [*text_columns, *(c for c, is_text in zip(open_names, found) if is_text)]
    kinds = {f.name: f.dataType for f in table_schema(raw.columns, texts)}
    return import_table(raw.select(*[col(c).try_cast(kinds[c]).alias(c) for c in raw.columns]))


def write_table(df: DataFrame, path: str, file_format: str = "csv", partition_by: Sequence[str] = ()) -> None:
    """Write a table, by default as CSV with a header and `NA` for missing values."""
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "csv":
        writer = writer.option("header", True).option("nullValue", "NA")
    writer.format(file_format).save(path)
