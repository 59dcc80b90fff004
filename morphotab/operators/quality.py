"""Integrity reports, eligible reference objects and channel pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphotab import schema as S
from morphotab.functions.columns import col, cols
from morphotab.sources.shared import written


def unexpected_labels(df: DataFrame, accepted: Sequence[str] = tuple(S.ACCEPTED_OBJECTS)) -> DataFrame:
    """Object labels outside the accepted list and the images that hold them."""
    unknown = ~F.coalesce(col(S.OBJECT).isin(list(accepted)), F.lit(False))
    return df.where(unknown).select(col(S.OBJECT), col(S.IMAGE)).distinct()


def images_without_object(df: DataFrame, label: str) -> DataFrame:
    """Images in which no row carries the label."""
    found = F.coalesce(F.max(col(S.OBJECT) == label), F.lit(False))
    return df.groupBy(col(S.IMAGE)).agg(found.alias("_found")).where(~F.col("_found")).select(col(S.IMAGE))


def images_with_null_column(df: DataFrame) -> DataFrame:
    """Images in which some column has no value at all."""
    others = [c for c in df.columns if c != S.IMAGE]
    counts = [F.count(col(c)).alias(f"_c{i}") for i, c in enumerate(others)]
    per_image = df.groupBy(col(S.IMAGE)).agg(*counts)
    empty = F.lit(False)
    for i in range(len(others)):
        empty = empty | (F.col(f"_c{i}") == 0)
    return per_image.where(empty).select(col(S.IMAGE))


def null_channel_rows(df: DataFrame) -> DataFrame:
    """Image and object id of rows without a channel, whichever way that is written."""
    missing = col(S.CHANNEL).isNull() | (col(S.CHANNEL) == S.MISSING_CHANNEL)
    return df.where(missing).select(col(S.IMAGE), col(S.OBJECT_ID))


class Integrity:
    """The five reports as by-products of one pass over the table.

    The pass counts rows and known values by (image, object); rows without a channel keep their object id as a key of their own, so
    that they can be listed. Its result, as small as the number of groups, is written to the shared folder, and each report reads that.
    The reports equal the functions above.
    """

    def __init__(self, df: DataFrame):
        missing = col(S.CHANNEL).isNull() | (col(S.CHANNEL) == S.MISSING_CHANNEL)
        self.columns = [c for c in df.columns if c != S.IMAGE]
        keys = [col(S.IMAGE), col(S.OBJECT), missing.alias("_missing"), F.when(missing, col(S.OBJECT_ID)).alias("_id")]
        known = [F.count(col(c)).alias(f"_c{i}") for i, c in enumerate(self.columns)]
        self.groups = written(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *known), "integrity")

    def rows(self) -> DataFrame:
        """Number of rows and of images."""
        return self.groups.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("rows"), F.countDistinct(col(S.IMAGE)).alias("images"))

    def unexpected_labels(self, accepted: Sequence[str] = tuple(S.ACCEPTED_OBJECTS)) -> DataFrame:
        return unexpected_labels(self.groups, accepted)

    def images_without_object(self, label: str) -> DataFrame:
        return images_without_object(self.groups, label)

    def images_with_null_column(self) -> DataFrame:
        totals = self.groups.groupBy(col(S.IMAGE)).agg(*[F.sum(f"_c{i}").alias(f"_c{i}") for i in range(len(self.columns))])
        return totals.where(F.least(F.lit(1), *[F.col(f"_c{i}") for i in range(len(self.columns))]) == 0).select(col(S.IMAGE))

    def null_channel_rows(self) -> DataFrame:
        """As many rows as the table has."""
        rows = self.groups.where("_missing").withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_n"))))
        return rows.select(col(S.IMAGE), F.col("_id").alias(S.OBJECT_ID))


def eligible_references(df: DataFrame) -> DataFrame:
    """Objects that measurements can be normalised to.

    A surface qualifies if it occurs exactly once in every (image, channel) that has any
    such once-only surface. The nucleus is offered whenever it is present.
    """
    single = (
        df.where((col(S.CATEGORY) == S.SURFACE) & (col(S.OBJECT) != S.NUCLEUS))
        .groupBy(*cols([S.IMAGE, S.CHANNEL, S.OBJECT]))
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") == 1)
    )
    places = single.agg(F.countDistinct(F.struct(*cols([S.IMAGE, S.CHANNEL]))).alias("places")).scalar()
    qualified = (
        single.groupBy(col(S.OBJECT)).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == places)
        .select(col(S.OBJECT))
    )
    nucleus = df.where(col(S.OBJECT) == S.NUCLEUS).select(col(S.OBJECT)).distinct()
    return nucleus.unionByName(qualified)


def channel_pairs(df: DataFrame) -> DataFrame:
    """Ordered pairs of different channels with the label that ratio variables use.

    Every pair of channel levels is the result itself; the levels are distinct before they meet.
    """
    levels = df.select(col(S.CHANNEL).alias("a")).where(F.col("a").isNotNull()).distinct()
    others = levels.agg(F.collect_list("a").alias("all")).scalar()
    return (
        levels.withColumn("b", F.explode(others))
        .where(F.col("a") != F.col("b"))
        .select("a", "b", F.concat(F.lit("Ch"), "a", F.lit(":Ch"), "b").alias("label"))
    )
