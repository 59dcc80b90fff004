"""Joining many rows to the few facets they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 16


def join_facets(rows: DataFrame, facets: DataFrame, salt: Column, salts: int = SALTS) -> DataFrame:
    """Inner join on `_key`, with every facet's rows spread over `salts` partitions.

    `facets` has one row per `_key`. A facet may hold a third of all rows, and a later
    aggregation on the same key keeps adaptive execution from splitting it, so the rows
    carry a salt (left in the result as `_salt`) that they can be pre-aggregated by.
    """
    copies = facets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)).cast("int"))
    return salted.join(copies, ["_key", "_salt"])
