"""Small tables for the golden tests."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from morphotab import schema as S

MEASURES = [S.INTENSITY_SUM, S.INTENSITY_MEAN, S.INTENSITY_STD, S.VOLUME, S.AREA, "Distance to Nucleus"]


def frame(spark: SparkSession, names: dict[str, str], rows) -> DataFrame:
    types = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType()}
    schema = T.StructType([T.StructField(n, types[t]) for n, t in names.items()])
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def table(spark: SparkSession, rows) -> DataFrame:
    """rows: (image, category, object, channel, id, measures...)."""
    names = {n: "s" for n in S.KEYS} | {n: "d" for n in MEASURES}
    full = [("WT", "light", r[0], r[1], r[2], r[3], r[4], *r[5:]) for r in rows]
    return frame(spark, names, full)


GOLDEN = [
    ("A", "Surface", "Nucleus", "1", "0", 100.0, 10.0, 2.0, 50.0, 20.0, 0.0),
    ("A", "Spot", "Nucleus Center of Mass", "1", "9", None, None, None, None, None, 5.0),
    ("A", "Surface", "CC", "1", "1", 20.0, 8.0, 1.0, 5.0, 10.0, 1.0),
    ("A", "Surface", "CC", "1", "2", 30.0, 12.0, 3.0, 10.0, 15.0, 2.0),
    ("A", "Surface", "Nucleus", "2", "0", 200.0, 20.0, 4.0, 50.0, 20.0, 0.0),
    ("A", "Surface", "CC", "2", "1", 10.0, 5.0, 1.0, 5.0, 10.0, 1.0),
]


def close(a, b, tol: float = 1e-9) -> bool:
    if a is None or b is None:
        return a is None and b is None
    return math.isclose(a, b, rel_tol=tol, abs_tol=tol)
