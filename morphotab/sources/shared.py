"""Intermediate tables in the folder that the cluster shares between its machines."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_stored: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; the warehouse folder where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    base = named or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/morphotab"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def mounted(spark: SparkSession, folder: str) -> str | None:
    """The path of a folder that machines have mounted; None for one in a store that only Hadoop reaches."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    is_file = path.getFileSystem(spark._jsc.hadoopConfiguration()).getScheme() == "file"
    return path.toUri().getPath() if is_file else None


def stored(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Write a table once per application and read it back from then on.

    Cuts the lineage of a table that several reports read, survives the loss of
    executors, and gives the optimiser the table's real size.
    """
    key = (spark.sparkContext.applicationId, name)
    if key not in _stored:
        path = new_folder(spark, "table")
        build().write.parquet(path)
        _stored[key] = path
    return spark.read.parquet(_stored[key])


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once, and of known size to the planner."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
