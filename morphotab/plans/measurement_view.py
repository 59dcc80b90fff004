"""A measurement table drawn from the order tables, for queries and benchmarks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphotab import schema as S
from morphotab.sources.shared import stored

DISTANCE = "Distance to Nucleus"
LINES = 1 << 18  # lines a task joins or groups at a time
MEASURES = [S.INTENSITY_SUM, S.INTENSITY_MEAN, S.INTENSITY_STD, S.VOLUME, S.AREA, DISTANCE]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", "s_nationkey", "r_name")
    )


def image_columns() -> dict[str, Column]:
    """Genotype, treatment and image that a supplier stands for."""
    return {
        S.GENOTYPE: F.when(F.col("s_nationkey") % 2 == 0, "WT").otherwise("MUT"),
        S.TREATMENT: F.col("r_name"),
        S.IMAGE: F.concat(F.lit("img_"), F.col("s_suppkey").cast("string")),
    }


def channel_column() -> Column:
    return F.when(F.col("l_linestatus") == "F", "1").otherwise("2").alias(S.CHANNEL)


def object_columns() -> dict[str, Column]:
    return {
        S.CATEGORY: F.when(F.col("p_size") % 2 == 0, "Surface").otherwise("Spot"),
        S.OBJECT: F.col("p_type"),
    }


def _measures() -> list[Column]:
    # prices have two decimals: whole cents add up exactly in any order
    money = F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.lit(100.0)
    return [
        money.alias(S.INTENSITY_SUM),
        (money / F.count(F.lit(1))).alias(S.INTENSITY_MEAN),
        F.round(F.stddev_samp("l_extendedprice"), 6).alias(S.INTENSITY_STD),
        F.sum(F.col("l_quantity").cast("bigint")).cast("double").alias(S.VOLUME),
        F.sum("l_linenumber").cast("double").alias(S.AREA),
    ]


def dealt(df: DataFrame, lines: int, *keys: str) -> DataFrame:
    """The rows by hash of the keys, in partitions of some LINES rows: what a task holds does not grow with the table."""
    return df.repartition(max(1, -(-lines // LINES)), *keys)


def measurement_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (image, object, channel); some images lack a reference object or a centre of mass."""
    lines = table(spark, sf_dir, "lineitem")
    count = lines.count()
    places = suppliers(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    first = [S.GENOTYPE, S.TREATMENT, S.IMAGE, S.CATEGORY, S.OBJECT, S.CHANNEL, S.OBJECT_ID]

    def placed(df: DataFrame) -> DataFrame:
        # a supplier is one image, so its names are joined to the aggregated rows
        return df.join(places, F.col("l_suppkey") == F.col("s_suppkey")).withColumns(image_columns())

    # nearly every group is one line: grouped before they are dealt out, all of a task's groups would be held at once;
    # dealt out by image, they are grouped and get the image's names without moving again
    used = lines.select("l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_linenumber", "l_discount", channel_column())
    typed = dealt(used, count, "l_partkey").join(dealt(parts, count, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    group = ["l_suppkey", "p_type", "p_size", S.CHANNEL]
    grouped = (
        dealt(typed.drop("l_partkey", "p_partkey"), count, "l_suppkey")
        .groupBy(*group)
        .agg(*_measures(), F.min(F.round(F.col("l_discount") * 100)).alias(DISTANCE))
    )
    objects = (
        placed(grouped)
        .withColumns(object_columns())
        .withColumn(S.VOLUME, F.when(F.col("p_size") % 17 != 0, F.col(S.VOLUME)))
        .withColumn(S.OBJECT_ID, F.col("p_size").cast("string"))
        .select(*first, *MEASURES)
    )
    references = (
        placed(
            lines.where(F.col("l_suppkey") % 10 != 0)
            .groupBy("l_suppkey", channel_column())
            .agg(*_measures(), F.lit(0.0).alias(DISTANCE))
        )
        .withColumns({S.CATEGORY: F.lit("Surface"), S.OBJECT: F.lit(S.NUCLEUS), S.OBJECT_ID: F.lit("-1")})
        .select(*first, *MEASURES)
    )
    centers = (
        placed(lines.where(F.col("l_suppkey") % 7 != 3).select("l_suppkey", channel_column()).distinct())
        .withColumns({S.CATEGORY: F.lit("Spot"), S.OBJECT: F.lit(S.CENTER_OF_MASS), S.OBJECT_ID: F.lit("-2")})
        .withColumns({name: F.lit(None).cast("double") for name in MEASURES})
        .select(*first, *MEASURES)
    )
    return objects.unionByName(references).unionByName(centers)


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as a stored table, the usual input of the operators."""
    return stored(spark, f"measurements {sf_dir}", lambda: measurement_view(spark, sf_dir))


# The same view for the SQL side, as common table expressions `base` and `m`.
VIEW_SQL = """
base AS (
  SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'WT' ELSE 'MUT' END AS genotype,
         r_name AS treatment,
         'img_' || CAST(l_suppkey AS VARCHAR) AS image_file,
         CASE WHEN p_size % 2 = 0 THEN 'Surface' ELSE 'Spot' END AS category,
         p_type AS object,
         CASE WHEN l_linestatus = 'F' THEN '1' ELSE '2' END AS channel,
         p_size, l_suppkey, l_extendedprice, l_quantity, l_linenumber, l_discount, l_returnflag
  FROM lineitem
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
m AS (
  SELECT genotype, treatment, image_file, category, object, channel, CAST(p_size AS VARCHAR) AS object_id,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 AS intensity_sum,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*) AS intensity_mean,
         round(stddev_samp(l_extendedprice), 6) AS intensity_stddev,
         CASE WHEN p_size % 17 <> 0 THEN CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) END AS volume,
         CAST(sum(l_linenumber) AS DOUBLE) AS area,
         min(round(l_discount * 100)) AS distance_to_nucleus
  FROM base GROUP BY genotype, treatment, image_file, category, object, channel, p_size
  UNION ALL
  SELECT genotype, treatment, image_file, 'Surface', 'Nucleus', channel, '-1',
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0,
         CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100.0 / count(*),
         round(stddev_samp(l_extendedprice), 6),
         CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE),
         CAST(sum(l_linenumber) AS DOUBLE), 0.0
  FROM base WHERE l_suppkey % 10 <> 0 GROUP BY genotype, treatment, image_file, channel
  UNION ALL
  SELECT DISTINCT genotype, treatment, image_file, 'Spot', 'Nucleus Center of Mass', channel, '-2',
         CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE),
         CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)
  FROM base WHERE l_suppkey % 7 <> 3
)
"""


def with_view(body: str) -> str:
    """A query on `m` (or further common table expressions followed by one)."""
    return f"WITH {VIEW_SQL.strip()}{body}" if body.lstrip().startswith(",") else f"WITH {VIEW_SQL.strip()}\n{body}"
