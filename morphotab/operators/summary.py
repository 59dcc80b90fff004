"""Profiles of the columns and box-plot summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.functions.columns import categorical_columns, col, key_struct, numeric_columns
from morphotab.functions.nulls import finite, safe_ln
from morphotab.functions.skew import join_facets
from morphotab.operators.ranks import key_columns
from morphotab.operators.select import dedup_group_values, lift_zeros
from morphotab.operators.selection import FINISH, quantiles
from morphotab.sources.shared import written

# The family of a numeric column by its name, first match wins.
# (label, pattern, whether names that begin with Ratio or Group are left to later families)
FAMILIES = [
    ("Intensity variables", "(?i)Intensity", True),
    ("Distance variables", "(?i)Distance", True),
    ("Shape variables", "(?i)Volume|Area|Sphericity|Ellipticity|Circularity|Surface", True),
    ("Ratio variables", "^Ratio", False),
    ("Group variables", "(?i)Group", False),
]
OTHER_FAMILY = "Other variables"


def family(name: Column) -> Column:
    """Label of the family that a variable name belongs to."""
    plain = ~name.rlike("(?i)^(Ratio|Group)")
    label = None
    for text, pattern, only_plain in FAMILIES:
        hit = name.rlike(pattern) & plain if only_plain else name.rlike(pattern)
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return label.otherwise(OTHER_FAMILY)


def _unpivot(summary: DataFrame, names: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """The one-row summary as one row per variable."""
    rows = F.array(
        *[
            F.struct(F.lit(n).alias("Variable"), *[F.col(f"{part}_{i}").alias(part) for part in parts])
            for i, n in enumerate(names)
        ]
    )
    return summary.select(F.explode(rows).alias("v")).select("v.*")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Share of missing values, mean and standard deviation of every numeric column, in one pass."""
    names = list(columns or numeric_columns(df))
    aggs = []
    for i, n in enumerate(names):
        x = finite(col(n).cast("double"))
        aggs += [
            (1 - F.try_divide(F.count(x), F.count(F.lit(1)))).alias(f"missing_{i}"),
            F.avg(x).alias(f"Mean_{i}"),
            F.stddev_samp(x).alias(f"SD_{i}"),
        ]
    out = _unpivot(df.agg(*aggs), names, ["missing", "Mean", "SD"])
    return out.withColumnRenamed("missing", "Missing").withColumn("Family", family(F.col("Variable")))


def profile_categorical(
    df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False
) -> DataFrame:
    """Number of levels and share of missing values of every string column."""
    names = list(columns or categorical_columns(df, with_id=True))
    if approximate:
        aggs = [F.approx_count_distinct(col(n)).alias(f"Levels_{i}") for i, n in enumerate(names)]
        aggs += [
            (1 - F.try_divide(F.count(col(n)), F.count(F.lit(1)))).alias(f"Missing_{i}") for i, n in enumerate(names)
        ]
        return _unpivot(df.agg(*aggs), names, ["Levels", "Missing"])
    # long form first: (variable, level) counts combine map-side, whatever the number of columns
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("Variable"), col(n).alias("level")) for n in names]))
    counts = df.select(pairs.alias("p")).groupBy("p.Variable", "p.level").agg(F.count(F.lit(1)).alias("_n"))
    missing = F.coalesce(F.sum(F.when(F.col("level").isNull(), F.col("_n"))), F.lit(0))
    return counts.groupBy("Variable").agg(
        F.count("level").alias("Levels"), (missing / F.sum("_n")).alias("Missing")
    )


def profile_state(df: DataFrame, by: str, columns: Sequence[str] | None = None) -> DataFrame:
    """What a profile needs of each level of `by`, in a form that adds up: `by`, Variable, and

    rows, known, mean and squares (sum of squared deviations) of numeric columns; rows, known and a distinct-count sketch of
    string columns. Stored for each image, a profile of any set of images is a merge of their states, and adding or
    removing an image reads that image only.
    """
    numeric = [c for c in (columns or numeric_columns(df)) if c in numeric_columns(df)]
    text = [c for c in (columns or categorical_columns(df, with_id=True)) if c in categorical_columns(df, with_id=True)]
    aggs, parts = [], []
    for i, c in enumerate([*numeric, *text]):
        aggs += [F.count(finite(col(c).cast("double")) if c in numeric else col(c)).alias(f"known_{i}")]
        fields = [F.lit(c).alias("Variable"), F.col("_rows").alias("rows"), F.col(f"known_{i}").alias("known")]
        if c in numeric:
            x = finite(col(c).cast("double"))
            aggs += [F.avg(x).alias(f"mean_{i}"), (F.var_pop(x) * F.count(x)).alias(f"squares_{i}")]
            fields += [F.col(f"mean_{i}").alias("mean"), F.col(f"squares_{i}").alias("squares"), F.lit(None).cast("binary").alias("levels")]
        else:
            aggs += [F.hll_sketch_agg(col(c)).alias(f"levels_{i}")]
            fields += [F.lit(None).cast("double").alias("mean"), F.lit(None).cast("double").alias("squares"), F.col(f"levels_{i}").alias("levels")]
        parts.append(F.struct(*fields))
    found = df.groupBy(col(by)).agg(F.count(F.lit(1)).alias("_rows"), *aggs)
    return found.select(col(by), F.explode(F.array(*parts)).alias("p")).select(col(by), "p.*")


def merged_profile(states: DataFrame) -> DataFrame:
    """Profile of all states together: Variable, Missing, Mean, SD of numeric columns, approximate Levels of string columns."""
    valued = F.when(F.col("mean").isNotNull(), F.col("known"))
    # one row for each variable: the centre that the second sum is taken around
    centres = states.groupBy("Variable").agg(F.try_divide(F.sum(valued * F.col("mean")), F.sum(valued)).alias("_centre"))
    around = states.join(written(centres, "centres"), "Variable")
    total = around.groupBy("Variable").agg(
        F.sum("rows").alias("_rows"),
        F.sum("known").alias("_known"),
        F.max("_centre").alias("Mean"),
        F.sum(F.col("squares") + F.col("known") * F.pow(F.col("mean") - F.col("_centre"), 2)).alias("_squares"),
        F.count("levels").alias("_sketches"),
        F.hll_union_agg("levels").alias("_levels"),
    )
    return total.select(
        "Variable",
        (1 - F.try_divide("_known", "_rows")).alias("Missing"),
        "Mean",
        F.when(F.col("_known") > 1, F.sqrt(F.try_divide(F.col("_squares"), F.col("_known") - 1))).alias("SD"),
        F.when(F.col("_sketches") > 0, F.hll_sketch_estimate("_levels")).alias("Levels"),
    )


def boxplot_summary_group(df: DataFrame, value: str, fill: str, split: str, **how) -> DataFrame:
    """Box summary of a variable that repeats its group's value on every object: each group counts once, zeros are lifted."""
    return boxplot_summary(lift_zeros(dedup_group_values(df), value), value, fill, split, **how)


def boxplot_summary(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    limits: tuple[float, float] | None = None,
    log: bool = False,
    digits: int = 3,
    finish: int = FINISH,
) -> DataFrame:
    """Quartiles, mean, whiskers, notches and size of every (split, fill) box."""
    keys = list(dict.fromkeys([split, fill]))
    inside = df.where(col(value).between(*limits)) if limits else df
    x = finite(safe_ln(col(value)) if log else col(value).cast("double"))
    data = inside.select(*[col(k) for k in keys], x.alias("_v")).where(F.col("_v").isNotNull())
    boxes = quantiles(data, "_v", keys, {"Lower": 0.25, "Middle": 0.5, "Upper": 0.75}, finish)
    spread = 1.5 * (F.col("Upper") - F.col("Lower"))
    boxes = boxes.withColumns({"_low": F.col("Lower") - spread, "_high": F.col("Upper") + spread})
    rows = join_facets(data.withColumn("_key", key_struct(keys)), boxes, F.col("_v"))
    inner = F.when(F.col("_v").between(F.col("_low"), F.col("_high")), F.col("_v"))
    quartiles = ["Lower", "Middle", "Upper"]
    stats = (
        rows.groupBy("_key", "_salt")
        .agg(
            *[F.max(q).alias(q) for q in quartiles],
            F.sum("_v").alias("_sum"),
            F.count(F.lit(1)).alias("n"),
            F.min(inner).alias("Whisker Low"),
            F.max(inner).alias("Whisker High"),
        )
        .groupBy("_key")
        .agg(
            *[F.max(q).alias(q) for q in quartiles],
            (F.sum("_sum") / F.sum("n")).alias("Mean"),
            F.sum("n").alias("n"),
            F.min("Whisker Low").alias("Whisker Low"),
            F.max("Whisker High").alias("Whisker High"),
        )
    )
    notch = 1.58 * (F.col("Upper") - F.col("Lower")) / F.sqrt(F.col("n"))
    stats = stats.withColumns(
        {"Notch Low": F.col("Middle") - notch, "Notch High": F.col("Middle") + notch}
    )
    numbers = ["Lower", "Middle", "Mean", "Upper", "Whisker Low", "Whisker High", "Notch Low", "Notch High"]
    return stats.select(*key_columns(keys), *[F.round(c, digits).alias(c) for c in numbers], "n")
