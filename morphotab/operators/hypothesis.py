"""Kruskal-Wallis, one-way ANOVA and Pearson reports per facet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab.functions.columns import col, key_struct
from morphotab.functions.nulls import finite, is_finite, safe_ln
from morphotab.functions.skew import join_facets
from morphotab.functions.tails import chi2_p, f_p, p_text, t_p
from morphotab.operators.ranks import MOST, average_rank, key_columns, ranked_values


def kruskal(
    df: DataFrame, value: str, group: str, split: str, most: int = MOST
) -> DataFrame:
    """Kruskal-Wallis test of `value` between the two groups of every facet of `split`.

    Facets with more or fewer than two groups stay in the report with NULL results. The
    corrected p-value is Bonferroni's over the tested facets; a facet whose values are all
    equal counts as tested but has no statistic.
    """
    known = df.where(col(group).isNotNull())
    ranked = ranked_values(known, value, [split], [group], most)
    middle = (F.col("_total") + 1) / F.lit(2.0)
    per_group = ranked.groupBy("_key", col(group)).agg(
        F.max("_total").alias("_total"),
        F.sum("_n").alias("_size"),
        # ranks measured from the middle rank keep their digits however many rows there are
        F.sum(F.col("_n") * (average_rank() - middle)).alias("_shift"),
        F.sum(F.col("_n").cast("double") * (F.pow(F.col("_ties"), 2) - 1)).alias("_tie_sum"),
    )
    n = F.col("_total").cast("double")
    tests = (
        per_group.groupBy("_key")
        .agg(
            F.max("_total").alias("_total"),
            (F.count(F.lit(1)) == 2).alias("_tested"),
            F.sum(F.pow("_shift", 2) / F.col("_size")).alias("_between"),
            F.sum("_tie_sum").alias("_tie_sum"),
        )
        .withColumn("_correction", 1 - F.try_divide(F.col("_tie_sum"), F.pow(n, 3) - n))
        .withColumn(
            "statistic",
            F.when(
                F.col("_tested") & (F.col("_correction") > 0),
                finite(F.try_divide(F.lit(12.0) * F.col("_between"), n * (n + 1) * F.col("_correction"))),
            ),
        )
    )
    # every facet with a value is listed, also when none of its rows has a group
    facets = (
        df.where(is_finite(col(value).cast("double")))
        .select(F.struct(col(split).alias(split)).alias("_key"), col(group).alias("_group"))
        .distinct()
        .groupBy("_key")
        .agg(F.count("_group").alias("_groups"))
    )
    tested = facets.agg(F.count(F.when(F.col("_groups") == 2, F.lit(1))).alias("tested")).scalar()
    report = (
        facets.drop("_groups").join(tests, "_key", "left")
        .withColumn("p_value", chi2_p(F.col("statistic")))
        .withColumn("corrected_p_value", F.least(F.col("p_value") * tested, F.lit(1.0)))
    )
    return report.select(
        *key_columns([split]),
        "statistic",
        F.when(F.col("_tested"), F.col("_total")).alias("n"),
        "p_value",
        "corrected_p_value",
        p_text(F.col("p_value")).alias("p-value"),
        p_text(F.col("corrected_p_value")).alias("corrected p-value"),
    )


def anova(df: DataFrame, value: str, group: str, split: str) -> DataFrame:
    """One-way analysis of variance of `value` between the groups of every facet of `split`."""
    x = finite(col(value).cast("double"))
    sums = (
        df.groupBy(F.struct(col(split).alias(split)).alias("_key"), col(group).alias("_group"))
        .agg(
            F.count(x).alias("_size"),
            F.avg(x).alias("_mean"),
            (F.var_pop(x) * F.count(x)).alias("_within"),
        )
    )
    real = F.col("_group").isNotNull() & (F.col("_size") > 0)
    per_facet = sums.groupBy("_key").agg(
        F.sum(F.when(real, F.col("_size"))).alias("n"),
        F.count(F.when(real, F.lit(1))).alias("_k"),
        F.sum(F.when(real, F.col("_within"))).alias("_ssw"),
        F.sum(F.when(real, F.col("_size") * F.col("_mean"))).alias("_sx"),
    )
    off = F.when(real, F.col("_size") * F.pow(F.col("_mean") - F.col("_sx") / F.col("n"), 2))
    whole = ["n", "_k", "_ssw"]
    per_facet = (
        join_facets(sums, per_facet, F.col("_group").cast("string"))
        .groupBy("_key", "_salt")
        .agg(*[F.max(c).alias(c) for c in whole], F.sum(off).alias("_ssb"))
        .groupBy("_key")
        .agg(*[F.max(c).alias(c) for c in whole], F.sum("_ssb").alias("_ssb"))
    )
    ssb = F.col("_ssb")
    d1, d2 = F.col("_k") - 1, F.col("n") - F.col("_k")
    usable = (F.col("_k") > 1) & (d2 > 0) & (F.col("_ssw") > 0)
    report = (
        per_facet.withColumn("statistic", F.when(usable, finite(F.try_divide(ssb / d1, F.col("_ssw") / d2))))
        .withColumn("p_value", f_p(F.col("statistic"), d1, d2))
        .withColumn("n", F.when(F.col("_k") > 1, F.col("n")))
    )
    return report.select(
        *key_columns([split]), "statistic", "n", "p_value", p_text(F.col("p_value")).alias("p-value")
    )


def pearson(
    df: DataFrame,
    x: str,
    y: str,
    split: Sequence[str],
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
    log_x: bool = False,
    log_y: bool = False,
) -> DataFrame:
    """Pearson correlation of x and y per facet, with its two-sided p-value and the number of points."""
    inside = df
    for name, limits in ((x, x_limits), (y, y_limits)):
        if limits is not None:
            inside = inside.where(col(name).between(*limits))

    def axis(name: str, log: bool) -> Column:
        return finite(safe_ln(col(name)) if log else col(name).cast("double"))

    points = inside.select(
        key_struct(split).alias("_key"), axis(x, log_x).alias("_x"), axis(y, log_y).alias("_y")
    ).where(F.col("_x").isNotNull() & F.col("_y").isNotNull())
    r = F.col("estimate")
    fit = (
        points.groupBy("_key")
        .agg(
            F.covar_pop("_x", "_y").alias("_together"),
            (F.stddev_pop("_x") * F.stddev_pop("_y")).alias("_apart"),
            F.count(F.lit(1)).alias("n"),
        )
        # facets in which x or y is constant have no estimate
        .withColumn("_r", finite(F.try_divide("_together", "_apart")))
        .withColumn("estimate", F.when(F.col("n") >= 3, F.when(F.abs("_r") > 1, F.signum("_r")).otherwise(F.col("_r"))))
    )
    dof = F.col("n") - 2
    t = F.abs(r) * F.sqrt(F.try_divide(dof, F.greatest(1 - r * r, F.lit(0.0))))
    p = F.when(F.abs(r) >= 1, F.lit(0.0)).otherwise(t_p(t, dof))
    report = fit.withColumn("p_value", F.when(r.isNotNull(), p))
    return report.select(
        *key_columns(split), "estimate", "n", "p_value", p_text(F.col("p_value")).alias("p-value")
    )
