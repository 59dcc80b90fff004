"""One query per operator, on the measurement view or on the tables themselves."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphotab import schema as S
from morphotab.functions.columns import col, cols, round_doubles, snake_case
from morphotab.operators import bins, clean, declared, density, hypothesis, outliers, plotdata, quality, ranks, select, summary
from morphotab.operators.catalog import named
from morphotab.operators.derive import Ratios, derive, fill_reference_distance, images_with_reference
from morphotab.plans.measurement_view import DISTANCE, MEASURES, dealt, measurements, suppliers, table
from morphotab.plans.measurement_view import channel_column, image_columns, object_columns
from morphotab.sources import stat_tree, tables
from morphotab.sources.shared import mounted, new_folder, written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

REF = S.NUCLEUS
PAIR = ("1", "2")
ALL_RATIOS = Ratios([PAIR], [PAIR], [PAIR], [PAIR])
SUM_PER_REF = named("Intensity Sum Normalised per {ref}", REF)


def query(fn: Query, name: str | None = None) -> Query:
    """Register a query; its result gets snake_case names and rounded doubles."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return snake_case(round_doubles(fn(spark, sf_dir)))

    QUERIES[name or fn.__name__] = run
    return fn


# -- derived variables -------------------------------------------------------------------------

# query name -> catalogue name
VARIABLES = {
    "norm_sum_ref": "Intensity Sum Normalised per {ref}",
    "norm_mean_ref": "Intensity Mean Normalised per {ref}",
    "norm_std_ref": "Intensity StdDev Normalised per {ref}",
    "norm_distance": "Normalized Distance to {ref}",
    "group_intensity_sum": "Group Intensity Sum",
    "group_intensity_mean": "Group Intensity Mean",
    "signal_density": "Signal Density",
    "norm_sum_group": "Intensity Sum Normalised by Group",
    "norm_mean_group": "Intensity Mean Normalised by Group",
    "norm_std_group": "Intensity StdDev Normalised by Group",
    "object_count": "Object Count",
    "group_sum_rel_ref": "Group Intensity Sum Relative to {ref}",
    "group_mean_rel_ref": "Group Intensity Mean Relative to {ref}",
    "volume_rel_ref": "Volume Relative to {ref}",
    "group_volume": "Group Volume",
    "volume_rel_group": "Volume Relative to Group",
    "group_volume_rel_ref": "Group Volume Relative to {ref}",
    "area_volume": "Surface Area-to-Volume Ratio",
    "group_area": "Group Surface Area",
    "group_area_volume": "Group Surface Area-to-Volume Ratio",
}
RATIO_QUERIES = {
    "ratio_sum": ("sums", "Intensity Sum"),
    "ratio_mean": ("means", "Intensity Mean"),
    "ratio_sum_ref": ("reference_sums", "Intensity Sum Normalised per Nucleus"),
    "ratio_sum_group": ("group_sums", "Intensity Sum Normalised per Group"),
}


def _off_ties(df: DataFrame) -> DataFrame:
    """Averages of few decimal values often end in a rounding tie; both engines move off it."""
    name = "Group Intensity Mean"
    return df.withColumn(name, col(name) + 1e-8) if name in df.columns else df


def _variable(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        full = _off_ties(derive(measurements(spark, sf_dir), [name], REF, only_requested=True))
        return full.select(*cols([*S.KEYS, name]))

    return run


def _ratio(kind: str, of: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        full = derive(measurements(spark, sf_dir), [], REF, {kind: [PAIR]}, only_requested=True)
        return full.select(*cols([*S.KEYS, f"Ratio Ch1:Ch2 of {of}"]))

    return run


for _key, _template in VARIABLES.items():
    query(_variable(named(_template, REF)), _key)
for _key, _args in RATIO_QUERIES.items():
    query(_ratio(*_args), _key)


@query
def derive_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _off_ties(derive(measurements(spark, sf_dir), None, REF, ALL_RATIOS))


OWN_VARIABLES = """{"variables": [
{"name": "Share", "value": {"of": "Intensity Sum"}, "by": {"of": "Intensity Sum", "as": "reference"}},
{"name": "Dense Share", "value": {"of": "Share"}, "by": {"of": "Volume", "as": "total"}},
{"name": "Area of Label", "value": {"of": "Area", "as": "label"}, "by": {"of": "Area"}},
{"name": "Channel Ratio", "value": {"of": "Intensity Mean", "as": "channel", "channel": "1"}, "by": {"of": "Intensity Mean", "as": "channel", "channel": "2"}},
{"name": "Whole Share", "value": {"of": "Share", "as": "total"}}
]}"""


@query
def declared_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's own variables, declared as data."""
    full = declared.derive_declared(measurements(spark, sf_dir), declared.parse_variables(OWN_VARIABLES, REF), reference=REF)
    return full.select(*cols([*S.KEYS, "Dense Share", "Area of Label", "Channel Ratio", "Whole Share"]))


@query
def fill_ref_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_reference_distance(measurements(spark, sf_dir), REF).select(*cols([*S.KEYS, DISTANCE]))


query(lambda spark, sf_dir: images_with_reference(measurements(spark, sf_dir)), "images_with_reference")


# -- sources and sinks -------------------------------------------------------------------------


@query
def import_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A CSV upload with repeated rows, missing channels and the columns in another order."""
    m = measurements(spark, sf_dir)
    raw = m.withColumn(S.CHANNEL, F.when(col(S.TREATMENT) != "ASIA", col(S.CHANNEL)))
    raw = raw.select(*cols([*MEASURES, *reversed(S.KEYS)]))
    path = new_folder(spark, "upload")
    tables.write_table(raw.unionByName(raw), path)
    return tables.read_table(spark, path)


@query
def export_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = [S.IMAGE, S.OBJECT, S.CHANNEL, S.OBJECT_ID, S.VOLUME, S.INTENSITY_MEAN]
    path = new_folder(spark, "export")
    tables.write_table(select.select_columns(measurements(spark, sf_dir), chosen), path)
    schema = tables.table_schema(chosen)
    return spark.read.option("header", True).option("nullValue", "NA").schema(schema).csv(path)


def _write_statistics(rows: DataFrame, root: str, statistics: dict[str, dict[str, Column]]) -> None:
    """One file per image for each statistic, named with the further fields of its rows: preamble, header, rows."""
    spark = rows.sparkSession
    places = [S.GENOTYPE, S.TREATMENT, S.IMAGE]
    tops, lines = {}, {}
    for statistic, more in statistics.items():
        header = [statistic, S.CATEGORY, *more, "Surpass Object", "Time", "ID"]
        fields = [col(statistic), col(S.CATEGORY), *more.values(), col(S.OBJECT), F.lit("1"), col(S.OBJECT_ID)]
        tops[statistic] = [" ", statistic, "=" * 40, ",".join(header)]
        lines[statistic] = F.concat_ws(",", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    image = F.concat(col(S.IMAGE), F.lit("_Statistics")).alias(S.IMAGE)
    rows = rows.select(*cols(places[:-1]), image, *[line.alias(statistic) for statistic, line in lines.items()])
    folder = mounted(spark, root)
    if folder:
        stat_tree.write_stat_files(rows, folder, places, {statistic: "\n".join(top) + "\n" for statistic, top in tops.items()})
        return
    for statistic, top in tops.items():
        _write_by_spark(rows.select(*cols(places), F.lit(4).alias("_no"), col(statistic).alias("line")), root, places, top)


def _write_by_spark(body: DataFrame, root: str, places: list[str], top: list[str]) -> None:
    """The same for one statistic in a store that only Hadoop reaches."""
    numbered = F.array(*[F.struct(F.lit(i).alias("_no"), F.lit(t).alias("line")) for i, t in enumerate(top)])
    head = body.select(*cols(places)).distinct().select(*cols(places), F.explode(numbered).alias("t")).select(*cols(places), "t.*")
    (
        body.unionByName(head)
        .repartition(*cols(places))
        .sortWithinPartitions(*cols(places), "_no")
        .drop("_no")
        .write.mode("append")
        .partitionBy(*places)
        .option("quote", "\u0000")
        .option("sep", "\u0001")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(root)
    )


@query
def read_stat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view written as a tree of statistics files, and read back from it."""
    m = measurements(spark, sf_dir)
    root = new_folder(spark, "tree")
    channel = {S.CHANNEL: col(S.CHANNEL)}
    _write_statistics(m, root, {S.INTENSITY_SUM: channel, S.INTENSITY_MEAN: channel})
    distance = "Shortest Distance to Surfaces"
    per_object = m.groupBy(*cols(S.OBJECT_KEYS)).agg(F.max(col(S.VOLUME)).alias(S.VOLUME), F.min(col(DISTANCE)).alias(distance))
    _write_statistics(per_object, root, {S.VOLUME: {}, distance: {"Surfaces": F.lit(REF)}})
    cleaned = stat_tree.read_stat_tree(spark, root)
    # the writer names folders key=value
    plain = {c: F.regexp_replace(col(c), "^[^=]*=", "") for c in (S.GENOTYPE, S.TREATMENT, S.IMAGE)}
    return cleaned.withColumns(plain)


@query
def skip_small_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(
        F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"),
        F.octet_length("text").cast("bigint").alias("size"),
    )
    return stat_tree.skip_small_files(files, "size")


@query
def skip_listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for files; page and part names are as in a statistics folder."""
    pages = table(spark, sf_dir, "pages")
    names = F.array(*[F.lit(t) for t in ("Diameter_X.csv", "Volume.csv", "Position.csv", "Area.csv", "Time_Index.csv")])
    path = F.concat(F.col("url"), F.lit("/img_"), F.get(names, (F.col("page_id") % 5).cast("int")))
    return stat_tree.skip_listed_files(pages.select("page_id", path.alias("path")), "path")


@query
def path_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    parts = stat_tree.path_metadata(F.col("url"))
    return pages.select("page_id", *[c.alias(n) for n, c in parts.items()])


# -- harmonisation -----------------------------------------------------------------------------

SOURCE = "source"


def _statistic_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view split into the rows of one table per statistic, as the files of the images hold them; the view is read once."""
    m = measurements(spark, sf_dir)
    no_channel = F.lit(None).cast("string")
    of_channel = {name: (col(S.CHANNEL), f"{name}_Ch=") for name in (S.INTENSITY_SUM, S.INTENSITY_MEAN, S.INTENSITY_STD)}
    of_object = {name: (no_channel, f"{name}_from_") for name in (S.VOLUME, S.AREA, DISTANCE)}
    tables = of_channel | of_object
    rows = [
        F.struct(
            channel.alias(S.CHANNEL),
            *[(col(n) if n == name else F.lit(None).cast("double")).alias(n) for n in tables],
            F.concat(F.lit(path), col(S.CHANNEL)).alias(SOURCE),
        )
        for name, (channel, path) in tables.items()
    ]
    return m.select(*cols(S.OBJECT_KEYS), F.explode(F.array(*rows)).alias("row")).select(*cols(S.OBJECT_KEYS), "row.*")


# how a line names a neighbour, by the column that holds the name
NEIGHBOURS = {
    clean.SURFACES: (S.SURFACE_STATISTICS[0], F.col, "l_returnflag"),
    clean.SPOTS: (S.SPOT_STATISTIC, lambda c: (F.col(c) % 3).cast("string"), "l_linenumber"),
}


def _prices(spark: SparkSession, sf_dir: str, *kinds: str) -> DataFrame:
    """Lowest price per object and label, standing for a distance to a named neighbour; for all kinds, lines move once."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_extendedprice", *[NEIGHBOURS[k][2] for k in kinds])
    count = lines.count()
    typed = dealt(lines, count, "l_partkey").join(dealt(parts, count, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    labels = [F.struct(F.lit(k).alias("kind"), NEIGHBOURS[k][1](NEIGHBOURS[k][2]).alias("label")) for k in kinds]
    lowest = (
        dealt(typed.drop("l_partkey", "p_partkey"), count, "l_suppkey")
        .select("l_suppkey", "p_type", "p_size", "l_extendedprice", F.inline(F.array(*labels)))
        .groupBy("l_suppkey", "p_type", "p_size", "kind", "label")
        .agg(F.min("l_extendedprice").alias("price"))
    )
    named = {k: (F.col("kind") == k, NEIGHBOURS[k][0]) for k in kinds}
    statistic = F.coalesce(*[F.when(found, F.lit(statistic)) for found, statistic in named.values()])
    return (
        lowest.join(suppliers(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey"))
        .withColumns({**image_columns(), **object_columns(), S.OBJECT_ID: F.col("p_size").cast("string")})
        .select(
            *cols(S.OBJECT_KEYS),
            F.lit(None).cast("string").alias(S.CHANNEL),
            *[c for k, (found, name) in named.items() for c in (F.when(found, F.col("label")).alias(k), F.when(found, F.col("price")).alias(name))],
            F.concat(statistic, F.lit("_"), F.col("label")).alias(SOURCE),
        )
    )


@query
def harmonise(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the prices are read for the names of the neighbours and for the values, so they are computed once
    prices = written(_prices(spark, sf_dir, clean.SURFACES, clean.SPOTS), "prices")
    return clean.harmonise(clean.union_rows([_statistic_rows(spark, sf_dir), prices]), order_by=SOURCE, few_sources=True)


@query
def coalesce_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.coalesce_rows(_statistic_rows(spark, sf_dir), S.KEYS, SOURCE)


def _with_unnamed(rows: DataFrame, by: str, statistic: str) -> DataFrame:
    """The rows, and as many without a neighbour, as an outer join of files leaves them."""
    blank = rows.withColumn(by, F.lit(None).cast("string")).withColumn(statistic, F.lit(None).cast("double"))
    return rows.unionByName(blank)


@query
def pivot_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_unnamed(_prices(spark, sf_dir, clean.SURFACES), clean.SURFACES, S.SURFACE_STATISTICS[0])
    return clean.pivot_surfaces(rows, S.OBJECT_KEYS)


@query
def pivot_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.pivot_spots(_with_unnamed(_prices(spark, sf_dir, clean.SPOTS), clean.SPOTS, S.SPOT_STATISTIC), S.OBJECT_KEYS)


@query
def unify_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    spelled = F.when(col(S.CHANNEL) == "1", "Nucleus_centre_of_mass").otherwise("Nucleus center of mass")
    label = F.when(col(S.OBJECT) == S.CENTER_OF_MASS, spelled).otherwise(col(S.OBJECT))
    return clean.unify_labels(m.withColumn(S.OBJECT, label)).select(*cols(S.KEYS))


@query
def fill_down_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir).select(*cols([*S.KEYS, S.VOLUME, S.AREA]))
    gaps = m.withColumns(
        {
            S.VOLUME: F.when(col(S.CHANNEL) == "1", col(S.VOLUME)),
            S.AREA: F.when(col(S.CHANNEL) == "2", col(S.AREA)),
        }
    )
    return clean.fill_down_up(gaps, S.OBJECT_KEYS, [S.VOLUME, S.AREA], [S.CHANNEL])


@query
def neighbour_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average distances to neighbours, as text, get their short names and become numbers."""
    m = measurements(spark, sf_dir)
    text = {3: col(S.VOLUME).cast("string"), 5: F.when(col(S.CHANNEL) == "1", col(S.AREA).cast("string")).otherwise("none"), 9: F.lit(None).cast("string")}
    named = {f"Average Distance To {k} Nearest Neighbours": c for k, c in text.items()}
    return clean.rename_neighbour_distances(m.select(*cols(S.KEYS), *[c.alias(n) for n, c in named.items()]))


# -- integrity ---------------------------------------------------------------------------------

query(lambda spark, sf_dir: quality.unexpected_labels(measurements(spark, sf_dir)), "unexpected_labels")
query(
    lambda spark, sf_dir: quality.images_without_object(measurements(spark, sf_dir), S.CENTER_OF_MASS),
    "images_without_com",
)
query(
    lambda spark, sf_dir: quality.images_without_object(measurements(spark, sf_dir), S.NUCLEUS),
    "images_without_ref",
)
query(lambda spark, sf_dir: quality.channel_pairs(measurements(spark, sf_dir)), "channel_pairs")


@query
def images_with_null_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.images_with_null_column(derive(measurements(spark, sf_dir), [SUM_PER_REF]))


@query
def null_channel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    channel = (
        F.when(col(S.TREATMENT) == "ASIA", F.lit("NA"))
        .when(col(S.TREATMENT) == "EUROPE", F.lit(None).cast("string"))
        .otherwise(col(S.CHANNEL))
    )
    return quality.null_channel_rows(m.withColumn(S.CHANNEL, channel))


@query
def integrity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five reports from one pass, in long form; objects without a channel as often as they occur."""
    m = measurements(spark, sf_dir)
    channel = F.when(col(S.TREATMENT) == "ASIA", F.lit("NA")).when(col(S.TREATMENT) != "EUROPE", col(S.CHANNEL))
    area = F.when(col(S.OBJECT) != "PROMO", col(S.AREA))
    checked = m.withColumns({S.CHANNEL: channel, S.AREA: area, S.VOLUME: F.when(~col(S.IMAGE).endswith("7"), col(S.VOLUME))})
    found = quality.Integrity(checked)
    reports = {
        "label": found.unexpected_labels().select(col(S.IMAGE), col(S.OBJECT).alias("detail")),
        "no centre of mass": found.images_without_object(S.CENTER_OF_MASS),
        "no reference": found.images_without_object(REF),
        "empty column": found.images_with_null_column(),
        "no channel": found.null_channel_rows().select(col(S.IMAGE), col(S.OBJECT_ID).alias("detail")),
    }
    out = clean.union_rows([df.withColumn("report", F.lit(name)) for name, df in reports.items()])
    return out.select("report", col(S.IMAGE), "detail")


@query
def eligible_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measurements(spark, sf_dir)
    envelope = m.where(col(S.OBJECT) == S.NUCLEUS).withColumn(S.OBJECT, F.lit("Envelope"))
    return quality.eligible_references(m.unionByName(envelope))


# -- selection ---------------------------------------------------------------------------------


@query
def select_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = {
        S.OBJECT: ["PROMO", "LARGE", S.NUCLEUS],
        S.TREATMENT: ["ASIA", "AFRICA"],
        S.GENOTYPE: ["WT"],
        S.CHANNEL: ["1"],
    }
    return select.select_levels(measurements(spark, sf_dir), chosen)


@query
def select_many_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images chosen by a table, and objects by a list too long for a predicate."""
    rich = table(spark, sf_dir, "supplier").where("s_acctbal > 3000").select(F.concat(F.lit("img_"), F.col("s_suppkey")))
    ids = [str(k) for k in range(0, 100_000, 2)]
    return select.select_levels(measurements(spark, sf_dir), {S.IMAGE: rich, S.OBJECT_ID: ids, S.CHANNEL: ["1"]})


@query
def select_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.select_numeric(measurements(spark, sf_dir), [S.VOLUME, S.INTENSITY_SUM])


@query
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.range_filter(measurements(spark, sf_dir), S.VOLUME, 20.0, 80.0)


@query
def range_filter_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.range_filter(measurements(spark, sf_dir), S.VOLUME, 20.0, 80.0, channel="1")


@query
def rect_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.rect_filter(measurements(spark, sf_dir), S.VOLUME, S.AREA, (20.0, 80.0), (3.0, 9.0))


@query
def finite_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.finite_range(measurements(spark, sf_dir), MEASURES)


@query
def lift_zeros(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.lift_zeros(measurements(spark, sf_dir), DISTANCE).select(*cols([*S.KEYS, DISTANCE]))


@query
def dedup_group_vars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.dedup_group_values(derive(measurements(spark, sf_dir), ["Group Volume"]))


@query
def level_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.level_lists(measurements(spark, sf_dir), [S.OBJECT, S.IMAGE, S.TREATMENT, S.GENOTYPE, S.CHANNEL])


@query
def bin_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.bin_thresholds(measurements(spark, sf_dir), S.VOLUME, "20, 50, 100").select(
        *cols([*S.KEYS, S.VOLUME, "Bin Order", bins.bin_column(S.VOLUME)])
    )


@query
def sample_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.sample_points(measurements(spark, sf_dir), S.KEYS, 0.3)


@query
def sample_exactly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.sample_exactly(measurements(spark, sf_dir), [S.OBJECT, S.CHANNEL], S.KEYS, points=500)


# -- profiles and tests ------------------------------------------------------------------------


@query
def profile_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = ["Group Volume", SUM_PER_REF, "Object Count"]
    full = derive(measurements(spark, sf_dir), wanted, REF, Ratios([PAIR]))
    return summary.profile_numeric(full)


@query
def profile_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The profile of all images but those of one genotype, from states kept for each image."""
    m = measurements(spark, sf_dir)
    kept = summary.profile_state(m, S.IMAGE, MEASURES).join(m.where(col(S.GENOTYPE) == "WT").select(col(S.IMAGE)).distinct(), S.IMAGE, "left_semi")
    return summary.merged_profile(kept).drop("Levels")


@query
def profile_categorical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.profile_categorical(measurements(spark, sf_dir))


@query
def boxplot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summary.boxplot_summary(measurements(spark, sf_dir), S.INTENSITY_MEAN, S.GENOTYPE, S.OBJECT, digits=6)


@query
def boxplot_summary_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = derive(measurements(spark, sf_dir), ["Group Volume"])
    return summary.boxplot_summary_group(full, "Group Volume", S.GENOTYPE, S.OBJECT, digits=6)


query(lambda spark, sf_dir: outliers.outliers(measurements(spark, sf_dir), S.VOLUME), "outliers")


@query
def remove_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.remove_outliers(measurements(spark, sf_dir), S.VOLUME)


@query
def avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranks.average_ranks(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"])


@query
def avg_rank_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks from some hundreds of ranges."""
    return ranks.average_ranks(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], most=20)


@query
def kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = hypothesis.kruskal(measurements(spark, sf_dir), S.INTENSITY_MEAN, S.GENOTYPE, S.OBJECT)
    return report.withColumnsRenamed({"p-value": "p_text", "corrected p-value": "corrected_p_text"})


@query
def kruskal_fine(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = hypothesis.kruskal(measurements(spark, sf_dir), S.INTENSITY_MEAN, S.GENOTYPE, S.OBJECT, most=20)
    return report.withColumnsRenamed({"p-value": "p_text", "corrected p-value": "corrected_p_text"})


@query
def anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = hypothesis.anova(measurements(spark, sf_dir), S.INTENSITY_MEAN, S.TREATMENT, S.OBJECT)
    return report.withColumnRenamed("p-value", "p_text")


@query
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = hypothesis.pearson(
        measurements(spark, sf_dir), S.INTENSITY_MEAN, DISTANCE, [S.OBJECT, S.CHANNEL], y_limits=(1.0, 10.0)
    )
    return report.withColumnRenamed("p-value", "p_text")


@query
def pearson_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = hypothesis.pearson(measurements(spark, sf_dir), S.INTENSITY_MEAN, DISTANCE, [S.OBJECT, S.CHANNEL])
    return report.withColumnRenamed("p-value", "p_text")


# -- plots -------------------------------------------------------------------------------------


@query
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.histogram(measurements(spark, sf_dir), S.INTENSITY_MEAN, S.CHANNEL, S.OBJECT)


@query
def histogram_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.histogram_percent(
        measurements(spark, sf_dir), S.INTENSITY_MEAN, S.CHANNEL, S.OBJECT, free_x=True
    )


@query
def kde(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micro(density.kde(measurements(spark, sf_dir), S.VOLUME, S.GENOTYPE, S.OBJECT))


@query
def kde_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.binned_percent(measurements(spark, sf_dir), S.VOLUME, S.GENOTYPE, S.OBJECT, limits=(0.0, 200.0))


@query
def violin(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = measurements(spark, sf_dir)
    return _micro(density.violin(data, S.VOLUME, S.GENOTYPE, S.TREATMENT, limits=(0.0, 200.0)))


@query
def density2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = measurements(spark, sf_dir)
    return _micro(density.density2d(data, S.VOLUME, S.AREA, S.GENOTYPE, (0.0, 200.0), (0.0, 30.0)))


@query
def kde_pct_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.binned_percent(measurements(spark, sf_dir), S.VOLUME, S.GENOTYPE, S.OBJECT)


@query
def violin_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micro(density.violin(measurements(spark, sf_dir), S.VOLUME, S.GENOTYPE, S.TREATMENT))


@query
def density2d_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _micro(density.density2d(measurements(spark, sf_dir), S.VOLUME, S.AREA, S.GENOTYPE))


@query
def density_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper end of an automatic density axis, in millionths."""
    peak = density.density_peak(measurements(spark, sf_dir), S.VOLUME, S.GENOTYPE)
    return peak.withColumn("Max", col("Max") * 1e6)


@query
def joint_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Automatic ranges of a scatter plot: over the rows that have both variables."""
    return select.finite_range(measurements(spark, sf_dir), [S.VOLUME, S.INTENSITY_MEAN], jointly=True)


def _micro(df: DataFrame) -> DataFrame:
    """Densities in millionths, so that rounding keeps their digits."""
    return df.withColumn("density", F.col("density") * 1e6)


@query
def scatter_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plotdata.scatter_data(
        measurements(spark, sf_dir), S.INTENSITY_MEAN, DISTANCE, S.OBJECT, (1e4, 6e4), (0.0, 8.0), S.CHANNEL
    )


@query
def plot_data_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = derive(measurements(spark, sf_dir), ["Group Volume"])
    return plotdata.plot_data_1d(full, "Group Volume", S.CHANNEL, S.OBJECT, (0.0, 2000.0))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise to the nucleus, relate groups to it, and summarise per genotype and object."""
    wanted = [SUM_PER_REF, "Group Intensity Sum", named("Group Intensity Sum Relative to {ref}", REF)]
    full = derive(measurements(spark, sf_dir), wanted)
    return snake_case(summary.boxplot_summary_group(full, wanted[-1], S.GENOTYPE, S.OBJECT))


