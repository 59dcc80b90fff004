"""Derived variables: reference-, group- and channel-normalised measurements.

Shape of the plan, whatever the number of variables:

1. one aggregation of the table to (image, channel, category, object) groups,
   with map-side combine, so a huge image or group costs no task more than another;
2. windows over that small group table for reference values and group totals;
3. for channel ratios, one row per object with a map from channel to values;
4. the object and then the group values are joined back, each on one NULL-safe struct key
   that holds the key columns meanwhile, and only the values that variables read are carried;
   every variable is a plain projection of the joined row.

The joins are ordinary equi-joins: adaptive execution broadcasts a side once its
measured size allows it and splits skewed partitions otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache, partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphotab import schema as S
from morphotab.functions.columns import col, cols, key_struct, partition
from morphotab.functions.nulls import finite, strict_avg, strict_sum
from morphotab.operators.catalog import available_variables, with_prerequisites

GROUP = [S.IMAGE, S.CHANNEL, S.CATEGORY, S.OBJECT]
OBJECT_GROUP = [S.IMAGE, S.OBJECT_ID, S.OBJECT, S.CATEGORY]

Pair = tuple[str, str]


@dataclass(frozen=True)
class Ratios:
    """Ordered channel pairs per kind of ratio."""

    sums: Sequence[Pair] = field(default_factory=tuple)
    means: Sequence[Pair] = field(default_factory=tuple)
    reference_sums: Sequence[Pair] = field(default_factory=tuple)
    group_sums: Sequence[Pair] = field(default_factory=tuple)

    def __bool__(self) -> bool:
        return bool(self.sums or self.means or self.reference_sums or self.group_sums)


def parse_pair(text: str) -> Pair:
    """'1, 2' -> ('1', '2')."""
    a, b = (part.strip() for part in text.split(","))
    return a, b


def ratio_name(pair: Pair, of: str) -> str:
    return f"Ratio Ch{pair[0]}:Ch{pair[1]} of {of}"


def distance_column(df: DataFrame, reference: str) -> str | None:
    """The column with the distance to the reference surface, under either of its names."""
    for name in (f"Distance to {reference}", f"Shortest Distance to Surfaces - {reference}"):
        if name in df.columns:
            return name
    return None


def fill_reference_distance(df: DataFrame, reference: str, distance: str | None = None) -> DataFrame:
    """Set a missing distance of a centre-of-mass object to 1."""
    name = distance or distance_column(df, reference)
    if name is None:
        return df
    gap = (col(S.OBJECT) == S.CENTER_OF_MASS) & col(name).isNull()
    return df.withColumn(name, F.when(gap, F.lit(1.0)).otherwise(col(name)))


def _has_center(df: DataFrame) -> Column:
    """Whether the table holds any centre-of-mass object, as a scalar subquery."""
    return df.agg(F.coalesce(F.max(col(S.OBJECT) == S.CENTER_OF_MASS), F.lit(False)).alias("any_center")).scalar()


def images_with_reference(df: DataFrame) -> DataFrame:
    """Keep images with a centre-of-mass object, and rows with a channel; all rows if no image has one."""
    any_center = _has_center(df)
    images = (
        df.where(col(S.OBJECT) == S.CENTER_OF_MASS)
        .select(F.struct(col(S.IMAGE)).alias("_image"))
        .distinct()
        .withColumn("_center", F.lit(True))
    )
    marked = df.withColumn("_image", F.struct(col(S.IMAGE))).join(images, "_image", "left")
    keep = ~any_center | (F.coalesce(F.col("_center"), F.lit(False)) & (col(S.CHANNEL) != S.MISSING_CHANNEL))
    return marked.where(keep).select(*[col(c) for c in df.columns])


def _only(values: Column, hits: Column) -> Column:
    """A reference value counts only if exactly one row carries it."""
    return F.when(hits == 1, values)


def _channel() -> Column:
    return col(S.CHANNEL).cast("string")


def _with_values(df: DataFrame, keys: Sequence[str], key: str, values: DataFrame) -> DataFrame:
    """Left join on the struct `key`; the rows carry their key columns in it alone."""
    rest = [c for c in df.columns if c not in keys]
    found = df.select(key_struct(keys).alias(key), *cols(rest)).join(values, key, "left")
    own = [F.col(key).getField(c).alias(c) if c in keys else col(c) for c in df.columns]
    return found.select(*own, *cols([c for c in values.columns if c != key]))


class _Plan:
    """Collects which group and object values the requested variables read."""

    def __init__(self, df: DataFrame, reference: str | None, distance: str | None):
        self.df = df
        self.reference = reference
        self.distance = distance
        self.group_aggs: dict[str, Column] = {"_n": F.count(F.lit(1))}
        self.group_windows: dict[str, Column] = {}
        self.object_names: list[str] = []
        self.group_lookups: dict[str, Column] = {}
        self.object_lookups: dict[str, Column] = {}
        self.levels: list[dict[str, Column]] = [{}, {}, {}]

    def quotient(self, key: str, x: Column, y: Column, level: int = 0) -> Column:
        """A finite quotient; level n may read the quotients of levels below n.

        Each level becomes its own projection, so a quotient is computed once however
        often it is read, and the generated code stays in small, compilable methods.
        """
        key = f"_q_{key}"
        self.levels[level][key] = F.try_divide(x, y)
        return col(key)

    # -- values of the (image, channel, category, object) group ------------------------------

    def total(self, name: str) -> Column:
        key = f"_total_{name}"
        self.group_aggs[key] = strict_sum(col(name))
        return col(key)

    def average(self, name: str) -> Column:
        key = f"_average_{name}"
        self.group_aggs[key] = strict_avg(col(name))
        return col(key)

    # -- values found by looking across the groups of an image -------------------------------

    def object_count(self) -> Column:
        w = partition([S.IMAGE, S.OBJECT, S.CHANNEL])
        self.group_windows["_object_count"] = F.sum("_n").over(w)
        return F.col("_object_count")

    def label_total(self, name: str) -> Column:
        """Strict total over (image, object, channel), i.e. across categories."""
        self.total(name)
        key = f"_label_total_{name}"
        w = partition([S.IMAGE, S.OBJECT, S.CHANNEL])
        part = col(f"_total_{name}")
        self.group_windows[key] = F.when(
            F.count(part).over(w) == F.count(F.lit(1)).over(w), F.sum(part).over(w)
        )
        return col(key)

    def _single(self, name: str, key: str, cond: Column) -> Column:
        self.group_aggs[f"_max_{name}"] = F.max(col(name))
        w = partition([S.IMAGE, S.CHANNEL])
        hits = F.sum(F.when(cond, F.col("_n"))).over(w)
        self.group_windows[key] = _only(F.max(F.when(cond, col(f"_max_{name}"))).over(w), hits)
        return col(key)

    def reference_value(self, name: str) -> Column:
        return self._single(name, f"_ref_{name}", col(S.OBJECT) == self.reference)

    def surface_value(self, name: str) -> Column:
        cond = (col(S.OBJECT) == self.reference) & (col(S.CATEGORY) == S.SURFACE)
        return self._single(name, f"_surface_{name}", cond)

    def center_value(self, name: str) -> Column:
        return self._single(name, f"_center_{name}", col(S.OBJECT) == S.CENTER_OF_MASS)

    def has_center(self) -> Column:
        self.group_windows["_has_center"] = F.max(col(S.OBJECT) == S.CENTER_OF_MASS).over(partition([S.IMAGE]))
        return F.col("_has_center")

    def in_channel(self, value: Column, key: str, channel: str, keys: Sequence[str]) -> Column:
        """A group-level value of another channel of the same image.

        One map from channel to value serves all channels; the value is the same in all rows of a channel in the window.
        """
        name = f"{key}@"
        entry = F.when(col(S.CHANNEL).isNotNull(), F.struct(_channel().alias("c"), value.alias("v")))
        self.group_windows[name] = F.map_from_entries(F.collect_set(entry).over(partition(keys)))
        self.group_lookups[f"{name}{channel}"] = F.try_element_at(col(name), F.lit(channel))
        return col(f"{name}{channel}")

    # -- values of the object across channels ------------------------------------------------

    def object_value(self, name: str, channel: str) -> Column:
        """The object's value in a channel that it has one row of."""
        if name not in self.object_names:
            self.object_names.append(name)
        here = F.try_element_at(F.col("_channels"), F.lit(channel))
        key = f"_object_{name}@{channel}"
        self.object_lookups[key] = _only(here[f"v{self.object_names.index(name)}"], here["n"])
        return col(key)

    def objects(self) -> DataFrame:
        """One row per object with a map from channel to its number of rows and its values.

        An object's rows are first reduced to one for each channel, so what is gathered is bounded by the channels.
        """
        values = [F.max(col(name)).alias(f"v{k}") for k, name in enumerate(self.object_names)]
        keys = [key_struct(OBJECT_GROUP).alias("_object"), _channel().alias("c")]
        cells = self.df.where(col(S.CHANNEL).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *values)
        entry = F.struct("c", F.struct("n", *[f"v{k}" for k in range(len(values))]))
        return cells.groupBy("_object").agg(F.map_from_entries(F.collect_list(entry)).alias("_channels"))

    # -- the joined table ---------------------------------------------------------------------

    def groups(self) -> DataFrame:
        aggs = [value.alias(key) for key, value in self.group_aggs.items()]
        table = self.df.groupBy(*[col(c) for c in GROUP]).agg(*aggs)
        if self.group_windows:
            # every window below partitions by the image and more: one exchange serves them all
            table = table.repartition(col(S.IMAGE))
            own = {k: v for k, v in self.group_windows.items() if "@" not in k}
            across = {k: v for k, v in self.group_windows.items() if "@" in k}
            table = table.withColumns(own) if own else table
            if across:  # the maps stay on this side of the join
                table = table.withColumns(across).withColumns(self.group_lookups).drop(*across)
        return table.withColumn("_group", key_struct(GROUP)).drop(*GROUP)

    def joined(self) -> DataFrame:
        out = self.df
        if self.object_names:
            out = _with_values(out, OBJECT_GROUP, "_object", self.objects()).withColumns(self.object_lookups).drop("_channels")
        out = _with_values(out, GROUP, "_group", self.groups())
        for level in self.levels:
            if level:
                out = out.withColumns(level)
                out = out.withColumns({key: finite(col(key)) for key in level})
        return out


def _ratio_columns(plan: _Plan, ratios: Ratios, columns: Sequence[str]) -> dict[str, Column]:
    out: dict[str, Column] = {}

    def put(pair: Pair, of: str, values, level: int) -> None:
        name = ratio_name(pair, of)
        if S.MISSING_CHANNEL in pair:
            out[name] = F.lit(None).cast("double")
        else:
            value = plan.quotient(name, values(pair[0]), values(pair[1]), level)
            out[name] = F.when(col(S.CHANNEL).isin(*pair), value)

    of_object = {n: cache(partial(plan.object_value, n)) for n in (S.INTENSITY_SUM, S.INTENSITY_MEAN)}
    for pairs, name in ((ratios.sums, S.INTENSITY_SUM), (ratios.means, S.INTENSITY_MEAN)):
        if name in columns:
            for pair in pairs:
                put(pair, name, of_object[name], 0)

    if plan.reference and S.INTENSITY_SUM in columns:
        name = S.INTENSITY_SUM

        def reference_in(channel: str) -> Column:
            return plan.in_channel(plan.reference_value(name), f"_ref_{name}", channel, [S.IMAGE])

        @cache
        def per_reference(channel: str) -> Column:
            return plan.quotient(f"ref@{channel}", of_object[name](channel), reference_in(channel))

        @cache
        def per_group(channel: str) -> Column:
            total = plan.in_channel(plan.label_total(name), f"_label_total_{name}", channel, [S.IMAGE, S.OBJECT])
            whole = plan.quotient(f"whole@{channel}", total, reference_in(channel))
            return plan.quotient(f"group@{channel}", per_reference(channel), whole, 1)

        for pair in ratios.reference_sums:
            put(pair, f"Intensity Sum Normalised per {plan.reference}", per_reference, 1)
        for pair in ratios.group_sums:
            put(pair, "Intensity Sum Normalised per Group", per_group, 2)
    return out


def derive(
    df: DataFrame,
    variables: Iterable[str] | None = None,
    reference: str | None = S.NUCLEUS,
    ratios: Ratios | Mapping[str, Sequence[Pair]] | None = None,
    distance: str | None = None,
    only_requested: bool = False,
) -> DataFrame:
    """Add derived variables to a cleaned table.

    `variables` are catalogue names (all available ones by default); prerequisites
    are added automatically. A variable whose input column is absent is skipped.
    `reference` is the object that measurements are normalised to, or None.
    `distance` names the distance column; by default it is looked up.
    """
    ratios = Ratios(**ratios) if isinstance(ratios, Mapping) else (ratios or Ratios())
    asked = list(available_variables(reference) if variables is None else variables)
    wanted = asked if only_requested else with_prerequisites(asked, reference)
    if not only_requested and reference:
        if ratios.reference_sums or ratios.group_sums:
            wanted = with_prerequisites([*wanted, f"Intensity Sum Normalised per {reference}"], reference)
        if ratios.group_sums:
            wanted = with_prerequisites([*wanted, "Intensity Sum Normalised by Group"], reference)

    any_center = _has_center(df)
    have = set(df.columns)
    distance = distance or (distance_column(df, reference) if reference else None)
    if reference and distance in have:
        df = fill_reference_distance(df, reference, distance)

    plan = _Plan(df, reference, distance)
    out: dict[str, Column] = {}

    def put(name: str, inputs: Sequence[str], value) -> None:
        if name in wanted and have.issuperset(inputs):
            out[name] = value()

    ref = reference

    def over(name: str, x: Column, y: Column, level: int = 0) -> Column:
        return plan.quotient(name, x, y, level)

    def per_reference(name: str) -> Column:
        return over(f"{name} per ref", col(name), plan.reference_value(name))

    def by_group(name: str) -> Column:
        whole = over(f"{name} of label", plan.label_total(name), plan.reference_value(name))
        return over(f"{name} by group", per_reference(name), whole, 1)

    if ref:
        for name in (S.INTENSITY_SUM, S.INTENSITY_MEAN, S.INTENSITY_STD):
            put(f"{name} Normalised per {ref}", [name], lambda name=name: per_reference(name))
            put(f"{name} Normalised by Group", [name], lambda name=name: by_group(name))
        if distance:
            put(
                f"Normalized Distance to {ref}",
                [distance],
                lambda: over("distance", col(distance), plan.center_value(distance)),
            )
        put(
            "Signal Density",
            [S.INTENSITY_SUM, S.VOLUME],
            lambda: over("density", per_reference(S.INTENSITY_SUM), col(S.VOLUME), 1),
        )
        for label, name, value in (
            ("Group Intensity Sum", S.INTENSITY_SUM, plan.total),
            ("Group Intensity Mean", S.INTENSITY_MEAN, plan.average),
            ("Volume", S.VOLUME, col),
            ("Group Volume", S.VOLUME, plan.total),
        ):
            put(
                f"{label} Relative to {ref}",
                [name],
                lambda label=label, name=name, value=value: over(label, value(name), plan.surface_value(name)),
            )
    put("Group Intensity Sum", [S.INTENSITY_SUM], lambda: plan.total(S.INTENSITY_SUM))
    put("Group Intensity Mean", [S.INTENSITY_MEAN], lambda: plan.average(S.INTENSITY_MEAN))
    put("Group Volume", [S.VOLUME], lambda: plan.total(S.VOLUME))
    put("Group Surface Area", [S.AREA], lambda: plan.total(S.AREA))
    put("Object Count", [], plan.object_count)
    put(
        "Volume Relative to Group",
        [S.VOLUME],
        lambda: over("volume in group", col(S.VOLUME), plan.total(S.VOLUME)),
    )
    put("Surface Area-to-Volume Ratio", [S.AREA, S.VOLUME], lambda: over("area", col(S.AREA), col(S.VOLUME)))
    put(
        "Group Surface Area-to-Volume Ratio",
        [S.AREA, S.VOLUME],
        lambda: over("group area", plan.total(S.AREA), plan.total(S.VOLUME)),
    )
    out.update(_ratio_columns(plan, ratios, df.columns))

    has_center = plan.has_center()
    joined = plan.joined()
    kept = joined.where(~any_center | (has_center & (col(S.CHANNEL) != S.MISSING_CHANNEL)))

    trailing = [c for c in S.TRAILING if c in have]
    leading = [c for c in df.columns if c not in trailing and c not in out]
    ordered = [n for n in wanted if n in out] + [n for n in out if n not in wanted]
    return kept.select(
        *[col(c) for c in leading],
        *[out[n].alias(n) for n in ordered],
        *[col(c) for c in trailing],
    )
