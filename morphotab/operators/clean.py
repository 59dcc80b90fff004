"""Harmonisation: from one row per (object, file) to one row per (object, channel)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphotab import schema as S
from morphotab.functions.columns import col, cols

MOST_PLACES = 200  # columns that an object may have for its channels, values and sources

SURPASS_OBJECT = "Surpass Object"
SURFACES = "Surfaces"
SPOTS = "Spots"

# Keys under which the rows of different files describe the same thing.
JAGGED_KEYS = [S.GENOTYPE, S.IMAGE, S.TREATMENT, S.OBJECT_ID, S.CATEGORY, S.CHANNEL, SURPASS_OBJECT, SURFACES]


def retained_columns(names: Sequence[str]) -> list[str]:
    """Columns whose name contains one of the retained tokens, in any case."""
    tokens = [t.lower() for t in S.RETAINED_TOKENS]
    return [n for n in names if any(t in n.lower() for t in tokens)]


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of tables with different columns; what a table lacks is NULL."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def first_known(value: Column, order: Column | None) -> Column:
    """Aggregate: a value that is not NULL, the one that comes first in `order`.

    Without an order the smallest value is taken, which needs no sort.
    """
    if order is None:
        return F.min(value)
    return F.min(F.when(value.isNotNull(), F.struct(order.alias("o"), value.alias("v")))).getField("v")


def coalesce_rows(df: DataFrame, keys: Sequence[str], order_by: str | None = None) -> DataFrame:
    """One row per key with a non-NULL value of every other column, if any row of the key has one."""
    order = col(order_by) if order_by else None
    values = [c for c in df.columns if c not in keys and c != order_by]
    return df.groupBy(*cols(keys)).agg(*[first_known(col(c), order).alias(c) for c in values])


def level_names(df: DataFrame, column: str) -> list[str]:
    """Distinct names in a column; they become column names of a pivot, so they are schema, not data."""
    found = df.select(col(column)).where(col(column).isNotNull()).distinct().collect()
    return sorted(r[0] for r in found)


def surface_column(statistic: str, surface: str) -> str:
    return f"{statistic} - {surface}"


def spot_column(spot: str) -> str:
    return f"Distance to Spot {spot}"


def _pivot(df: DataFrame, keys: Sequence[str], columns: dict[str, tuple[str, str, str]]) -> DataFrame:
    aggs = [F.max(F.when(col(by) == name, col(value))).alias(out) for out, (by, name, value) in columns.items()]
    return df.groupBy(*cols(keys)).agg(*aggs)


def pivot_surfaces(df: DataFrame, keys: Sequence[str], surfaces: Sequence[str] | None = None) -> DataFrame:
    """Statistics against a surface as one column per (statistic, surface); no column for a NULL surface."""
    names = surfaces if surfaces is not None else level_names(df, SURFACES)
    statistics = [s for s in S.SURFACE_STATISTICS if s in df.columns]
    wanted = {surface_column(s, n): (SURFACES, n, s) for s in statistics for n in names}
    return _pivot(df, keys, wanted)


def pivot_spots(df: DataFrame, keys: Sequence[str], spots: Sequence[str] | None = None) -> DataFrame:
    """Distances to spots as one column per spot; no column for a NULL spot."""
    if S.SPOT_STATISTIC not in df.columns:
        return df
    names = spots if spots is not None else level_names(df, SPOTS)
    return _pivot(df, keys, {spot_column(n): (SPOTS, n, S.SPOT_STATISTIC) for n in names})


def unify_labels(df: DataFrame, column: str = S.OBJECT) -> DataFrame:
    """One spelling of the centre-of-mass label."""
    label = F.when(col(column).isin(S.CENTER_OF_MASS_SPELLINGS), S.CENTER_OF_MASS).otherwise(col(column))
    return df.withColumn(column, label)


def rename_neighbour_distances(df: DataFrame) -> DataFrame:
    """Shorter names and numbers for the average distances to the nearest neighbours."""
    for k in S.NEIGHBOUR_COUNTS:
        old, new = f"Average Distance To {k} Nearest Neighbours", f"Distance To {k} Nearest Neighbours"
        if old in df.columns:
            df = df.withColumnRenamed(old, new).withColumn(new, col(new).try_cast("double"))
    return df


def fill_down_up(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by: Sequence[str]
) -> DataFrame:
    """Fill gaps within a group from the row before, failing that from the row after.

    The groups are the rows of one object, so a window holds a handful of rows.
    """
    order = [col(c).asc_nulls_last() for c in order_by]
    window = Window.partitionBy(*cols(keys)).orderBy(*order)
    down = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    up = window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = {
        c: F.coalesce(F.last(col(c), ignorenulls=True).over(down), F.first(col(c), ignorenulls=True).over(up))
        for c in columns
    }
    return df.withColumns(filled)


def leading_order(df: DataFrame) -> DataFrame:
    """Key columns first, image subset and time last."""
    first = [c for c in S.KEYS if c in df.columns]
    last = [c for c in S.TRAILING if c in df.columns]
    rest = [c for c in df.columns if c not in first and c not in last]
    return df.select(*cols([*first, *rest, *last]))


def _sources(rows: DataFrame, order: str, picks: dict[str, Column]) -> dict[tuple, list] | None:
    """For every channel and value column the sources that hold such values, in their order; None if they are many."""
    held = [F.count(v).alias(f"_{k}") for k, v in enumerate(picks.values())]
    found = rows.groupBy(col(S.CHANNEL), col(order).alias("_order")).agg(*held)
    some = found.limit(MOST_PLACES + 1).sort("_order").collect()
    places: dict[tuple, list] = {(r[0], c): [] for r in some for c in picks}
    for r in some:
        for k, c in enumerate(picks):
            if r[f"_{k}"]:
                places[r[0], c].append(r["_order"])
    few = len(some) <= MOST_PLACES and sum(map(len, places.values())) <= MOST_PLACES
    return places if few else None


def _harmonised_by_object(rows: DataFrame, order: str, picks: dict[str, Column], places: dict[tuple, list]) -> DataFrame:
    """What `harmonise` returns, from one row for each object with a column for each channel, value column and source.

    The smallest value of each is found before rows are dealt out, without a sort.
    """
    held = {(ch, c, k): f"_{i}" for i, (ch, c, k) in enumerate((ch, c, k) for (ch, c), names in places.items() for k in range(len(names)))}
    values = [
        F.min(F.when(col(S.CHANNEL).eqNullSafe(ch) & col(order).eqNullSafe(places[ch, c][k]), picks[c])).alias(name)
        for (ch, c, k), name in held.items()
    ]
    channels = sorted({ch for ch, _ in places if ch is not None})
    seen = [F.count(F.when(col(S.CHANNEL) == ch, 1)).alias(f"_seen{i}") for i, ch in enumerate(channels)]
    objects = rows.groupBy(*cols(S.OBJECT_KEYS)).agg(*seen, *values)
    types = dict(rows.select(*[v.alias(c) for c, v in picks.items()]).dtypes)

    def first(ch: str, c: str) -> Column:
        own, of_object = ([held[x, c, k] for k in range(len(places.get((x, c), [])))] for x in (ch, None))
        return F.coalesce(*cols([*own, *of_object]), F.lit(None).cast(types[c])).alias(c)

    out = [
        F.when(F.col(f"_seen{i}") > 0, F.struct(F.lit(ch).alias(S.CHANNEL), *[first(ch, c) for c in picks]))
        for i, ch in enumerate(channels)
    ]
    if not out:
        out = [F.lit(None).cast(f"struct<{', '.join(f'`{c}`: {t}' for c, t in {S.CHANNEL: 'string', **types}.items())}>")]
    spread = objects.select(*cols(S.OBJECT_KEYS), F.explode(F.array(*out)).alias("row")).where("row IS NOT NULL")
    return spread.select(*cols(S.OBJECT_KEYS), "row.*")


def harmonise(
    rows: DataFrame,
    order_by: str | None = None,
    surfaces: Sequence[str] | None = None,
    spots: Sequence[str] | None = None,
    few_sources: bool = False,
) -> DataFrame:
    """The cleaned table from the rows of all files of all images.

    Rows of intensity files carry a channel; rows of the other files describe the object and
    have none. One aggregation collapses the rows of an object and channel, pivots included.
    A window over the few rows left of an object then gives its object-level values to every
    channel; a channel never borrows another channel's value. Object-level rows without a time
    hold for all times of the object that have no value of their own. Objects without any
    channel are dropped.

    With `few_sources`, `order_by` holds kinds of file rather than paths. They are looked at first; if there are no times
    and only few channels and sources, the rows of an object meet where they are read, and much less is shuffled.
    """
    if SURPASS_OBJECT in rows.columns:
        rows = rows.withColumnRenamed(SURPASS_OBJECT, S.OBJECT)
    rows = unify_labels(rows)
    of_all_times = S.OBJECT_KEYS
    object_keys = [*of_all_times, *([S.TIME] if S.TIME in rows.columns else [])]
    keys = [*object_keys, S.CHANNEL]  # in this order the sort of the aggregation serves the windows
    order = col(order_by) if order_by else None

    pivots: dict[str, Column] = {}
    statistics = [s for s in S.SURFACE_STATISTICS if s in rows.columns]
    if SURFACES in rows.columns and statistics:
        names = surfaces if surfaces is not None else level_names(rows, SURFACES)
        for s in statistics:
            for n in names:
                pivots[surface_column(s, n)] = F.when(col(SURFACES) == n, col(s))
    if SPOTS in rows.columns and S.SPOT_STATISTIC in rows.columns:
        for n in spots if spots is not None else level_names(rows, SPOTS):
            pivots[spot_column(n)] = F.when(col(SPOTS) == n, col(S.SPOT_STATISTIC))

    skipped = {*keys, SURFACES, SPOTS, *statistics, S.SPOT_STATISTIC, order_by}
    plain = [c for c in rows.columns if c not in skipped]
    picks = {c: col(c) for c in plain} | pivots
    numbers = rows.select(*[v.alias(c) for c, v in picks.items()]).schema.fields
    if few_sources and order_by and S.TIME not in keys and all(isinstance(f.dataType, T.NumericType) for f in numbers):
        places = _sources(rows, order_by, picks)
        if places is not None:
            return leading_order(rename_neighbour_distances(_harmonised_by_object(rows, order_by, picks, places)))
    # the sort of the aggregation compares a number first, where texts mostly begin alike
    dealt = rows.repartition(*cols(of_all_times)).withColumn("_at", F.xxhash64(*cols(of_all_times)))
    collapsed = dealt.groupBy("_at", *cols(keys)).agg(*[first_known(v, order).alias(c) for c, v in picks.items()])

    of_object = Window.partitionBy("_at", *cols(object_keys))
    no_channel = col(S.CHANNEL).isNull()
    spread = {
        c: F.coalesce(col(c), F.max(F.when(no_channel, col(c))).over(of_object)) for c in picks
    }
    if S.TIME in keys:
        all_times = Window.partitionBy("_at", *cols(of_all_times))
        timeless = no_channel & col(S.TIME).isNull()
        spread = {c: F.coalesce(v, F.max(F.when(timeless, col(c))).over(all_times)) for c, v in spread.items()}
    return leading_order(rename_neighbour_distances(collapsed.withColumns(spread).where(~no_channel).drop("_at")))
