"""Histograms, kernel densities, violins and 2-D densities.

Rows only ever take part in counting: they are binned on a grid of fixed size with
map-side combine, so what is left per facet is bounded by the grid. The kernels then
smooth these grids, one facet per row.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from morphotab.functions.columns import col, key_struct
from morphotab.functions.nulls import finite, is_finite
from morphotab.functions.skew import join_facets
from morphotab.operators.ranks import key_columns
from morphotab.operators.selection import FINISH, quantiles

# ship the smoothing functions with the query: executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

Limits = tuple[float, float]


def _facet_keys(split: str, fill: str) -> list[str]:
    return list(dict.fromkeys([split, fill]))


def _values(df: DataFrame, value: str, limits: Limits | None, keep: Sequence[str]) -> DataFrame:
    """The finite values inside the limits as `_v`, next to the kept columns."""
    rows = df.where(col(value).between(*limits)) if limits else df
    x = finite(col(value).cast("double"))
    return rows.select(*[col(k) for k in keep], x.alias("_v")).where(F.col("_v").isNotNull())


# -- histograms --------------------------------------------------------------------------------


def _binned(data: DataFrame, keys: Sequence[str], split: str, bins: int, free_x: bool) -> DataFrame:
    """Counts per facet and bin. The first bin is centred on the minimum, the last on the maximum."""
    extent = [F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    if free_x:
        ranges = data.groupBy(key_struct([split]).alias("_key")).agg(*extent)
        data = join_facets(data.withColumn("_key", key_struct([split])), ranges, F.col("_v"))
    else:
        ends = data.agg(F.struct(*extent).alias("ends")).scalar()
        data = data.withColumns({"_lo": ends["_lo"], "_hi": ends["_hi"]})
    width = (F.col("_hi") - F.col("_lo")) / F.lit(float(max(bins - 1, 1)))
    data = data.withColumn("_width", width)
    place = F.ceil(F.try_divide(F.col("_v") - (F.col("_lo") - F.col("_width") / 2), F.col("_width")))
    bin_no = F.lit(1).cast("bigint") if bins == 1 else F.coalesce(place, F.lit(1))
    return (
        data.withColumn("bin", bin_no)
        .groupBy(*[col(k) for k in keys], "bin", "_lo", "_width")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("x", F.col("_lo") + (F.col("bin") - 1) * F.col("_width"))
        .drop("_lo", "_width")
    )


def histogram(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    bins: int = 30,
    limits: Limits | None = None,
    free_x: bool = False,
) -> DataFrame:
    """Counts per (split, fill) in equal bins over the common range: bin number, its centre x, count.

    With `free_x` every panel of `split` has its own range. Empty bins are left out.
    """
    keys = _facet_keys(split, fill)
    return _binned(_values(df, value, limits, keys), keys, split, bins, free_x)


def histogram_percent(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    bins: int = 30,
    limits: Limits | None = None,
    free_x: bool = False,
) -> DataFrame:
    """The histogram with every count as a share of its panel."""
    counts = histogram(df, value, fill, split, bins, limits, free_x)
    panel = F.sum("count").over(Window.partitionBy(col(split)))
    return counts.withColumn("percent", F.col("count") / panel)


def binned_percent(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    bins: int = 30,
    limits: Limits | None = None,
    free_x: bool = False,
) -> DataFrame:
    """The histogram with every count as a share of all panels together."""
    counts = histogram(df, value, fill, split, bins, limits, free_x)
    total = _values(df, value, limits, []).agg(F.count(F.lit(1)).alias("total")).scalar()
    return counts.withColumn("percent", F.col("count") / total)


# -- one-dimensional densities -----------------------------------------------------------------


def _spread(sd: Column, iqr: Column) -> Column:
    return F.least(sd, iqr / 1.34)


def _nrd0(n: Column, sd: Column, iqr: Column, any_value: Column) -> Column:
    """Rule-of-thumb bandwidth; facets without spread fall back to sd, the value itself, then 1."""

    def positive(x: Column) -> Column:
        return F.when(x > 0, x)

    lo = F.coalesce(positive(_spread(sd, iqr)), positive(sd), positive(F.abs(any_value)), F.lit(1.0))
    return 0.9 * lo * F.pow(n, F.lit(-0.2))


def _smooth(first: np.ndarray, second: np.ndarray, cell: np.ndarray, row, points: int, grid: int) -> np.ndarray:
    """Gaussian density of one facet at `points` places, from its linearly binned weights."""
    weights = np.zeros(grid)
    np.add.at(weights, cell, first)
    np.add.at(weights, np.minimum(cell + 1, grid - 1), second)
    step = (row.hi - row.lo) / (grid - 1)
    offsets = np.arange(-(grid - 1), grid) * step / row.bw
    kernel = np.exp(-0.5 * offsets * offsets) / (row.bw * np.sqrt(2.0 * np.pi))
    smooth = np.convolve(weights / row.n, kernel, mode="valid" if grid == 1 else "full")[grid - 1 : 2 * grid - 1]
    places = np.linspace(row.start, row.end, points)
    return np.interp(places, row.lo + step * np.arange(grid), smooth)


def _density_udf(points: int, grid: int):
    @pandas_udf("array<double>")
    def density(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            out = []
            for row in frame.itertuples(index=False):
                cell = np.array([c["cell"] for c in row.cells], dtype=np.int64)
                first = np.array([c["first"] for c in row.cells])
                second = np.array([c["second"] for c in row.cells])
                out.append(_smooth(first, second, cell, row, points, grid).tolist())
            yield pd.Series(out)

    return density


def _densities(
    data: DataFrame, keys: Sequence[str], ranges: str, split: str, adjust: float, points: int, grid: int, finish: int
) -> DataFrame:
    """One row per facet: `_key`, n, start, end, `_y` (array of densities). `ranges`: all, panel or facet."""
    data = data.withColumn("_key", key_struct(keys))
    moments = data.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("_v").alias("_sd"),
        F.min("_v").alias("_min"),
        F.max("_v").alias("_max"),
    )
    quarts = quantiles(data, "_v", keys, {"_q1": 0.25, "_q3": 0.75}, finish).drop("_n")
    facets = moments.join(quarts, "_key").where(F.col("n") >= 2)
    if ranges == "facet":
        start, end = F.col("_min"), F.col("_max")
    elif ranges == "panel":
        w = Window.partitionBy(F.col("_key").getField(split))
        start, end = F.min("_min").over(w), F.max("_max").over(w)
    else:
        ends = data.agg(F.struct(F.min("_v").alias("lo"), F.max("_v").alias("hi")).alias("ends")).scalar()
        start, end = ends["lo"], ends["hi"]
    facets = (
        facets.withColumns({"start": start, "end": end})
        .withColumn("bw", _nrd0(F.col("n"), F.col("_sd"), F.col("_q3") - F.col("_q1"), F.col("_min")) * adjust)
        .withColumns({"lo": F.col("start") - 4 * F.col("bw"), "hi": F.col("end") + 4 * F.col("bw")})
        .select("_key", "n", "start", "end", "bw", "lo", "hi")
    )
    place = (F.col("_v") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / (grid - 1))
    cells = (
        join_facets(data, facets, F.col("_v"))
        .withColumn("_place", place)
        .withColumn("cell", F.floor("_place").cast("int"))
        .withColumn("_part", F.col("_place") - F.col("cell"))
        .groupBy("_key", "cell")
        .agg(F.sum(1 - F.col("_part")).alias("first"), F.sum("_part").alias("second"))
    )
    # at most `grid` cells per facet
    grids = cells.groupBy("_key").agg(F.collect_list(F.struct("cell", "first", "second")).alias("cells"))
    numbers = F.struct("cells", "n", "start", "end", "bw", "lo", "hi")
    return grids.join(facets, "_key").withColumn("_y", _density_udf(points, grid)(numbers)).drop("cells")


def _points(densities: DataFrame, keys: Sequence[str], points: int, axis: str, extra: Sequence[str] = ()) -> DataFrame:
    step = (F.col("end") - F.col("start")) / float(points - 1)
    return (
        densities.withColumn("_top", F.array_max("_y"))
        .select("*", F.posexplode("_y").alias("point", "density"))
        .select(
            *key_columns(keys),
            "point",
            (F.col("start") + F.col("point") * step).alias(axis),
            "density",
            (F.col("density") * F.col("n")).alias("count"),
            F.try_divide("density", "_top").alias("scaled"),
            "n",
            *extra,
        )
    )


def kde(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    limits: Limits | None = None,
    adjust: float = 1.0,
    points: int = 512,
    grid: int = 512,
    free_x: bool = False,
    finish: int = FINISH,
) -> DataFrame:
    """Gaussian kernel density per (split, fill) at `points` places of the common range.

    Facets with a single value have no density.
    """
    keys = _facet_keys(split, fill)
    data = _values(df, value, limits, keys)
    found = _densities(data, keys, "panel" if free_x else "all", split, adjust, points, grid, finish)
    return _points(found, keys, points, "x")


def violin(
    df: DataFrame,
    value: str,
    fill: str,
    split: str,
    limits: Limits | None = None,
    points: int = 512,
    grid: int = 512,
    finish: int = FINISH,
) -> DataFrame:
    """Kernel density per (split, fill) over the facet's own range, with its median."""
    keys = _facet_keys(split, fill)
    data = _values(df, value, limits, keys)
    found = _densities(data, keys, "facet", split, 1.0, points, grid, finish)
    medians = quantiles(data, "_v", keys, {"median": 0.5}, finish).drop("_n")
    return _points(found.join(medians, "_key"), keys, points, "y", ["median"])


def density_peak(df: DataFrame, value: str, fill: str, **options) -> DataFrame:
    """Largest density over all groups of `fill`: the upper end of an automatic density axis."""
    return kde(df, value, fill, fill, **options).agg(F.max("density").alias("Max"))


# -- two-dimensional density -------------------------------------------------------------------


def _surface(frame_row, points: int, refine: int) -> np.ndarray:
    """Product-Gaussian density of one facet on a points x points grid."""
    fine = (points - 1) * refine + 1
    cells = frame_row.cells
    i = np.array([c["i"] for c in cells], dtype=np.int64)
    j = np.array([c["j"] for c in cells], dtype=np.int64)
    weights = np.zeros((fine, fine))
    for di, dj, name in ((0, 0, "w00"), (1, 0, "w10"), (0, 1, "w01"), (1, 1, "w11")):
        rows, columns = np.minimum(i + di, fine - 1), np.minimum(j + dj, fine - 1)
        np.add.at(weights, (rows, columns), np.array([c[name] for c in cells]))

    def kernel(extent: float, h: float) -> np.ndarray:
        coarse, all_places = np.linspace(0.0, extent, points), np.linspace(0.0, extent, fine)
        u = (coarse[:, None] - all_places[None, :]) / h
        return np.exp(-0.5 * u * u) / (h * np.sqrt(2.0 * np.pi))

    kx, ky = kernel(frame_row.wx, frame_row.hx), kernel(frame_row.wy, frame_row.hy)
    return (kx @ weights @ ky.T / frame_row.n).ravel()


def _surface_udf(points: int, refine: int):
    @pandas_udf("array<double>")
    def surface(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for frame in batches:
            yield pd.Series([_surface(row, points, refine).tolist() for row in frame.itertuples(index=False)])

    return surface


def density2d(
    df: DataFrame,
    x: str,
    y: str,
    facet: str,
    x_limits: Limits | None = None,
    y_limits: Limits | None = None,
    points: int = 100,
    refine: int = 4,
    finish: int = FINISH,
) -> DataFrame:
    """2-D kernel density per facet on a points x points grid over the common range.

    `ndensity` is the density relative to the facet's highest. Rows are binned linearly on a
    grid `refine` times as fine as the result, which leaves an error far below what a contour
    shows. Facets without spread in x or y have no density.
    """
    rows = df
    for name, limits in ((x, x_limits), (y, y_limits)):
        if limits:
            rows = rows.where(col(name).between(*limits))
    data = rows.where(is_finite(col(x)) & is_finite(col(y))).select(
        key_struct([facet]).alias("_key"),
        col(facet),
        col(x).cast("double").alias("_x"),
        col(y).cast("double").alias("_y"),
    )
    names = {"lx": F.min("_x"), "ux": F.max("_x"), "ly": F.min("_y"), "uy": F.max("_y")}
    ends = data.agg(F.struct(*[v.alias(k) for k, v in names.items()]).alias("ends")).scalar()
    facets = data.groupBy("_key").agg(
        F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("_sx"), F.stddev_samp("_y").alias("_sy")
    )
    for axis in ("x", "y"):
        probs = {f"_l{axis}": 0.25, f"_u{axis}": 0.75}
        facets = facets.join(quantiles(data, f"_{axis}", [facet], probs, finish).drop("_n"), "_key")

    def bandwidth(axis: str) -> Column:
        spread = _spread(F.col(f"_s{axis}"), F.col(f"_u{axis}") - F.col(f"_l{axis}"))
        return 1.06 * spread * F.pow(F.col("n"), F.lit(-0.2))

    facets = (
        facets.withColumns({"hx": bandwidth("x"), "hy": bandwidth("y")})
        .withColumns({"wx": ends["ux"] - ends["lx"], "wy": ends["uy"] - ends["ly"]})
        .where((F.col("hx") > 0) & (F.col("hy") > 0))
        .select("_key", "n", "hx", "hy", "wx", "wy")
    )
    fine = (points - 1) * refine
    px = (F.col("_x") - ends["lx"]) / ((ends["ux"] - ends["lx"]) / fine)
    py = (F.col("_y") - ends["ly"]) / ((ends["uy"] - ends["ly"]) / fine)
    fx, fy = F.col("_px") - F.col("i"), F.col("_py") - F.col("j")
    cells = (
        data.withColumns({"_px": F.coalesce(finite(px), F.lit(0.0)), "_py": F.coalesce(finite(py), F.lit(0.0))})
        .withColumns({"i": F.floor("_px").cast("int"), "j": F.floor("_py").cast("int")})
        .groupBy("_key", "i", "j")
        .agg(
            F.sum((1 - fx) * (1 - fy)).alias("w00"),
            F.sum(fx * (1 - fy)).alias("w10"),
            F.sum((1 - fx) * fy).alias("w01"),
            F.sum(fx * fy).alias("w11"),
        )
    )
    # at most (fine + 1)^2 cells per facet
    grids = cells.groupBy("_key").agg(
        F.collect_list(F.struct("i", "j", "w00", "w10", "w01", "w11")).alias("cells")
    )
    numbers = F.struct("cells", "n", "hx", "hy", "wx", "wy")
    surfaces = grids.join(facets, "_key").withColumn("_z", _surface_udf(points, refine)(numbers)).drop("cells")
    step = float(points - 1)
    return (
        surfaces.withColumn("_top", F.array_max("_z"))
        .select("*", F.posexplode("_z").alias("_at", "density"))
        .withColumns({"i": F.floor(F.col("_at") / points).cast("int"), "j": (F.col("_at") % points).cast("int")})
        .select(
            *key_columns([facet]),
            "i",
            "j",
            (ends["lx"] + F.col("i") * F.col("wx") / step).alias("x"),
            (ends["ly"] + F.col("j") * F.col("wy") / step).alias("y"),
            "density",
            F.try_divide("density", "_top").alias("ndensity"),
            "n",
        )
    )
