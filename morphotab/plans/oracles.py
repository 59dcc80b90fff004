"""The registered queries in SQL, for value checks by another engine."""

from __future__ import annotations

from morphotab import schema as S
from morphotab.plans.measurement_view import with_view
from morphotab.plans.queries import RATIO_QUERIES, VARIABLES

KEYS = "genotype, treatment, image_file, category, object, channel, object_id"
OBJECT_KEYS = "genotype, treatment, image_file, category, object, object_id"
MEASURES = "intensity_sum, intensity_mean, intensity_stddev, volume, area, distance_to_nucleus"
ROUNDED = (
    "round(intensity_sum, 6) AS intensity_sum, round(intensity_mean, 6) AS intensity_mean, "
    "round(intensity_stddev, 6) AS intensity_stddev, volume, area, distance_to_nucleus"
)

# Reference values, totals and ratios; `v` has every derived variable.
_STRICT = "CASE WHEN count({x}) OVER {w} = count(*) OVER {w} THEN {f}({x}) OVER {w} END"


def _strict(fn: str, x: str, window: str) -> str:
    return _STRICT.format(f=fn, x=x, w=window)


def _single(x: str, cond: str) -> str:
    hit = f"FILTER (WHERE {cond}) OVER ic"
    return f"CASE WHEN count(*) {hit} = 1 THEN max({x}) {hit} END"


def _channel(x: str, channel: str) -> str:
    hit = f"FILTER (WHERE channel = '{channel}') OVER ob"
    return f"CASE WHEN count(*) {hit} = 1 THEN max({x}) {hit} END"


def _ratio(x: str) -> str:
    return f"{_channel(x, '1')} / nullif({_channel(x, '2')}, 0)"


_IS_REF = "object = 'Nucleus'"
_IS_SURFACE = "object = 'Nucleus' AND category = 'Surface'"
_IS_CENTER = "object = 'Nucleus Center of Mass'"

DERIVED = f"""
, kept AS (
  SELECT * REPLACE (CASE WHEN {_IS_CENTER} AND distance_to_nucleus IS NULL THEN 1.0
                    ELSE distance_to_nucleus END AS distance_to_nucleus)
  FROM m
  WHERE channel <> 'NA' AND image_file IN (SELECT image_file FROM m WHERE {_IS_CENTER})
),
refs AS (
  SELECT *,
    {_single('intensity_sum', _IS_REF)} AS ref_sum,
    {_single('intensity_mean', _IS_REF)} AS ref_mean,
    {_single('intensity_stddev', _IS_REF)} AS ref_std,
    {_single('intensity_sum', _IS_SURFACE)} AS surface_sum,
    {_single('intensity_mean', _IS_SURFACE)} AS surface_mean,
    {_single('volume', _IS_SURFACE)} AS surface_volume,
    {_single('distance_to_nucleus', _IS_CENTER)} AS center_distance,
    {_strict('sum', 'intensity_sum', 'grp')} AS group_intensity_sum,
    {_strict('avg', 'intensity_mean', 'grp')} AS group_intensity_mean,
    {_strict('sum', 'volume', 'grp')} AS group_volume,
    {_strict('sum', 'area', 'grp')} AS group_surface_area,
    CAST(count(*) OVER lab AS BIGINT) AS object_count,
    {_ratio('intensity_sum')} AS ratio_sum,
    {_ratio('intensity_mean')} AS ratio_mean
  FROM kept
  WINDOW ic AS (PARTITION BY image_file, channel),
         grp AS (PARTITION BY image_file, channel, category, object),
         lab AS (PARTITION BY image_file, channel, object),
         ob AS (PARTITION BY image_file, object_id, object, category)
),
v1 AS (
  SELECT *,
    intensity_sum / nullif(ref_sum, 0) AS w1,
    intensity_mean / nullif(ref_mean, 0) AS w2,
    intensity_stddev / nullif(ref_std, 0) AS w3
  FROM refs
),
v2 AS (
  SELECT *,
    w1 / nullif({_strict('sum', 'w1', 'lab')}, 0) AS w11,
    w2 / nullif({_strict('sum', 'w2', 'lab')}, 0) AS w12,
    w3 / nullif({_strict('sum', 'w3', 'lab')}, 0) AS w13,
    {_ratio('w1')} AS ratio_w1
  FROM v1
  WINDOW lab AS (PARTITION BY image_file, channel, object),
         ob AS (PARTITION BY image_file, object_id, object, category)
),
v AS (
  SELECT {KEYS}, {MEASURES},
    w1 AS intensity_sum_normalised_per_nucleus,
    w2 AS intensity_mean_normalised_per_nucleus,
    w3 AS intensity_stddev_normalised_per_nucleus,
    w11 AS intensity_sum_normalised_by_group,
    w12 AS intensity_mean_normalised_by_group,
    w13 AS intensity_stddev_normalised_by_group,
    distance_to_nucleus / nullif(center_distance, 0) AS normalized_distance_to_nucleus,
    area / nullif(volume, 0) AS surface_area_to_volume_ratio,
    volume / nullif(surface_volume, 0) AS volume_relative_to_nucleus,
    volume / nullif(group_volume, 0) AS volume_relative_to_group,
    object_count,
    group_intensity_sum,
    group_intensity_mean,
    group_intensity_sum / nullif(surface_sum, 0) AS group_intensity_sum_relative_to_nucleus,
    group_intensity_mean / nullif(surface_mean, 0) AS group_intensity_mean_relative_to_nucleus,
    group_volume,
    group_surface_area,
    group_volume / nullif(surface_volume, 0) AS group_volume_relative_to_nucleus,
    group_surface_area / nullif(group_volume, 0) AS group_surface_area_to_volume_ratio,
    w1 / nullif(volume, 0) AS signal_density,
    ratio_sum AS ratio_ch1_ch2_of_intensity_sum,
    ratio_mean AS ratio_ch1_ch2_of_intensity_mean,
    ratio_w1 AS ratio_ch1_ch2_of_intensity_sum_normalised_per_nucleus,
    {_ratio('w11')} AS ratio_ch1_ch2_of_intensity_sum_normalised_per_group
  FROM v2
  WINDOW ob AS (PARTITION BY image_file, object_id, object, category)
)
"""

_ALL_DERIVED = [
    "intensity_sum_normalised_per_nucleus",
    "intensity_mean_normalised_per_nucleus",
    "intensity_stddev_normalised_per_nucleus",
    "intensity_sum_normalised_by_group",
    "intensity_mean_normalised_by_group",
    "intensity_stddev_normalised_by_group",
    "normalized_distance_to_nucleus",
    "surface_area_to_volume_ratio",
    "volume_relative_to_nucleus",
    "volume_relative_to_group",
    "object_count",
    "group_intensity_sum",
    "group_intensity_mean",
    "group_intensity_sum_relative_to_nucleus",
    "group_intensity_mean_relative_to_nucleus",
    "group_volume",
    "group_surface_area",
    "group_volume_relative_to_nucleus",
    "group_surface_area_to_volume_ratio",
    "signal_density",
    "ratio_ch1_ch2_of_intensity_sum",
    "ratio_ch1_ch2_of_intensity_mean",
    "ratio_ch1_ch2_of_intensity_sum_normalised_per_nucleus",
    "ratio_ch1_ch2_of_intensity_sum_normalised_per_group",
]


def _rounded(names: list[str]) -> str:
    off_ties = {"group_intensity_mean": "group_intensity_mean + 1e-8"}
    return ", ".join(n if n == "object_count" else f"round({off_ties.get(n, n)}, 6) AS {n}" for n in names)


def _on_derived(body: str) -> str:
    return with_view(DERIVED + body)


def _snake(name: str) -> str:
    from morphotab.functions.columns import snake

    return snake(name.replace("{ref}", "Nucleus"))


ORACLES: dict[str, str] = {}
for _key, _name in VARIABLES.items():
    ORACLES[_key] = _on_derived(f"SELECT {KEYS}, {_rounded([_snake(_name)])} FROM v")
for _key, (_, _of) in RATIO_QUERIES.items():
    ORACLES[_key] = _on_derived(f"SELECT {KEYS}, {_rounded([_snake(f'Ratio Ch1:Ch2 of {_of}')])} FROM v")

ORACLES["derive_all"] = _on_derived(f"SELECT {KEYS}, {ROUNDED}, {_rounded(_ALL_DERIVED)} FROM v")
ORACLES["fill_ref_distance"] = with_view(
    f"SELECT {KEYS}, CASE WHEN {_IS_CENTER} AND distance_to_nucleus IS NULL THEN 1.0 "
    "ELSE distance_to_nucleus END AS distance_to_nucleus FROM m"
)
ORACLES["images_with_reference"] = with_view(
    f"SELECT {KEYS}, {ROUNDED} FROM m WHERE channel <> 'NA' "
    f"AND image_file IN (SELECT image_file FROM m WHERE {_IS_CENTER})"
)

# -- sources and sinks -------------------------------------------------------------------------

ORACLES["import_table"] = with_view(
    "SELECT DISTINCT genotype, treatment, image_file, category, object, "
    "CASE WHEN treatment <> 'ASIA' THEN channel ELSE 'NA' END AS channel, object_id, "
    f"{ROUNDED} FROM m"
)
ORACLES["export_columns"] = with_view(
    "SELECT image_file, object, channel, object_id, volume, round(intensity_mean, 6) AS intensity_mean FROM m"
)
ORACLES["read_stat_tree"] = with_view(f"""
, o AS (
  SELECT {OBJECT_KEYS}, max(volume) AS volume, min(distance_to_nucleus) AS distance
  FROM m GROUP BY {OBJECT_KEYS}
)
SELECT m.genotype, m.treatment, m.image_file, m.category, m.object, m.channel, m.object_id,
       round(m.intensity_sum, 6) AS intensity_sum, round(m.intensity_mean, 6) AS intensity_mean,
       o.volume, o.distance AS shortest_distance_to_surfaces_nucleus, '1' AS time
FROM m JOIN o USING ({OBJECT_KEYS})
""")
ORACLES["skip_small_files"] = (
    "SELECT source || '/' || CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(text)) AS BIGINT) AS size "
    "FROM documents WHERE octet_length(encode(text)) >= 100"
)
ORACLES["skip_listed_files"] = (
    "SELECT * FROM (SELECT page_id, url || '/img_' || CASE page_id % 5 WHEN 0 THEN 'Diameter_X.csv' "
    "WHEN 1 THEN 'Volume.csv' WHEN 2 THEN 'Position.csv' WHEN 3 THEN 'Area.csv' ELSE 'Time_Index.csv' END AS path "
    "FROM pages) t WHERE NOT regexp_matches(path, '" + "|".join(S.SKIPPED_FILES) + "')"
)
ORACLES["path_metadata"] = (
    "SELECT page_id, string_split(url, '/')[-4] AS genotype, string_split(url, '/')[-3] AS treatment, "
    "replace(string_split(url, '/')[-2], '_Statistics', '') AS image_file FROM pages"
)

# -- harmonisation -----------------------------------------------------------------------------

_LOWEST = f"""
surf AS (
  SELECT {OBJECT_KEYS}, l_returnflag AS name, min(l_extendedprice) AS price
  FROM (SELECT *, CAST(p_size AS VARCHAR) AS object_id FROM base) GROUP BY {OBJECT_KEYS}, l_returnflag
),
spot AS (
  SELECT {OBJECT_KEYS}, CAST(l_linenumber % 3 AS VARCHAR) AS name, min(l_extendedprice) AS price
  FROM (SELECT *, CAST(p_size AS VARCHAR) AS object_id FROM base) GROUP BY {OBJECT_KEYS}, l_linenumber % 3
)"""


def _wide(source: str, prefix: str, names: str) -> str:
    picks = ", ".join(f"max(price) FILTER (WHERE name = '{n}') AS {prefix}{n.lower()}" for n in names)
    return f"SELECT {OBJECT_KEYS}, {picks} FROM {source} GROUP BY {OBJECT_KEYS}"


_SURFACE_PREFIX, _SPOT_PREFIX = "shortest_distance_to_surfaces_", "distance_to_spot_"
ORACLES["pivot_surfaces"] = with_view(f", {_LOWEST} {_wide('surf', _SURFACE_PREFIX, 'ANR')}")
ORACLES["pivot_spots"] = with_view(f", {_LOWEST} {_wide('spot', _SPOT_PREFIX, '012')}")
_FIRST = ", ".join(f"arg_min({c}, channel) AS {c}" for c in ("volume", "area", "distance_to_nucleus"))
ORACLES["harmonise"] = with_view(f"""
, {_LOWEST},
ws AS ({_wide('surf', _SURFACE_PREFIX, 'ANR')}),
wp AS ({_wide('spot', _SPOT_PREFIX, '012')}),
o AS (SELECT {OBJECT_KEYS}, {_FIRST} FROM m GROUP BY {OBJECT_KEYS})
SELECT {KEYS}, round(intensity_sum, 6) AS intensity_sum, round(intensity_mean, 6) AS intensity_mean,
       round(intensity_stddev, 6) AS intensity_stddev, o.volume, o.area, o.distance_to_nucleus,
       {', '.join(_SURFACE_PREFIX + n for n in 'anr')}, {', '.join(_SPOT_PREFIX + n for n in '012')}
FROM (SELECT {KEYS}, intensity_sum, intensity_mean, intensity_stddev FROM m) c
JOIN o USING ({OBJECT_KEYS}) LEFT JOIN ws USING ({OBJECT_KEYS}) LEFT JOIN wp USING ({OBJECT_KEYS})
""")
ORACLES["coalesce_rows"] = with_view(f"""
SELECT {KEYS}, round(intensity_sum, 6) AS intensity_sum, round(intensity_mean, 6) AS intensity_mean,
       round(intensity_stddev, 6) AS intensity_stddev, CAST(NULL AS DOUBLE) AS volume,
       CAST(NULL AS DOUBLE) AS area, CAST(NULL AS DOUBLE) AS distance_to_nucleus FROM m
UNION ALL
SELECT genotype, treatment, image_file, category, object, NULL, object_id, NULL, NULL, NULL, {_FIRST}
FROM m GROUP BY {OBJECT_KEYS}
""")
ORACLES["unify_labels"] = with_view(f"SELECT {KEYS} FROM m")
ORACLES["fill_down_up"] = with_view(f"""
SELECT {KEYS},
       max(volume) FILTER (WHERE channel = '1') OVER ob AS volume,
       max(area) FILTER (WHERE channel = '2') OVER ob AS area
FROM m WINDOW ob AS (PARTITION BY {OBJECT_KEYS})
""")

# -- integrity ---------------------------------------------------------------------------------

ORACLES["unexpected_labels"] = with_view(
    "SELECT DISTINCT object, image_file FROM m WHERE object NOT IN ("
    + ", ".join(f"'{t}'" for t in S.ACCEPTED_OBJECTS)
    + ")"
)
ORACLES["images_without_com"] = with_view(
    f"SELECT image_file FROM m GROUP BY image_file HAVING NOT bool_or({_IS_CENTER})"
)
ORACLES["images_without_ref"] = with_view(
    f"SELECT image_file FROM m GROUP BY image_file HAVING NOT bool_or({_IS_REF})"
)
ORACLES["channel_pairs"] = with_view(
    ", c AS (SELECT DISTINCT channel FROM m) "
    "SELECT x.channel AS a, y.channel AS b, 'Ch' || x.channel || ':Ch' || y.channel AS label "
    "FROM c x JOIN c y ON x.channel <> y.channel"
)
ORACLES["images_with_null_column"] = _on_derived(
    "SELECT image_file FROM v GROUP BY image_file HAVING least("
    + ", ".join(
        f"count({c})" for c in (MEASURES + ", intensity_sum_normalised_per_nucleus").split(", ")
    )
    + ") = 0"
)
ORACLES["null_channel_rows"] = with_view(
    "SELECT image_file, object_id FROM m WHERE treatment IN ('ASIA', 'EUROPE')"
)
_MISSING_COLUMNS = "category, genotype, treatment, object, object_id, channel, intensity_sum, intensity_mean, intensity_stddev, volume, area, distance_to_nucleus"
ORACLES["integrity_all"] = with_view(
    """
, q AS (SELECT * REPLACE (CASE WHEN treatment = 'ASIA' THEN 'NA' WHEN treatment <> 'EUROPE' THEN channel END AS channel,
                          CASE WHEN object <> 'PROMO' THEN area END AS area,
                          CASE WHEN NOT ends_with(image_file, '7') THEN volume END AS volume) FROM m)
SELECT DISTINCT 'label' AS report, image_file, object AS detail FROM q WHERE object NOT IN ("""
    + ", ".join(f"'{t}'" for t in S.ACCEPTED_OBJECTS)
    + f""")
UNION ALL SELECT 'no centre of mass', image_file, NULL FROM q GROUP BY image_file HAVING NOT bool_or({_IS_CENTER})
UNION ALL SELECT 'no reference', image_file, NULL FROM q GROUP BY image_file HAVING NOT bool_or({_IS_REF})
UNION ALL SELECT 'empty column', image_file, NULL FROM q GROUP BY image_file HAVING least("""
    + ", ".join(f"count({c.strip()})" for c in _MISSING_COLUMNS.split(","))
    + """) = 0
UNION ALL SELECT 'no channel', image_file, object_id FROM q WHERE channel IS NULL OR channel = 'NA'
"""
)
ORACLES["eligible_references"] = with_view("""
, e AS (SELECT image_file, channel, object, category FROM m
        UNION ALL SELECT image_file, channel, 'Envelope', category FROM m WHERE object = 'Nucleus'),
s AS (SELECT image_file, channel, object FROM e WHERE category = 'Surface' AND object <> 'Nucleus'
      GROUP BY image_file, channel, object HAVING count(*) = 1)
SELECT DISTINCT object FROM e WHERE object = 'Nucleus'
UNION ALL
SELECT object FROM s GROUP BY object
HAVING count(*) = (SELECT count(*) FROM (SELECT DISTINCT image_file, channel FROM s))
""")

ORACLES["declared_variables"] = with_view(
    f"""
, r AS (SELECT *, CASE WHEN count(*) FILTER (WHERE {_IS_REF}) OVER ic = 1
                       THEN max(intensity_sum) FILTER (WHERE {_IS_REF}) OVER ic END AS ref
        FROM m WINDOW ic AS (PARTITION BY image_file, channel)),
s AS (SELECT *, intensity_sum / nullif(ref, 0) AS share, {_channel('intensity_mean', '1')} AS one, {_channel('intensity_mean', '2')} AS two
      FROM r WINDOW ob AS (PARTITION BY image_file, object_id, object, category)),
t AS (SELECT *, {_strict('sum', 'volume', 'grp')} AS group_volume, {_strict('sum', 'area', 'lab')} AS label_area, {_strict('sum', 'share', 'grp')} AS whole_share
      FROM s WINDOW grp AS (PARTITION BY image_file, channel, category, object), lab AS (PARTITION BY image_file, object, channel))
SELECT {KEYS}, round(share / nullif(group_volume, 0), 6) AS dense_share, round(label_area / nullif(area, 0), 6) AS area_of_label,
       round(one / nullif(two, 0), 6) AS channel_ratio, round(whole_share, 6) AS whole_share FROM t
"""
)

# -- selection ---------------------------------------------------------------------------------

_ROW = f"SELECT {KEYS}, {ROUNDED} FROM m"
ORACLES["select_levels"] = with_view(
    f"{_ROW} WHERE object IN ('PROMO', 'LARGE', 'Nucleus') AND treatment IN ('ASIA', 'AFRICA') "
    "AND genotype = 'WT' AND channel = '1'"
)
ORACLES["select_many_levels"] = with_view(
    f"{_ROW} WHERE image_file IN (SELECT 'img_' || s_suppkey FROM supplier WHERE s_acctbal > 3000) AND channel = '1' "
    "AND try_cast(object_id AS INTEGER) BETWEEN 0 AND 99999 AND CAST(object_id AS INTEGER) % 2 = 0"
)
ORACLES["select_numeric"] = with_view(f"SELECT {KEYS}, round(intensity_sum, 6) AS intensity_sum, volume FROM m")
ORACLES["range_filter"] = with_view(f"{_ROW} WHERE volume BETWEEN 20 AND 80")
ORACLES["range_filter_channel"] = with_view(f"{_ROW} WHERE channel <> '1' OR volume BETWEEN 20 AND 80")
ORACLES["rect_filter"] = with_view(f"{_ROW} WHERE volume BETWEEN 20 AND 80 AND area BETWEEN 3 AND 9")
_DISPLAY = {
    "Intensity Sum": "intensity_sum",
    "Intensity Mean": "intensity_mean",
    "Intensity StdDev": "intensity_stddev",
    "Volume": "volume",
    "Area": "area",
    "Distance to Nucleus": "distance_to_nucleus",
}
ORACLES["finite_range"] = with_view(
    " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM m"
        for name, c in _DISPLAY.items()
    )
)
ORACLES["lift_zeros"] = with_view(
    f"SELECT {KEYS}, CASE WHEN distance_to_nucleus = 0 THEN "
    "(SELECT min(distance_to_nucleus) FROM m WHERE distance_to_nucleus > 0) "
    "ELSE distance_to_nucleus END AS distance_to_nucleus FROM m"
)
_CATEGORIES = "category, channel, genotype, image_file, object, treatment"
_FIRST_ROW = f"row_number() OVER (PARTITION BY {_CATEGORIES} ORDER BY object_id) = 1"
ORACLES["dedup_group_vars"] = _on_derived(
    f"SELECT {KEYS}, {ROUNDED}, group_volume FROM v QUALIFY {_FIRST_ROW}"
)
ORACLES["level_lists"] = with_view(
    " UNION ".join(
        f"SELECT '{name}' AS variable, {c} AS level FROM m"
        for name, c in {
            "Object": "object",
            "Image File": "image_file",
            "Treatment": "treatment",
            "Genotype": "genotype",
            "Channel": "channel",
        }.items()
    )
)
ORACLES["bin_thresholds"] = with_view(
    f"SELECT {KEYS}, volume, CAST(CASE WHEN volume <= 20 THEN 0 WHEN volume <= 50 THEN 1 "
    "WHEN volume <= 100 THEN 2 ELSE 3 END AS INTEGER) AS bin_order, "
    "CASE WHEN volume <= 20 THEN '<= 20' WHEN volume <= 50 THEN '(20,50]' "
    "WHEN volume <= 100 THEN '(50,100]' ELSE '> 100' END AS bin_volume FROM m"
)

# -- profiles and tests ------------------------------------------------------------------------

_PROFILED = {
    **{name: (c, family) for (name, c), family in zip(
        _DISPLAY.items(),
        ["Intensity variables"] * 3 + ["Shape variables"] * 2 + ["Distance variables"],
    )},
    "Intensity Sum Normalised per Nucleus": ("intensity_sum_normalised_per_nucleus", "Intensity variables"),
    "Ratio Ch1:Ch2 of Intensity Sum": ("ratio_ch1_ch2_of_intensity_sum", "Ratio variables"),
    "Group Volume": ("group_volume", "Group variables"),
    "Object Count": ("object_count", "Other variables"),
}
ORACLES["profile_numeric"] = _on_derived(
    " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round(1 - count({c}) / count(*), 6) AS missing, "
        f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, '{family}' AS family FROM v"
        for name, (c, family) in _PROFILED.items()
    )
)
ORACLES["profile_merged"] = with_view(
    " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round(1 - count({c}) / count(*), 6) AS missing, "
        f"round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd FROM m WHERE genotype = 'WT'"
        for name, c in _DISPLAY.items()
    )
)
ORACLES["profile_categorical"] = with_view(
    " UNION ALL ".join(
        f"SELECT '{name}' AS variable, count(DISTINCT {c}) AS levels, round(1 - count({c}) / count(*), 6) AS missing FROM m"
        for name, c in {
            "Category": "category",
            "Channel": "channel",
            "Genotype": "genotype",
            "Image File": "image_file",
            "Object": "object",
            "Object ID": "object_id",
            "Treatment": "treatment",
        }.items()
    )
)
ORACLES["boxplot_summary"] = with_view("""
, q AS (
  SELECT object, genotype, quantile_cont(intensity_mean, 0.25) AS lower, quantile_cont(intensity_mean, 0.5) AS middle,
         quantile_cont(intensity_mean, 0.75) AS upper, avg(intensity_mean) AS mean, count(intensity_mean) AS n
  FROM m WHERE intensity_mean IS NOT NULL GROUP BY object, genotype
),
b AS (
  SELECT q.object, q.genotype,
         min(intensity_mean) FILTER (WHERE intensity_mean >= lower - 1.5 * (upper - lower)) AS whisker_low,
         max(intensity_mean) FILTER (WHERE intensity_mean <= upper + 1.5 * (upper - lower)) AS whisker_high
  FROM m JOIN q ON m.object = q.object AND m.genotype = q.genotype GROUP BY q.object, q.genotype
)
SELECT object, genotype, round(lower, 6) AS lower, round(middle, 6) AS middle, round(mean, 6) AS mean,
       round(upper, 6) AS upper, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high,
       round(middle - 1.58 * (upper - lower) / sqrt(n), 6) AS notch_low,
       round(middle + 1.58 * (upper - lower) / sqrt(n), 6) AS notch_high, n
FROM q JOIN b USING (object, genotype)
""")
ORACLES["boxplot_summary_group"] = _on_derived(f"""
SELECT * FROM (
WITH g0 AS (SELECT object, genotype, group_volume AS x FROM v QUALIFY {_FIRST_ROW}),
g AS (SELECT object, genotype, CASE WHEN x = 0 THEN (SELECT min(x) FROM g0 WHERE x > 0) ELSE x END AS x FROM g0 WHERE x IS NOT NULL),
q AS (
  SELECT object, genotype, quantile_cont(x, 0.25) AS lower, quantile_cont(x, 0.5) AS middle,
         quantile_cont(x, 0.75) AS upper, avg(x) AS mean, count(x) AS n
  FROM g GROUP BY object, genotype
),
b AS (
  SELECT q.object, q.genotype, min(x) FILTER (WHERE x >= lower - 1.5 * (upper - lower)) AS whisker_low,
         max(x) FILTER (WHERE x <= upper + 1.5 * (upper - lower)) AS whisker_high
  FROM g JOIN q ON g.object = q.object AND g.genotype = q.genotype GROUP BY q.object, q.genotype
)
SELECT object, genotype, round(lower, 6) AS lower, round(middle, 6) AS middle, round(mean, 6) AS mean,
       round(upper, 6) AS upper, round(whisker_low, 6) AS whisker_low, round(whisker_high, 6) AS whisker_high,
       round(middle - 1.58 * (upper - lower) / sqrt(n), 6) AS notch_low,
       round(middle + 1.58 * (upper - lower) / sqrt(n), 6) AS notch_high, n
FROM q JOIN b USING (object, genotype))
""")
ORACLES["sample_points"] = with_view(f"SELECT {KEYS}, {ROUNDED} FROM m WHERE substr(md5(concat_ws('|', {KEYS})), 1, 8) < '4ccccccc'")
ORACLES["sample_exactly"] = with_view(
    f"SELECT {KEYS}, {ROUNDED} FROM m QUALIFY row_number() OVER (PARTITION BY object, channel "
    f"ORDER BY substr(md5(concat_ws('|', {KEYS})), 1, 15), {KEYS}) <= 500"
)
_FENCES = """
, s AS (SELECT volume AS x, row_number() OVER (ORDER BY volume) AS r, count(*) OVER () AS n
        FROM m WHERE volume IS NOT NULL),
p AS (SELECT max(n) AS n, floor((max(n) + 3) // 2) / 2.0 AS d FROM s),
h AS (SELECT avg(x) FILTER (WHERE r = floor(d)) / 2 + avg(x) FILTER (WHERE r = ceil(d)) / 2 AS lo,
             avg(x) FILTER (WHERE r = p.n + 1 - floor(d)) / 2 + avg(x) FILTER (WHERE r = p.n + 1 - ceil(d)) / 2 AS hi
      FROM s, p)
"""
_OUT = "(volume < lo - 1.5 * (hi - lo) OR volume > hi + 1.5 * (hi - lo))"
ORACLES["outliers"] = with_view(f"{_FENCES} SELECT {KEYS}, {ROUNDED} FROM m, h WHERE {_OUT}")
ORACLES["remove_outliers"] = with_view(
    f"{_FENCES} SELECT {KEYS}, {ROUNDED} FROM m, h WHERE NOT coalesce({_OUT}, false)"
)
ORACLES["avg_rank"] = """
WITH c AS (SELECT l_returnflag, l_extendedprice, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT l_returnflag, round(l_extendedprice, 6) AS l_extendedprice, n,
       CAST(sum(n) OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - n + (n + 1) / 2.0 AS DOUBLE) AS rank
FROM c
"""
ORACLES["avg_rank_fine"] = ORACLES["avg_rank"]
# erfc(z) for the upper tail of chi-square with one degree of freedom
_ERF = (
    "(2 / sqrt(pi()) * exp(-h / 2) * list_sum(list_transform(range(0, 400), "
    "lambda k: exp(k * ln(2.0) + (2 * k + 1) * ln(sqrt(h / 2)) - (lgamma(2.0 * k + 2) - k * ln(2.0) - lgamma(k + 1.0))))))"
)


def _p_text(p: str) -> str:
    return f"CASE WHEN {p} < 0.0001 THEN '<0.0001' WHEN {p} IS NOT NULL THEN printf('%.4f', {p}) END"


ORACLES["kruskal"] = with_view(f"""
, x AS (SELECT object, genotype, intensity_mean AS v FROM m WHERE intensity_mean IS NOT NULL),
r AS (SELECT *, rank() OVER (PARTITION BY object ORDER BY v) + (count(*) OVER (PARTITION BY object, v) - 1) / 2.0 AS rk,
             count(*) OVER (PARTITION BY object, v) AS t, count(*) OVER (PARTITION BY object) AS n FROM x),
g AS (SELECT object, genotype, max(n) AS n, count(*) AS k, sum(rk) AS s,
             sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM r GROUP BY object, genotype),
f AS (SELECT object, max(n) AS n, count(*) AS groups, sum(s * s / k) AS ss, sum(ties) AS ties FROM g GROUP BY object),
st AS (SELECT object, groups = 2 AS tested, CASE WHEN groups = 2 THEN n END AS n,
          CASE WHEN groups = 2 THEN (12.0 / (n * (n + 1.0)) * ss - 3 * (n + 1.0)) / nullif(1 - ties / (n * n * CAST(n AS DOUBLE) - n), 0) END AS h
       FROM f),
p AS (SELECT *, 1 - {_ERF} AS p FROM st),
c AS (SELECT *, least(p * (SELECT count(*) FROM st WHERE tested), 1.0) AS cp FROM p)
SELECT object, round(h, 6) AS statistic, n, round(p, 6) AS p_value, round(cp, 6) AS corrected_p_value,
       {_p_text('p')} AS p_text, {_p_text('cp')} AS corrected_p_text FROM c
""")
ORACLES["kruskal_fine"] = ORACLES["kruskal"]
ORACLES["anova"] = with_view(f"""
, g AS (SELECT object, treatment, count(*) AS n, avg(intensity_mean) AS a, var_pop(intensity_mean) * count(*) AS w
        FROM m WHERE intensity_mean IS NOT NULL GROUP BY object, treatment),
t AS (SELECT object, sum(n) AS nn, count(*) AS k, sum(w) AS ssw, sum(n * a) / sum(n) AS grand FROM g GROUP BY object),
s AS (SELECT t.object, max(nn) AS nn, max(k) AS k, max(ssw) AS ssw, sum(n * (a - grand) ** 2) AS ssb
      FROM g JOIN t USING (object) GROUP BY t.object),
fs AS (SELECT object, k, nn, CASE WHEN k > 1 AND nn > k AND ssw > 0
              THEN (ssb / (k - 1)) / (ssw / (nn - k)) END AS f FROM s),
y AS (SELECT *, (nn - k) / (nn - k + (k - 1) * f) AS y, (nn - k) / 2.0 AS a FROM fs),
p AS (SELECT *, CASE WHEN k = 5 THEN y ** a * (1 + a * (1 - y)) WHEN k = 3 THEN y ** a END AS p FROM y)
SELECT object, round(f, 6) AS statistic, CASE WHEN k > 1 THEN CAST(nn AS BIGINT) END AS n, round(p, 6) AS p_value,
       {_p_text('p')} AS p_text FROM p UNION ALL
SELECT object, NULL, NULL, NULL, NULL FROM m GROUP BY object HAVING count(intensity_mean) = 0
""")
# 1 - I_z(1/2, a) with z = r^2 and a = (n - 2) / 2
_T_TAIL = (
    "1 - list_sum(list_transform(range(0, 3000), lambda k: exp(lgamma(0.5 + a + k) - lgamma(0.5 + a) - lgamma(1.5 + k) "
    "+ lgamma(1.5) + k * ln(z)))) * exp(0.5 * ln(z) + a * ln(1 - z) + lgamma(0.5 + a) - lgamma(0.5) - lgamma(a)) * 2"
)
ORACLES["pearson"] = with_view(f"""
, c AS (SELECT object, channel, corr(intensity_mean, distance_to_nucleus) AS r, count(*) AS n FROM m
        WHERE intensity_mean IS NOT NULL AND distance_to_nucleus BETWEEN 1 AND 10 GROUP BY object, channel),
z AS (SELECT *, r * r AS z, (n - 2) / 2.0 AS a FROM c),
p AS (SELECT *, {_T_TAIL} AS p FROM z)
SELECT object, channel, round(r, 6) AS estimate, n, round(p, 6) AS p_value, {_p_text('p')} AS p_text FROM p
""")

ORACLES["pearson_all"] = ORACLES["pearson"].replace("distance_to_nucleus BETWEEN 1 AND 10", "distance_to_nucleus IS NOT NULL").replace(
    "corr(intensity_mean, distance_to_nucleus)",
    "CASE WHEN min(distance_to_nucleus) < max(distance_to_nucleus) THEN corr(intensity_mean, distance_to_nucleus) END",
)

# -- plots -------------------------------------------------------------------------------------


def _histogram(value: str, fill: str, where: str, per_panel: bool) -> str:
    over = "OVER (PARTITION BY object)" if per_panel else "OVER ()"
    return f"""
, d AS (SELECT object, {fill}, {value} AS v, min({value}) {over} AS lo,
               (max({value}) {over} - min({value}) {over}) / 29.0 AS w FROM m WHERE {where}),
hist AS (SELECT object, {fill}, CAST(ceil((v - (lo - w / 2)) / w) AS BIGINT) AS bin, count(*) AS count,
                min(lo) AS lo, min(w) AS w FROM d GROUP BY object, {fill}, bin)
SELECT object, {fill}, bin, count, round(lo + (bin - 1) * w, 6) AS x"""


ORACLES["histogram"] = with_view(
    _histogram("intensity_mean", "channel", "intensity_mean IS NOT NULL", False) + " FROM hist"
)
ORACLES["histogram_pct"] = with_view(
    _histogram("intensity_mean", "channel", "intensity_mean IS NOT NULL", True)
    + ", round(count / sum(count) OVER (PARTITION BY object), 6) AS percent FROM hist"
)
ORACLES["kde_pct"] = with_view(
    _histogram("volume", "genotype", "volume BETWEEN 0 AND 200", False)
    + ", round(count / sum(count) OVER (), 6) AS percent FROM hist"
)


def _density(split: str, where: str, own_range: bool) -> str:
    start, end = ("min(v)", "max(v)") if own_range else ("(SELECT min(v) FROM x)", "(SELECT max(v) FROM x)")
    return f"""
, x AS (SELECT {split}, genotype, volume AS v FROM m WHERE {where}),
s AS (SELECT {split}, genotype, count(*) AS n, stddev_samp(v) AS sd, min(v) AS mn, quantile_cont(v, 0.5) AS median,
             quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr, {start} AS st, {end} AS en
      FROM x GROUP BY {split}, genotype HAVING count(*) >= 2),
b AS (SELECT *, 0.9 * coalesce(nullif(least(sd, iqr / 1.34), 0), nullif(sd, 0), nullif(abs(mn), 0), 1.0)
             * n ** -0.2 AS bw FROM s),
f AS (SELECT *, st - 4 * bw AS lo, ((en + 4 * bw) - (st - 4 * bw)) / 511 AS step FROM b),
w AS (SELECT {split}, genotype, bw, floor((v - lo) / step) AS c, (v - lo) / step - floor((v - lo) / step) AS fr
      FROM x JOIN f USING ({split}, genotype)),
g AS (SELECT {split}, genotype, c, sum(wt) AS wt FROM (
        SELECT {split}, genotype, c, 1 - fr AS wt FROM w UNION ALL SELECT {split}, genotype, c + 1, fr FROM w)
      GROUP BY {split}, genotype, c),
k AS (SELECT f.{split}, f.genotype, e.i, sum(g.wt / n * exp(-0.5 * ((e.i - g.c) * step / bw) ** 2)) / (max(bw) * sqrt(2 * pi())) AS y
      FROM f JOIN g USING ({split}, genotype), (SELECT unnest(range(0, 512)) AS i) e
      GROUP BY f.{split}, f.genotype, e.i),
e AS (SELECT f.*, p.point, st + p.point * ((en - st) / 511) AS xx, (st + p.point * ((en - st) / 511) - lo) / step AS pos
      FROM f, (SELECT unnest(range(0, 512)) AS point) p),
y AS (SELECT e.*, k1.y + (pos - k1.i) * (k2.y - k1.y) AS density
      FROM e JOIN k k1 ON k1.{split} = e.{split} AND k1.genotype = e.genotype AND k1.i = floor(pos)
             JOIN k k2 ON k2.{split} = e.{split} AND k2.genotype = e.genotype AND k2.i = floor(pos) + 1)
SELECT {split}, genotype, CAST(point AS INTEGER) AS point, round(xx, 6) AS {'y' if own_range else 'x'},
       round(density * 1e6, 6) AS density, round(density * n, 6) AS count,
       round(density / max(density) OVER (PARTITION BY {split}, genotype), 6) AS scaled, n
       {', round(median, 6) AS median' if own_range else ''} FROM y"""


ORACLES["kde"] = with_view(_density("object", "volume IS NOT NULL", False))
ORACLES["violin"] = with_view(_density("treatment", "volume BETWEEN 0 AND 200", True))
ORACLES["density2d"] = with_view("""
, x AS (SELECT genotype, volume AS x, area AS y FROM m WHERE volume BETWEEN 0 AND 200 AND area BETWEEN 0 AND 30),
l AS (SELECT min(x) AS lx, max(x) - min(x) AS wx, min(y) AS ly, max(y) - min(y) AS wy FROM x),
f AS (SELECT genotype, count(*) AS n,
        1.06 * least(stddev_samp(x), (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.34) * count(*) ** -0.2 AS hx,
        1.06 * least(stddev_samp(y), (quantile_cont(y, 0.75) - quantile_cont(y, 0.25)) / 1.34) * count(*) ** -0.2 AS hy
      FROM x GROUP BY genotype),
p AS (SELECT genotype, (x - lx) / (wx / 396) AS px, (y - ly) / (wy / 396) AS py FROM x, l),
c AS (SELECT genotype, floor(px) AS i, floor(py) AS j, px - floor(px) AS fx, py - floor(py) AS fy FROM p),
w AS (SELECT genotype, i, j, sum(w) AS w FROM (
        SELECT genotype, i, j, (1 - fx) * (1 - fy) AS w FROM c UNION ALL SELECT genotype, i + 1, j, fx * (1 - fy) FROM c
        UNION ALL SELECT genotype, i, j + 1, (1 - fx) * fy FROM c UNION ALL SELECT genotype, i + 1, j + 1, fx * fy FROM c)
      GROUP BY genotype, i, j),
a AS (SELECT unnest(range(0, 100)) AS at),
s1 AS (SELECT genotype, a.at AS gx, j, sum(w * exp(-0.5 * ((a.at * 4 - i) * (wx / 396) / hx) ** 2)) AS w
       FROM w JOIN f USING (genotype), l, a GROUP BY genotype, a.at, j),
s2 AS (SELECT genotype, gx, a.at AS gy, sum(w * exp(-0.5 * ((a.at * 4 - j) * (wy / 396) / hy) ** 2)) / max(n * hx * hy * 2 * pi()) AS z,
              max(n) AS n
       FROM s1 JOIN f USING (genotype), l, a GROUP BY genotype, gx, a.at)
SELECT genotype, CAST(gx AS INTEGER) AS i, CAST(gy AS INTEGER) AS j, round(lx + gx * wx / 99, 6) AS x,
       round(ly + gy * wy / 99, 6) AS y, round(z * 1e6, 6) AS density,
       round(z / max(z) OVER (PARTITION BY genotype), 6) AS ndensity, n FROM s2, l
""")
ORACLES["kde_pct_all"] = ORACLES["kde_pct"].replace("volume BETWEEN 0 AND 200", "volume IS NOT NULL")
ORACLES["violin_all"] = ORACLES["violin"].replace("volume BETWEEN 0 AND 200", "volume IS NOT NULL")
ORACLES["density2d_all"] = ORACLES["density2d"].replace(
    "volume BETWEEN 0 AND 200 AND area BETWEEN 0 AND 30", "volume IS NOT NULL AND area IS NOT NULL"
)
_ONE_PANEL = _density("panel", "volume IS NOT NULL", False).replace("FROM m WHERE", "FROM (SELECT *, 1 AS panel FROM m) WHERE")
ORACLES["density_peak"] = with_view(_ONE_PANEL.rpartition("SELECT panel,")[0] + "SELECT round(max(density) * 1e6, 6) AS max FROM y")
ORACLES["joint_ranges"] = with_view(
    " UNION ALL ".join(
        f"SELECT '{name}' AS variable, round(min({c}), 6) AS min, round(max({c}), 6) AS max FROM m "
        "WHERE volume IS NOT NULL AND intensity_mean IS NOT NULL"
        for name, c in {"Volume": "volume", "Intensity Mean": "intensity_mean"}.items()
    )
)
ORACLES["neighbour_distances"] = with_view(
    f"SELECT {KEYS}, volume AS distance_to_3_nearest_neighbours, "
    "CASE WHEN channel = '1' THEN area END AS distance_to_5_nearest_neighbours, "
    "CAST(NULL AS DOUBLE) AS distance_to_9_nearest_neighbours FROM m"
)
ORACLES["scatter_data"] = with_view(
    "SELECT image_file, treatment, genotype, round(intensity_mean, 6) AS intensity_mean, distance_to_nucleus, object, "
    "channel, round(ln(intensity_mean), 6) AS log_intensity_mean, "
    "round(CASE WHEN distance_to_nucleus > 0 THEN ln(distance_to_nucleus) END, 6) AS log_distance_to_nucleus "
    "FROM m WHERE intensity_mean BETWEEN 1e4 AND 6e4 AND distance_to_nucleus BETWEEN 0 AND 8"
)
ORACLES["plot_data_1d"] = _on_derived(
    "SELECT DISTINCT image_file, treatment, genotype, group_volume, channel, object FROM v "
    "WHERE group_volume BETWEEN 0 AND 2000"
)
