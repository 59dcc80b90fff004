from pyspark.sql import functions as F
from helpers import GOLDEN, close, frame, table

from morphotab import schema as S
from morphotab.functions.columns import col
from morphotab.operators import bins, plotdata, quality, select, summary


def ids(df):
    return sorted((r[S.IMAGE], r[S.OBJECT], r[S.CHANNEL], r[S.OBJECT_ID]) for r in df.collect())


def test_bins(spark):
    df = frame(spark, {"x": "d"}, [(-1.0,), (0.0,), (0.5,), (1.0,), (2.0,), (None,)])
    expected = ["<= 0", "<= 0", "(0,1]", "(0,1]", "> 1", "> 1"]
    for cuts in ("0,1", "1, 0", [0.0, 1.0]):
        out = bins.bin_thresholds(df, "x", cuts).collect()
        assert [r["Bin -  x"] for r in out] == expected
        assert [r["Bin Order"] for r in out] == [0, 0, 1, 1, 2, 2]
    assert bins.bin_thresholds(df, "x", "0,1", null_label="none").collect()[-1]["Bin -  x"] == "none"
    assert bins.bin_thresholds(df, "x", "0,1", null_label=None).collect()[-1]["Bin -  x"] is None
    assert {r["Bin -  x"] for r in bins.bin_thresholds(df, "x", "0").collect()} == {"<= 0", "> 0"}


def test_lift_zeros(spark):
    df = frame(spark, {"x": "d"}, [(0.0,), (0.2,), (3.0,), (None,), (-1.0,)])
    assert [r["x"] for r in select.lift_zeros(df, "x").collect()] == [0.2, 0.2, 3.0, None, -1.0]


def test_sample_is_repeatable_and_whole_below_its_size(spark):
    df = spark.range(500).selectExpr("CAST(id AS STRING) k")
    a = {r["k"] for r in bins.sample_points(df, ["k"], 0.1).collect()}
    b = {r["k"] for r in bins.sample_points(df.repartition(7), ["k"], 0.1).collect()}
    assert a == b and 25 < len(a) < 80
    assert bins.sample_points(df, ["k"], 1).count() == 500


def test_eligible_references(spark):
    rows = [
        (i, "Surface", o, "1", str(n), *[1.0] * 6)
        for n, (i, o) in enumerate([("A", "X"), ("B", "X"), ("A", "Y"), ("B", "Y"), ("B", "Y"), ("A", "Nucleus")])
    ]
    assert sorted(r[S.OBJECT] for r in quality.eligible_references(table(spark, rows)).collect()) == ["Nucleus", "X"]
    no_nucleus = [r for r in rows if r[2] != "Nucleus"]
    assert [r[S.OBJECT] for r in quality.eligible_references(table(spark, no_nucleus)).collect()] == ["X"]


def test_channel_pairs(spark):
    rows = [("A", "Surface", "X", c, "1", *[1.0] * 6) for c in ("1", "2", "3", "1", None)]
    out = {(r["a"], r["b"], r["label"]) for r in quality.channel_pairs(table(spark, rows)).collect()}
    assert out == {(a, b, f"Ch{a}:Ch{b}") for a in "123" for b in "123" if a != b}


def test_integrity(spark):
    rows = [*GOLDEN, ("B", "Spot", "blob", None, "1", *[None] * 6), ("B", "Spot", "blob", "NA", "2", *[1.0] * 6)]
    df = table(spark, rows)
    assert [(r[S.OBJECT], r[S.IMAGE]) for r in quality.unexpected_labels(df).collect()] == [("blob", "B")]
    for label in (S.NUCLEUS, S.CENTER_OF_MASS):
        assert [r[S.IMAGE] for r in quality.images_without_object(df, label).collect()] == ["B"]
    assert ids_of(quality.null_channel_rows(df)) == [("B", "1"), ("B", "2")]
    assert quality.images_with_null_column(df).count() == 0
    empty = df.withColumn("never", frame(spark, {"x": "d"}, [(None,)]).scalar())
    assert sorted(r[S.IMAGE] for r in quality.images_with_null_column(empty).collect()) == ["A", "B"]


def ids_of(df):
    return sorted((r[S.IMAGE], r[S.OBJECT_ID]) for r in df.collect())


def test_filters(spark):
    df = table(spark, [*GOLDEN, ("A", "Surface", "CC", None, "3", None, None, None, None, None, None)])
    assert select.select_levels(df, {S.OBJECT: ["CC"], S.CHANNEL: ["1"]}).count() == 2
    assert select.range_filter(df, S.VOLUME, 5.0, 10.0).count() == 3
    # the other channel and the row without one pass; a missing value in the channel does not
    assert ids(select.range_filter(df.na.drop(subset=[S.CHANNEL]), S.VOLUME, 10.0, 50.0, "1")) == [
        ("A", "CC", "1", "2"), ("A", "CC", "2", "1"), ("A", "Nucleus", "1", "0"), ("A", "Nucleus", "2", "0")
    ]
    assert select.range_filter(df, S.VOLUME, 10.0, 50.0, "1").count() == 5
    assert select.rect_filter(df, S.VOLUME, S.AREA, (5.0, 10.0), (10.0, 12.0)).count() == 2
    kept = select.select_numeric(df, [S.VOLUME])
    assert kept.columns == [*S.KEYS, S.VOLUME]
    assert select.select_columns(df, [S.AREA, S.IMAGE]).columns == [S.AREA, S.IMAGE]


def test_finite_range(spark):
    inf = float("inf")
    df = frame(spark, {"x": "d", "y": "d"}, [(1.0, None), (inf, 2.0), (float("nan"), 3.0), (5.0, 4.0), (-inf, -9.0)])
    out = {r["Variable"]: (r["Min"], r["Max"]) for r in select.finite_range(df, ["x", "y"]).collect()}
    assert out == {"x": (1.0, 5.0), "y": (-9.0, 4.0)}
    joint = {r["Variable"]: (r["Min"], r["Max"]) for r in select.finite_range(df, ["x", "y"], jointly=True).collect()}
    assert joint == {"x": (5.0, 5.0), "y": (4.0, 4.0)}


def test_levels(spark):
    out = select.level_lists(table(spark, GOLDEN), [S.OBJECT, S.CHANNEL]).collect()
    assert [(r["Variable"], r["Level"]) for r in out] == [
        ("Channel", "1"), ("Channel", "2"), ("Object", "CC"), ("Object", "Nucleus"), ("Object", S.CENTER_OF_MASS)
    ]


def test_group_values_appear_once(spark):
    df = table(spark, GOLDEN).withColumn("Group Volume", frame(spark, {"v": "d"}, [(15.0,)]).scalar())
    once = select.dedup_group_values(df)
    assert ids(once.where("Object = 'CC'")) == [("A", "CC", "1", "1"), ("A", "CC", "2", "1")]
    data = plotdata.plot_data_1d(df, "Group Volume", S.CHANNEL, S.OBJECT, (0.0, 20.0))
    assert data.count() == 5
    plain = plotdata.plot_data_1d(df, S.VOLUME, S.CHANNEL, S.OBJECT, (0.0, 20.0))
    assert plain.count() == 3


def test_scatter_data(spark):
    df = plotdata.scatter_data(table(spark, GOLDEN), S.VOLUME, "Distance to Nucleus", S.OBJECT, (0, 60), (0, 9))
    out = df.where("Object = 'Nucleus'").first()
    assert out["Log(Distance to Nucleus)"] is None and close(out["Log(Volume)"], 3.912023005428146)
    assert df.columns[:3] == ["Image File", "Treatment", "Genotype"]


def test_profiles(spark):
    df = table(spark, GOLDEN).withColumnRenamed(S.AREA, "Ratio Ch1:Ch2 of Intensity Sum")
    rows = {r["Variable"]: r.asDict() for r in summary.profile_numeric(df).collect()}
    assert close(rows[S.VOLUME]["Missing"], 1 / 6) and close(rows[S.VOLUME]["Mean"], 24.0)
    assert rows[S.VOLUME]["Family"] == "Shape variables"
    assert rows["Ratio Ch1:Ch2 of Intensity Sum"]["Family"] == "Ratio variables"
    assert rows["Distance to Nucleus"]["Family"] == "Distance variables"
    levels = {r["Variable"]: (r["Levels"], r["Missing"]) for r in summary.profile_categorical(df).collect()}
    assert levels[S.OBJECT] == (3, 0.0) and levels[S.OBJECT_ID] == (4, 0.0)
    rough = {r["Variable"]: r["Levels"] for r in summary.profile_categorical(df, approximate=True).collect()}
    assert rough[S.OBJECT] == 3


def test_many_levels_are_a_semi_join(spark):
    """100,000 chosen levels, as a list or a table, with NULL and repeats: no literal list, and a join that fits their size."""
    df = spark.range(0, 300_000, 3).selectExpr("CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id AS STRING) END k", "id")
    chosen = [str(k) for k in range(200_000, 300_000)] + [None, "200001"]
    out = select.select_levels(df, {"k": chosen})
    expected = {k for k in range(0, 300_000, 3) if k % 9 and k >= 200_000}
    assert {r["id"] for r in out.collect()} == expected and out.columns == df.columns
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan and "BroadcastHashJoin" in plan and "199999" not in plan
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1")
    try:
        large = select.select_levels(df, {"k": spark.createDataFrame([(c,) for c in chosen[::-1]], "k string")})
        plan = large._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" in plan and "BroadcastHashJoin" not in plan and {r["id"] for r in large.collect()} == expected
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert select.select_levels(df, {"k": ["3", "6"]}).count() == 2


def test_integrity_reads_the_table_once(spark):
    """All reports equal the separate ones, and only the counts are read again."""
    base = table(spark, GOLDEN)
    df = base.withColumn(S.CHANNEL, F.when(col(S.OBJECT) == "CC", F.lit("NA")).otherwise(F.when(col(S.OBJECT_ID) != "9", col(S.CHANNEL))))
    df = df.unionByName(df.where(col(S.OBJECT) == "CC")).unionByName(base.withColumns({S.IMAGE: F.lit("B"), S.OBJECT: F.lit("odd"), S.AREA: F.lit(None).cast("double")}))
    found = quality.Integrity(df)
    rows = lambda d: sorted(map(str, (tuple(r) for r in d.collect())))
    assert rows(found.unexpected_labels()) == rows(quality.unexpected_labels(df))
    assert rows(found.images_without_object(S.NUCLEUS)) == rows(quality.images_without_object(df, S.NUCLEUS)) == ["('B',)"]
    assert rows(found.images_with_null_column()) == rows(quality.images_with_null_column(df)) == ["('B',)"]
    assert rows(found.null_channel_rows()) == rows(quality.null_channel_rows(df)) and found.null_channel_rows().count() == 7
    assert tuple(found.rows().first()) == (df.count(), 2)
    empty = quality.Integrity(df.limit(0))
    assert empty.null_channel_rows().count() == 0 and tuple(empty.rows().first()) == (0, 0)


def test_profiles_merge(spark):
    df = spark.range(3000).selectExpr("CAST(id % 7 AS STRING) image", "CASE WHEN id % 5 > 0 THEN 1e6 + id END x", "CASE WHEN id % 7 < 6 THEN NULL ELSE 1D END y", "CAST(id % 40 AS STRING) s")
    states = summary.profile_state(df, "image")
    assert states.count() == 7 * 4
    merged = {r["Variable"]: r for r in summary.merged_profile(states.repartition(3)).collect()}
    for r in summary.profile_numeric(df).collect():
        m = merged[r["Variable"]]
        assert all(abs(m[c] - r[c]) < 1e-9 * max(1, abs(r[c])) for c in ("Missing", "Mean", "SD")) and m["Levels"] is None
    assert merged["s"]["Levels"] == 40 and merged["s"]["Mean"] is None and merged["image"]["Levels"] == 7
    some = summary.merged_profile(states.where("image <> '3'"))
    wanted = summary.profile_numeric(df.where("image <> '3'"), ["x"]).first()
    got = some.where("Variable = 'x'").first()
    assert abs(got["SD"] - wanted["SD"]) < 1e-9 * wanted["SD"]
