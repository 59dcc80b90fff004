import pytest
from helpers import frame, table

from morphotab import schema as S
from morphotab.operators import clean
from morphotab.sources import stat_tree, tables

PREAMBLE = " \n{name}\n====================\n"
KEY_TYPES = {n: "s" for n in S.KEYS}


def test_pivots(spark):
    rows = [("A", "1", "CC", 2.0), ("A", "1", None, None)]
    df = frame(spark, {"Image File": "s", "Object ID": "s", "Surfaces": "s", "Shortest Distance to Surfaces": "d"}, rows)
    out = clean.pivot_surfaces(df, ["Image File", "Object ID"])
    assert out.columns == ["Image File", "Object ID", "Shortest Distance to Surfaces - CC"]
    assert [tuple(r) for r in out.collect()] == [("A", "1", 2.0)]
    spots = df.withColumnsRenamed({"Surfaces": "Spots", "Shortest Distance to Surfaces": "Shortest Distance to Spots"})
    assert clean.pivot_spots(spots, ["Image File", "Object ID"]).columns[-1] == "Distance to Spot CC"
    assert clean.pivot_spots(df, ["Image File"]) is df


def test_retained_columns():
    names = ["Unit", "Volume", "intensity sum", "Collection", "ID", "Category", "Ellipticity (oblate)", "Height", "Width"]
    # Width holds the letters of ID
    assert clean.retained_columns(names) == [
        "Volume", "intensity sum", "ID", "Category", "Ellipticity (oblate)", "Width"
    ]


def test_coalesce_rows_prefers_the_first_source(spark):
    df = frame(spark, {"k": "s", "a": "d", "b": "d", "p": "s"}, [("x", None, 2.0, "1"), ("x", 5.0, 3.0, "2"), ("x", 4.0, None, "3")])
    assert [tuple(r) for r in clean.coalesce_rows(df, ["k"], "p").collect()] == [("x", 5.0, 2.0)]
    assert [tuple(r) for r in clean.coalesce_rows(df.drop("p"), ["k"]).collect()] == [("x", 4.0, 2.0)]


def test_fill_down_up(spark):
    df = frame(spark, {"k": "s", "c": "s", "v": "d"}, [("x", "1", None), ("x", "2", 5.0), ("x", "3", None), ("y", "1", None)])
    out = sorted(tuple(r) for r in clean.fill_down_up(df, ["k"], ["v"], ["c"]).collect() if r["k"] == "x")
    assert out == [("x", "1", 5.0), ("x", "2", 5.0), ("x", "3", 5.0)]


def test_neighbour_distances_become_numbers(spark):
    df = frame(spark, {"Average Distance To 3 Nearest Neighbours": "s"}, [("1.5",), ("x",)])
    out = clean.rename_neighbour_distances(df)
    assert out.columns == ["Distance To 3 Nearest Neighbours"]
    assert [r[0] for r in out.collect()] == [1.5, None]


def test_labels(spark):
    df = frame(spark, {"Object": "s"}, [(n,) for n in [*S.CENTER_OF_MASS_SPELLINGS, "CC", None]])
    assert [r[0] for r in clean.unify_labels(df).collect()] == [S.CENTER_OF_MASS] * 3 + ["CC", None]


def harmonise_rows(spark):
    values = {"Intensity Sum": "d", "Volume": "d", "Surfaces": "s", "Shortest Distance to Surfaces": "d", "p": "s"}
    key = lambda channel, n="1": ("WT", "light", "A", "Surface", "CC", channel, n)
    rows = [
        (*key("1"), 10.0, None, None, None, "i1"),
        (*key("2"), 20.0, None, None, None, "i2"),
        (*key(None), None, 5.0, None, None, "v2"),
        (*key(None), None, 6.0, None, None, "v1"),
        (*key(None), None, None, "Nucleus", 0.5, "s1"),
        (*key(None), None, None, None, None, "s2"),
        (*key(None, "2"), None, 9.0, None, None, "v1"),
        (*key("2", "3"), 7.0, None, None, None, "i2"),
    ]
    return frame(spark, KEY_TYPES | values, rows)


def test_harmonise(spark):
    out = clean.harmonise(harmonise_rows(spark), order_by="p")
    got = {(r["Object ID"], r["Channel"]): r.asDict() for r in out.collect()}
    assert set(got) == {("1", "1"), ("1", "2"), ("3", "2")}
    assert got[("1", "1")]["Volume"] == got[("1", "2")]["Volume"] == 6.0
    assert got[("1", "1")]["Intensity Sum"] == 10.0
    assert got[("1", "2")]["Shortest Distance to Surfaces - Nucleus"] == 0.5
    assert got[("3", "2")]["Volume"] is None
    assert out.columns[:7] == S.KEYS


def test_harmonise_spreads_rows_without_time(spark):
    key = lambda channel, n="1": ("WT", "light", "A", "Surface", "CC", channel, n)
    rows = [
        (*key("1"), "1", 10.0, None, None),
        (*key("1"), "2", 20.0, None, None),
        (*key(None), None, None, 7.0, 1.0),
        (*key(None), "2", None, None, 3.0),
        (*key("1", "2"), "1", 30.0, None, None),
    ]
    types = KEY_TYPES | {"Time": "s", "Intensity Sum": "d", "Volume": "d", "Area": "d"}
    out = clean.harmonise(frame(spark, types, rows)).collect()
    got = {(r["Object ID"], r["Time"]): (r["Intensity Sum"], r["Volume"], r["Area"]) for r in out}
    assert got == {("1", "1"): (10.0, 7.0, 1.0), ("1", "2"): (20.0, 7.0, 3.0), ("2", "1"): (30.0, None, None)}


def test_harmonise_ignores_row_order(spark):
    df = harmonise_rows(spark)
    a = sorted(map(str, clean.harmonise(df, order_by="p").collect()))
    b = sorted(map(str, clean.harmonise(df.orderBy(df.p.desc()).repartition(5), order_by="p").collect()))
    assert a == b


def write(path, name, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(PREAMBLE.format(name=name) + "\n".join(lines) + "\n")


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree+1 %")
    for image in ("img one", "img2"):
        folder = root / "WT" / "dark + light" / f"{image}_Statistics"
        for channel in ("1", "2"):
            write(
                folder / f"{image}_Intensity_Sum_Ch={channel}_Img=1.csv",
                "Intensity Sum",
                [
                    "Intensity Sum,Unit,Category,Channel,Image,Surpass Object,Time,ID,",
                    f"{channel}0.5,,Surface,{channel},Image 1,CC,1,7,",
                    f"NA,,Surface,{channel},Image 1,\"Nucleus, left\",1,0,",
                    f"3.0,,Spot,{channel},Image 1,Nucleus_centre_of_mass,1,9,",
                ],
            )
        write(
            folder / f"{image}_Volume.csv",
            "Volume",
            [
                "Volume,Unit,Category,Surpass Object,Time,ID,",
                "5.25,um^3,Surface,CC,1,7,",
                "50,um^3,Surface,\"Nucleus, left\",1,0,",
                "8,um^3,Surface,CC,1,99,",
            ],
        )
        write(
            folder / f"{image}_Shortest_Distance_to_Surfaces_Surfaces=CC.csv",
            "Shortest Distance to Surfaces",
            ["Shortest Distance to Surfaces,Unit,Category,Surfaces,Surpass Object,Time,ID,", "0.75,um,Surface,CC,CC,1,7,"],
        )
        write(
            folder / f"{image}_Average_Distance_To_3_Nearest_Neighbours.csv",
            "Average Distance To 3 Nearest Neighbours",
            ["Average Distance To 3 Nearest Neighbours,Unit,Category,Surpass Object,Time,ID,", "1.5,um,Surface,CC,1,7,"],
        )
        write(folder / f"{image}_Position_X.csv", "Position X", ["Position X,Unit,Category,Surpass Object,Time,ID,", "1,um,Surface,CC,1,7,"])
        write(folder / f"{image}_Area.csv", "Area", ["Area,Unit,Category,Surpass Object,Time,ID," + " " * 90])
        (folder / f"{image}_Sphericity.csv").write_text("tiny\n")
    return root


@pytest.fixture(params=["200b", "128mb"])
def split_size(spark, request):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
    spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_tree(spark, tree, split_size):
    """One rule for files of any size: the splits they are read in do not matter."""
    out = stat_tree.read_stat_tree(spark, str(tree))
    got = {(r["Image File"], r["Object"], r["Channel"]): r.asDict() for r in out.collect()}
    assert set(got) == {
        (i, o, c)
        for i in ("img one", "img2")
        for o in ("CC", "Nucleus, left", "Nucleus Center of Mass")
        for c in ("1", "2")
    }
    row = got[("img one", "CC", "2")]
    assert row["Genotype"] == "WT" and row["Treatment"] == "dark + light"
    assert row["Intensity Sum"] == 20.5 and row["Volume"] == 5.25 and row["Object ID"] == "7"
    assert row["Shortest Distance to Surfaces - CC"] == 0.75
    assert row["Distance To 3 Nearest Neighbours"] == 1.5
    assert row["Image Subset"] == "Image 1" and row["Time"] == "1"
    assert got[("img2", "Nucleus, left", "1")]["Intensity Sum"] is None
    assert "Position X" not in out.columns and "Unit" not in out.columns
    assert out.columns[:7] == S.KEYS and out.columns[-2:] == S.TRAILING


ODD = {
    "Short": ["Volume,Unit,Category,Surpass Object,Time,ID,", "1.5", "2.5,um,Surface,CC,1,2,,,more", "", "  ", "3.5,um,Surface"],
    "HeaderLike": ["Volume,Category,ID", "Volume,Category,ID", "4.5,Spot,4", '"Volume",Category,"ID"'],
    "NoID": ["Volume,Category,Surpass Object", "5.5,Surface,CC"],
    "Quoted": ['"Volume","Unit, long","Category","ID"', '6.5,"a, ""b""",Surface,6'],
    "OnlyHeader": ["Volume,Unit,Category,ID" + " " * 90],
    "Long": ["Volume,Category,ID", *[f"{k}.25,Surface,{k}" for k in range(60)]],
}


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_rows_of_odd_files(spark, tmp_path, split_size, line_end):
    """Short rows, rows like the header, headers without mandatory columns and quoted commas, in splits of any size."""
    folder = tmp_path / split_size / "WT" / "dark" / "img_Statistics"
    folder.mkdir(parents=True)
    for name, lines in ODD.items():
        (folder / f"{name}.csv").write_bytes(line_end.join([" ", name, "=" * 20, *lines, ""]).encode())
    (folder / "ThreeLines.csv").write_bytes(line_end.join([" ", "x", "y"]).encode())
    (folder / "BlankHeader.csv").write_bytes(line_end.join([" ", "x", "y", "", "1,2,3"]).encode())
    out = stat_tree.read_stat_rows(spark, str(tmp_path / split_size))
    rows = out.collect()
    got = [(r["_path"].rpartition("/")[2][:-4], r["Volume"], r["Category"], r["Object ID"], r["Image File"]) for r in rows if "Long" not in r["_path"]]
    assert sorted(map(str, got)) == sorted(
        str((*x, "img"))
        for x in [
            ("Short", 1.5, None, None),
            ("Short", 2.5, "Surface", "2"),
            ("Short", 3.5, "Surface", None),
            ("HeaderLike", None, "Category", "ID"),
            ("HeaderLike", 4.5, "Spot", "4"),
            ("HeaderLike", None, "Category", "ID"),
            ("NoID", 5.5, "Surface", None),
            ("Quoted", 6.5, "Surface", "6"),
        ]
    )
    long = sorted((r["Volume"], r["Object ID"]) for r in rows if "Long" in r["_path"])
    assert long == sorted((k + 0.25, str(k)) for k in range(60))


def test_csv_upload(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "Object ID,Channel,Volume,Genotype,Treatment,Image File,Category,Object,Time,\n"
        "1,1,2.5,WT,d,A,Surface,CC,1,x\n1,1,2.5,WT,d,A,Surface,CC,1,x\n2,NA,NA,WT,d,A,Surface,CC,1,x\n"
        "3,1,Infinity,WT,d,A,Surface,CC,1,x\n"
    )
    out = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert out.columns == [*S.KEYS, "Volume", "Time"]
    rows = sorted((r["Object ID"], r["Channel"], r["Volume"]) for r in out.collect())
    assert rows == [("1", "1", 2.5), ("2", "NA", None), ("3", "1", None)]


def test_round_trip(spark, tmp_path):
    df = table(spark, [("A", "Surface", "CC", "1", "1", 0.1, None, 1e-300, 3.0, 1 / 3, -2.5)])
    tables.write_table(df, str(tmp_path / "csv"))
    assert tables.read_table(spark, str(tmp_path / "csv")).collect() == df.collect()
    tables.write_table(df, str(tmp_path / "pq"), "parquet", [S.GENOTYPE, S.TREATMENT])
    assert (tmp_path / "pq" / "Genotype=WT" / "Treatment=light").is_dir()


def test_skip_patterns_are_regular_expressions(spark):
    df = frame(spark, {"p": "s"}, [("x/Diameter.csv",), ("x/DiameterXcsv",), ("x/MyTime.csv",), ("x/Volume.csv",)])
    assert [r["p"] for r in stat_tree.skip_listed_files(df, "p").collect()] == ["x/Volume.csv"]
    assert len(S.SKIPPED_FILES) == 29 and len(S.RETAINED_TOKENS) == 19


def test_harmonise_deals_rows_out_once(spark):
    """The aggregation and the windows share one exchange and one sort."""
    out = clean.harmonise(harmonise_rows(spark), order_by="p", surfaces=["Nucleus"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1


def test_headers_are_taken_apart_before_they_meet_the_rows(spark, tree):
    plan = stat_tree.read_stat_rows(spark, str(tree))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("map_from_entries")


def test_skip_patterns_of_any_kind(spark):
    df = frame(spark, {"p": "s"}, [("x/Volume.csv",), ("x/Area.csv",), ("x/Sphericity.csv",)])
    for patterns, kept in ((["Area.csv", "Vol"], [2]), (["Q?Area", "ume|icity"], []), (["^y"], [0, 1, 2])):
        assert [r["p"] for r in stat_tree.skip_listed_files(df, "p", patterns).collect()] == [df.collect()[k]["p"] for k in kept]
    assert "(?=[" in stat_tree.skipped_file(df.p)._jc.toString()


@pytest.mark.parametrize("line_end", ["\n", "\r\n", "\r"])
def test_whole_files_and_lines_of_splits_follow_one_rule(spark, tmp_path, split_size, line_end):
    folder = tmp_path / "WT" / "dark" / "img_Statistics"
    folder.mkdir(parents=True)
    odd = ODD | {"Control": ["Volume,Category,ID", "1.5,\tSurface\t,7", "NA, Spot ,8", "\t,Spot,9"]}
    for name, lines in odd.items():
        (folder / f"{name}.csv").write_bytes(line_end.join([" ", name, "=" * 20, *lines, ""]).encode())
    read = lambda whole: sorted(map(str, stat_tree.read_stat_rows(spark, str(tmp_path), whole).collect()))
    as_lines = read(0)
    assert len(as_lines) == 71 and "Category='Surface', Object ID='7'" in "".join(as_lines)
    assert read(150) == read(1 << 20) == as_lines  # some files larger, none


def test_rows_of_whole_files_are_not_shuffled(spark, tree):
    """A file's header stands in the row of its lines, and values are ordered by the number of their file."""
    plan = stat_tree.read_stat_rows(spark, str(tree))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    files = stat_tree.StatTree(spark, str(tree))
    numbered = files.rows().select("_file", stat_tree.SOURCE).distinct().orderBy("_file").collect()
    assert [r[1] for r in numbered] == sorted(r[1] for r in numbered) and len({r[0] for r in numbered}) == len(numbered)
    assert files.levels("Surfaces") == ["CC"] and files.levels("Spots") == []


def test_written_statistics_files(spark, tmp_path):
    rows = [("W/T", "a b", f"i{k % 3}", f"{k}.5,x", f"{k},y") for k in range(30)] + [(None, "", "i0", "9.5,x", "9,y")]
    df = frame(spark, {n: "s" for n in ["G", "T", "I", "Volume", "Intensity Sum"]}, rows).repartition(5)
    stat_tree.write_stat_files(df, str(tmp_path / "tree"), ["G", "T", "I"], {"Volume": " \nVolume\n==\nVolume,C\n", "Intensity Sum": "sum\n"})
    null = "__HIVE_DEFAULT_PARTITION__"
    folders = [f"G=W%2FT/T=a b/I=i{k}" for k in range(3)] + [f"G={null}/T={null}/I=i0"]
    names = sorted(f"{f}/{n}" for f in folders for n in ("Volume.csv", "Intensity_Sum.csv"))
    assert sorted(str(p.relative_to(tmp_path / "tree")) for p in (tmp_path / "tree").rglob("*") if p.is_file()) == names
    lines = (tmp_path / "tree" / folders[1] / "Volume.csv").read_text().splitlines()
    assert lines[:4] == [" ", "Volume", "==", "Volume,C"] and sorted(lines[4:]) == sorted(f"{k}.5,x" for k in range(1, 30, 3))
    assert (tmp_path / "tree" / folders[3] / "Intensity_Sum.csv").read_text() == "sum\n9,y\n"
