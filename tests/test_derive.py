import pytest
from helpers import GOLDEN, close, table

from morphotab import schema as S
from morphotab.operators.catalog import available_variables, group_variables, with_prerequisites
from morphotab.operators.derive import Ratios, derive, parse_pair

PAIR = [("1", "2")]
EXPECTED = {
    "Intensity Sum Normalised per Nucleus": (0.2, 0.3),
    "Intensity Mean Normalised per Nucleus": (0.8, 1.2),
    "Intensity StdDev Normalised per Nucleus": (0.5, 1.5),
    "Normalized Distance to Nucleus": (0.2, 0.4),
    "Group Intensity Sum": (50.0, 50.0),
    "Group Intensity Mean": (10.0, 10.0),
    "Ratio Ch1:Ch2 of Intensity Sum": (2.0, None),
    "Ratio Ch1:Ch2 of Intensity Mean": (1.6, None),
    "Ratio Ch1:Ch2 of Intensity Sum Normalised per Nucleus": (4.0, None),
    "Signal Density": (0.04, 0.03),
    "Intensity Sum Normalised by Group": (0.4, 0.6),
    "Intensity Mean Normalised by Group": (0.4, 0.6),
    "Intensity StdDev Normalised by Group": (0.25, 0.75),
    "Object Count": (2, 2),
    "Group Intensity Sum Relative to Nucleus": (0.5, 0.5),
    "Group Intensity Mean Relative to Nucleus": (1.0, 1.0),
    "Ratio Ch1:Ch2 of Intensity Sum Normalised per Group": (0.4, None),
    "Volume Relative to Nucleus": (0.1, 0.2),
    "Group Volume": (15.0, 15.0),
    "Volume Relative to Group": (1 / 3, 2 / 3),
    "Group Volume Relative to Nucleus": (0.3, 0.3),
    "Surface Area-to-Volume Ratio": (2.0, 1.5),
    "Group Surface Area": (25.0, 25.0),
    "Group Surface Area-to-Volume Ratio": (5 / 3, 5 / 3),
}


def run(spark, rows, **options):
    out = derive(table(spark, rows), ratios=Ratios(PAIR, PAIR, PAIR, PAIR), **options)
    return {(r[S.OBJECT], r[S.CHANNEL], r[S.OBJECT_ID]): r.asDict() for r in out.collect()}


@pytest.fixture(scope="module")
def golden(spark):
    return run(spark, GOLDEN)


@pytest.mark.parametrize("name", EXPECTED)
def test_golden_values(golden, name):
    for object_id, expected in zip(("1", "2"), EXPECTED[name]):
        assert close(golden[("CC", "1", object_id)][name], expected)


def test_other_channel_carries_the_ratio(golden):
    row = golden[("CC", "2", "1")]
    assert [close(row[f"Ratio Ch1:Ch2 of {n}"], v) for n, v in (
        ("Intensity Sum", 2.0),
        ("Intensity Mean", 1.6),
        ("Intensity Sum Normalised per Nucleus", 4.0),
        ("Intensity Sum Normalised per Group", 0.4),
    )] == [True] * 4
    assert row["Normalized Distance to Nucleus"] is None


def test_every_catalogue_variable_is_built(golden):
    assert set(EXPECTED) <= set(golden[("CC", "1", "1")])
    assert set(available_variables("Nucleus")) - {n for n in EXPECTED} == {
        "Ratio of Intensity Sum",
        "Ratio of Intensity Mean",
        "Ratio of Intensity Sum Normalised per Nucleus",
        "Ratio of Intensity Sum Normalised per Group",
    }


def test_without_reference_rows_reference_values_are_missing(spark):
    out = run(spark, [r for r in GOLDEN if r[2] != "Nucleus"])
    row = out[("CC", "1", "1")]
    for name in EXPECTED:
        if "Nucleus" in name and "Distance" not in name:
            assert row[name] is None, name
    assert row["Group Volume"] == 15.0


def test_missing_member_voids_the_group(spark):
    rows = [r if r[4] != "2" else (*r[:8], None, *r[9:]) for r in GOLDEN]
    out = run(spark, rows)
    for object_id in ("1", "2"):
        row = out[("CC", "1", object_id)]
        assert row["Group Volume"] is None
        assert row["Volume Relative to Group"] is None
        assert row["Group Volume Relative to Nucleus"] is None
        assert row["Group Surface Area-to-Volume Ratio"] is None
        assert row["Group Surface Area"] == 25.0


def test_zero_or_doubled_reference_gives_null(spark):
    zero = [r if r[2] != "Nucleus" else (*r[:5], 0.0, *r[6:]) for r in GOLDEN]
    assert run(spark, zero)[("CC", "1", "1")]["Intensity Sum Normalised per Nucleus"] is None
    doubled = [*GOLDEN, ("A", "Surface", "Nucleus", "1", "7", 50.0, 10.0, 2.0, 50.0, 20.0, 0.0)]
    out = run(spark, doubled)
    assert out[("CC", "1", "1")]["Intensity Sum Normalised per Nucleus"] is None
    assert close(out[("CC", "2", "1")]["Intensity Sum Normalised per Nucleus"], 0.05)


def test_images_without_center_are_left_out_only_if_another_has_one(spark):
    other = [("B", "Surface", "CC", "1", "1", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    assert len(run(spark, GOLDEN + other)) == len(GOLDEN)
    no_center = [r for r in GOLDEN if r[2] != "Nucleus Center of Mass"]
    out = derive(table(spark, no_center + other), ["Object Count"])
    assert out.count() == len(no_center) + 1


def test_center_without_distance_counts_as_one(spark):
    rows = [r if r[2] != "Nucleus Center of Mass" else (*r[:10], None) for r in GOLDEN]
    assert close(run(spark, rows)[("CC", "1", "2")]["Normalized Distance to Nucleus"], 2.0)


def test_shares_add_up_and_ratios_invert(spark):
    both = Ratios(sums=[("1", "2"), ("2", "1")])
    out = derive(table(spark, GOLDEN), ["Intensity Sum Normalised by Group"], ratios=both)
    rows = [r for r in out.collect() if r[S.OBJECT] == "CC" and r[S.CHANNEL] == "1"]
    assert close(sum(r["Intensity Sum Normalised by Group"] for r in rows), 1.0)
    one = next(r for r in rows if r[S.OBJECT_ID] == "1")
    product = one["Ratio Ch1:Ch2 of Intensity Sum"] * one["Ratio Ch2:Ch1 of Intensity Sum"]
    assert close(product, 1.0)


def test_pair_with_missing_channel_is_null(spark):
    out = derive(table(spark, GOLDEN), [], ratios=Ratios(sums=[("1", "NA")]))
    assert {r["Ratio Ch1:ChNA of Intensity Sum"] for r in out.collect()} == {None}


def test_absent_inputs_are_skipped(spark):
    out = derive(table(spark, GOLDEN).drop(S.VOLUME), ["Group Volume", "Object Count"])
    assert "Group Volume" not in out.columns and "Object Count" in out.columns


def test_no_reference(spark):
    out = derive(table(spark, GOLDEN), None, reference=None)
    assert "Group Volume" in out.columns
    assert not [c for c in out.columns if "Normalised" in c]


def test_prerequisites():
    asked = ["Volume Relative to Group", "Signal Density", "Group Surface Area-to-Volume Ratio"]
    got = with_prerequisites(asked, "CC")
    assert got.index("Group Volume") < got.index("Volume Relative to Group")
    assert got.index("Intensity Sum Normalised per CC") < got.index("Signal Density")
    assert "Group Surface Area" in got
    assert with_prerequisites(["Intensity StdDev Normalised by Group"], "CC") == [
        "Intensity StdDev Normalised per CC",
        "Intensity StdDev Normalised by Group",
    ]
    assert len(group_variables("CC")) == 9
    assert parse_pair("1, 2") == ("1", "2")
    assert len(available_variables("CC")) == 24
    assert "Group Volume Relative to CC" not in available_variables(None)


def test_plan_has_no_window_over_rows(spark):
    """Windows run on the group table; rows are only aggregated and joined."""
    out = derive(table(spark, GOLDEN), ["Group Volume"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line:
            assert "Object ID" not in line


CHANNELS = [str(k) for k in range(1, 21)]


def many_channels(spark):
    """Two images, a reference and two objects each, 20 channels; one object has channel 3 twice and lacks channel 4."""
    rows = []
    for image in "AB":
        for k, channel in enumerate(CHANNELS, 1):
            rows.append((image, "Surface", "Nucleus", channel, "0", 100.0 * k, 10.0, 2.0, 50.0, 20.0, 0.0))
            for o in (1, 2):
                if (image, o, k) != ("A", 1, 4):
                    row = (image, "Surface", "CC", channel, str(o), float(o * k + (image == "B")), 8.0, 1.0, 5.0, 10.0, 1.0)
                    rows += [row] * (2 if (image, o, k) == ("A", 1, 3) else 1)
    rows.append(("A", "Surface", "CC", None, "1", 77.0, 8.0, 1.0, 5.0, 10.0, 1.0))
    return table(spark, rows)


def test_all_pairs_of_twenty_channels(spark):
    pairs = [(a, b) for a in CHANNELS for b in CHANNELS if int(a) < int(b)]
    out = derive(many_channels(spark), [], ratios=Ratios(sums=pairs, reference_sums=pairs)).collect()
    assert len(out) == 121
    for r in out:
        if r[S.OBJECT] != "CC":
            continue
        o, extra = int(r[S.OBJECT_ID]), r[S.IMAGE] == "B"
        gone = {"3", "4"} if (r[S.IMAGE], o) == ("A", 1) else set()
        for a, b in pairs:
            sums, shares = r[f"Ratio Ch{a}:Ch{b} of Intensity Sum"], r[f"Ratio Ch{a}:Ch{b} of Intensity Sum Normalised per Nucleus"]
            if r[S.CHANNEL] not in (a, b) or gone & {a, b}:
                assert sums is None and shares is None
            else:
                x, y = o * int(a) + extra, o * int(b) + extra
                assert close(sums, x / y) and close(shares, x / int(a) / (y / int(b)))


def test_aggregates_and_windows_do_not_grow_with_the_pairs(spark):
    def shape(pairs):
        out = derive(many_channels(spark), [], ratios=Ratios(pairs, [], pairs, pairs))
        lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return [line.count(",") for line in lines if "Aggregate [" in line or "Window [" in line]

    every = [(a, b) for a in CHANNELS for b in CHANNELS[:3] if a != b]
    assert shape(every) == shape([("1", "2")])


def test_rows_are_widened_last(spark):
    """Object values are looked up before the group values are joined, and no join carries a map of channels beside the rows."""
    full = derive(table(spark, GOLDEN), reference="Nucleus", ratios=Ratios([("1", "2")], [("1", "2")], [("1", "2")], [("1", "2")]))
    joins = [line for line in full._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
    assert len(joins) == 2 and "_group" in joins[0] and "_object" in joins[1]
