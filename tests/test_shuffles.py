"""How often rows are dealt out, and that what saves it gives the same rows."""

import random
import re

import pytest
from helpers import frame

from morphotab import schema as S
from morphotab.operators import clean
from morphotab.plans import measurement_view, queries

TYPES = {n: "s" for n in S.KEYS} | {"Intensity Sum": "d", "Volume": "d", "Surfaces": "s", "Shortest Distance to Surfaces": "d", "p": "s"}


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def odd_rows(spark):
    """Ties within a source, sources and channels that are missing, keys that repeat or are missing."""
    rng = random.Random(3)
    key = lambda: [rng.choice(["WT", None]), "light", rng.choice("AB"), "Surface", rng.choice(["CC", "Nucleus center of mass", None]), rng.choice(["1", "2", None]), rng.choice("12")]
    value = lambda: rng.choice([None, 0.5, 1.5, -2.0, float("nan")])
    rows = [(*key(), value(), value(), rng.choice(["x", "y", None]), value(), rng.choice(["a", "b", "c", None])) for _ in range(400)]
    return frame(spark, TYPES, rows)


@pytest.mark.parametrize("most", [200, 3])
def test_harmonise_by_few_sources_gives_the_same_rows(spark, monkeypatch, most):
    monkeypatch.setattr(clean, "MOST_PLACES", most)
    df = odd_rows(spark)
    plain, few = clean.harmonise(df, "p"), clean.harmonise(df, "p", few_sources=True)
    assert few.columns == plain.columns and few.dtypes == plain.dtypes
    assert ("SortAggregate" in executed(few)) == (most == 3)
    assert sorted(map(str, few.collect())) == sorted(map(str, plain.collect()))


def test_harmonise_by_few_sources_without_channels_or_with_text(spark):
    df = odd_rows(spark)
    none = df.where("Channel IS NULL")
    assert clean.harmonise(none, "p", few_sources=True).collect() == []
    text = df.withColumn("Image Subset", df["p"])
    a, b = (clean.harmonise(text, "p", few_sources=few) for few in (True, False))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_harmonise_by_few_sources_meets_rows_before_they_are_dealt_out(spark):
    plan = executed(clean.harmonise(odd_rows(spark), "p", few_sources=True))
    assert plan.count("Exchange hashpartitioning") == 1 and "Sort" not in plan
    assert "partial_min" in plan[plan.index("Exchange hashpartitioning"):]


@pytest.fixture
def tables(spark, tmp_path):
    rng = random.Random(4)
    lines = [(rng.randrange(7), rng.randrange(5), 10.0 + k, 1.0, k % 4, 0.01, rng.choice("FO"), rng.choice(["A", "N", None])) for k in range(90)]
    made = {
        "lineitem": (lines, "l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_linenumber int, l_discount double, l_linestatus string, l_returnflag string"),
        "part": ([(p, f"type {p % 2}", p) for p in range(6)], "p_partkey long, p_type string, p_size int"),
        "supplier": ([(s, s % 2) for s in range(5)], "s_suppkey long, s_nationkey int"),
        "nation": ([(0, 0), (1, 0)], "n_nationkey int, n_regionkey int"),
        "region": ([(0, "north")], "r_regionkey int, r_name string"),
    }
    for name, (rows, schema) in made.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_view_is_grouped_where_its_lines_are_dealt_by_image(spark, tables):
    plan = executed(measurement_view.measurement_view(spark, tables))
    assert not re.search(r"Exchange hashpartitioning\([^)]*p_type", plan)


def test_prices_of_all_neighbours_move_the_lines_once(spark, tables):
    both = queries._prices(spark, tables, clean.SURFACES, clean.SPOTS)
    plan = executed(both)
    assert len(re.findall(r"FileScan parquet \[l_", plan)) == 1 and not re.search(r"Exchange hashpartitioning\([^)]*p_type", plan)
    surfaces, spots = (queries._prices(spark, tables, k) for k in (clean.SURFACES, clean.SPOTS))
    apart = surfaces.unionByName(spots, allowMissingColumns=True).select(*both.columns)
    assert sorted(map(str, apart.collect())) == sorted(map(str, both.collect()))
    lines = spark.read.parquet(f"{tables}/lineitem.parquet").where("l_partkey < 6").collect()
    lowest = {}
    for r in lines:
        at = f"img_{r.l_suppkey}", str(r.l_partkey), r.l_returnflag
        lowest[at] = min(lowest.get(at, 1e9), r.l_extendedprice)
    got = {(r["Image File"], r["Object ID"], r["Surfaces"]): r["Shortest Distance to Surfaces"] for r in surfaces.collect()}
    assert got == lowest
