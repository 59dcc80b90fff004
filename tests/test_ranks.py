import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from helpers import close, frame

from morphotab.operators import outliers, ranks, selection, summary


def data(spark, n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "a" if i % 3 else rng.choice(["b", "c", None])
        x = rng.choice([0.0, None, float("nan"), rng.gauss(0, 1), float(rng.randint(-3, 3)), -0.0])
        rows.append((key, x))
    return frame(spark, {"k": "s", "x": "d"}, rows), rows


def by_key(rows):
    out = {}
    for k, x in rows:
        if x is not None and x == x:
            out.setdefault(k, []).append(x)
    return out


@pytest.mark.parametrize("every", [1, 2, 7, 1 << 18])
def test_average_ranks_do_not_depend_on_the_split_points(spark, every):
    """`every`: most distinct values in a range."""
    df, rows = data(spark)
    got = {(r["k"], r["x"]): (r["n"], r["rank"]) for r in ranks.average_ranks(df, "x", ["k"], every).collect()}
    expected = {}
    for k, xs in by_key(rows).items():
        for x in set(xs):
            below, ties = sum(v < x for v in xs), sum(v == x for v in xs)
            expected[(k, x)] = (ties, below + (ties + 1) / 2)
    assert got == expected


@pytest.mark.parametrize("every", [2, 1 << 18])
def test_quantiles_are_type_7(spark, every):
    df, rows = data(spark)
    probs = {"lo": 0.25, "mid": 0.5, "hi": 0.9}
    found = selection.quantiles(df, "x", ["k"], probs, every).collect()
    expected = by_key(rows)
    assert len(found) == len(expected)
    for r in found:
        for name, p in probs.items():
            assert close(r[name], float(np.quantile(expected[r["_key"]["k"]], p)))


@pytest.mark.parametrize(
    ("values", "lower", "upper"), [([1, 2, 3, 4, 100], 2.0, 4.0), ([1, 2, 3, 4], 1.5, 3.5), ([5], 5.0, 5.0)]
)
def test_hinges(spark, values, lower, upper):
    df = frame(spark, {"x": "d"}, [(float(v),) for v in values])
    row = selection.hinges(df, "x", finish=1).first()
    assert (row["lower_hinge"], row["upper_hinge"]) == (lower, upper)


def test_outliers(spark):
    df = frame(spark, {"x": "d"}, [(1.0,), (2.0,), (3.0,), (4.0,), (100.0,), (None,)])
    row = outliers.fences(df, "x").first()
    assert (row["low"], row["high"]) == (-1.0, 7.0)
    assert [r["x"] for r in outliers.outliers(df, "x").collect()] == [100.0]
    assert sorted((r["x"] for r in outliers.remove_outliers(df, "x").collect()), key=str) == [1.0, 2.0, 3.0, 4.0, None]
    assert outliers.remove_outliers(df, "gone").count() == 6


def test_outliers_of_nothing(spark):
    df = frame(spark, {"x": "d"}, [(None,), (None,)])
    assert outliers.remove_outliers(df, "x").count() == 2
    assert outliers.outliers(df, "x").count() == 0


def test_a_dominant_value_is_one_row_per_range(spark):
    df = spark.range(30_000).selectExpr("'k' k", "CASE WHEN id % 3 = 0 THEN 0D ELSE CAST(id AS DOUBLE) END x")
    ranked = ranks.ranked_values(df, "x", ["k"], most=64)
    zero = ranked.where("_x = 0").first()
    assert zero["_ties"] == 10_000 and zero["_below"] == 0
    assert ranked.selectExpr("max(_below + _ties) m").first()["m"] == 30_000


def test_ranges_to_cut_are_broadcast_by_size(spark):
    """They are written, so the planner itself takes them for small; no row meets a list of splits or a nested loop."""
    df = spark.range(20_000).selectExpr("CAST(id % 7 AS STRING) k", "CAST(id AS DOUBLE) x")
    ranked = ranks.ranked_values(df, "x", ["k"], most=10)
    plan = ranked._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert ranked.where("_below <> CAST(_x - _x % 7 AS LONG) / 7").count() == 0


def test_selection_shuffles_counts_only(spark):
    df = spark.range(300_000).selectExpr("CAST(id % 3 AS STRING) k", "CAST(hash(id) AS DOUBLE) / 1024 x")
    found = selection.quantiles(df, "x", ["k"], {"mid": 0.5, "low": 0.001}, finish=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    xs = {str(k): np.array([r.x for r in df.where(f"k = '{k}'").collect()]) for k in range(3)}
    for r in found.collect():
        own = xs[r["_key"]["k"]]
        assert close(r["mid"], float(np.quantile(own, 0.5))) and close(r["low"], float(np.quantile(own, 0.001)))


def test_order_keys(spark):
    """The keys are the IEEE bits, mirrored for negative numbers, and lead back to the values."""
    rng = random.Random(5)
    xs = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, 1.0, 0.9999999999999999, 3.0, -0.1]
    xs += [x for x in (struct.unpack("<d", rng.randbytes(8))[0] for _ in range(20_000)) if math.isfinite(x)]
    xs += [rng.choice([-1, 1]) * 2.0 ** rng.randint(-1074, 1023) for _ in range(3000)] + [rng.gauss(0, 1) for _ in range(5000)]
    bits = lambda x: struct.unpack("<q", struct.pack("<d", abs(x)))[0] * (-1 if x < 0 else 1)
    df = spark.createDataFrame([(x, bits(x)) for x in xs], "x double, b long").withColumn("k", selection.order_key(F.col("x")))
    assert df.where((F.col("k") != F.col("b")) | (selection.key_value(F.col("k")) != F.col("x"))).count() == 0


def test_boxplot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = frame(spark, {"s": "s", "f": "s", "x": "d"}, [("p", "g", v) for v in values] + [("p", "h", None)])
    rows = summary.boxplot_summary(df, "x", "f", "s").collect()
    assert len(rows) == 1
    r = rows[0].asDict()
    assert (r["Lower"], r["Middle"], r["Upper"], r["Mean"], r["n"]) == (2.0, 3.0, 4.0, 22.0, 5)
    assert (r["Whisker Low"], r["Whisker High"]) == (1.0, 4.0)
    assert close(r["Notch High"], round(3 + 1.58 * 2 / 5**0.5, 3))
