import math

import pytest
from helpers import close, frame

from morphotab.functions import tails
from morphotab.operators import hypothesis

COLUMNS = {"s": "s", "g": "s", "x": "d"}
TWO = [("p", g, x) for g, xs in (("a", [1.0, 2.0, 3.0]), ("b", [4.0, 5.0, 6.0])) for x in xs]


def report(df, fn):
    return {r["s"]: r.asDict() for r in fn(df, "x", "g", "s").collect()}


def test_kruskal_and_anova_golden(spark):
    df = frame(spark, COLUMNS, TWO)
    kw = report(df, hypothesis.kruskal)["p"]
    assert close(kw["statistic"], 27 / 7) and kw["p-value"] == "0.0495" and kw["n"] == 6
    f = report(df, hypothesis.anova)["p"]
    assert close(f["statistic"], 13.5) and f["p-value"] == "0.0213" and f["n"] == 6


def test_kruskal_facets(spark):
    rows = [(f"t{i}", g, x) for i in range(4) for _, g, x in TWO]
    rows += TWO
    rows += [("three", g, float(i)) for i, g in enumerate("abcabc")]
    rows += [("one", "a", 1.0), ("one", "a", 2.0)]
    rows += [("empty", "a", None), ("empty", "b", None)]
    rows += [("nogroup", None, 1.0)]
    out = report(frame(spark, COLUMNS, rows), hypothesis.kruskal)
    assert set(out) == {"t0", "t1", "t2", "t3", "p", "three", "one", "nogroup"}
    assert close(out["p"]["corrected_p_value"], 5 * out["p"]["p_value"])
    for facet in ("three", "one", "nogroup"):
        row = out[facet]
        assert row["statistic"] is None and row["n"] is None and row["p-value"] is None


def test_kruskal_equal_values_count_as_tested(spark):
    rows = TWO + [("flat", g, 1.0) for g in "aabb"]
    out = report(frame(spark, COLUMNS, rows), hypothesis.kruskal)
    assert out["flat"]["statistic"] is None and out["flat"]["n"] == 4
    assert close(out["p"]["corrected_p_value"], 2 * out["p"]["p_value"])


def test_small_p_is_text(spark):
    rows = [("p", g, float(i + (1000 if g == "b" else 0))) for g in "ab" for i in range(40)]
    assert report(frame(spark, COLUMNS, rows), hypothesis.kruskal)["p"]["p-value"] == "<0.0001"


def test_anova_edges(spark):
    rows = TWO + [("one", "a", 1.0), ("pair", "a", 1.0), ("pair", "b", 2.0), ("flat", "a", 1.0), ("flat", "a", 1.0)]
    rows += [("flat", "b", 2.0), ("flat", "b", 2.0), ("empty", "a", None)]
    out = report(frame(spark, COLUMNS, rows), hypothesis.anova)
    assert out["one"]["n"] is None and out["one"]["statistic"] is None
    assert out["pair"]["statistic"] is None and out["flat"]["statistic"] is None
    assert out["empty"]["statistic"] is None


def test_pearson(spark):
    xs, ys = [1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 1.0, 4.0, 3.0, 6.0]
    rows = [("a", x, y) for x, y in zip(xs, ys)] + [("b", 1.0, 1.0), ("b", 2.0, 2.0), ("a", None, 3.0)]
    rows += [("c", float(i), 2.0 * i) for i in range(4)]
    df = frame(spark, {"s": "s", "x": "d", "y": "d"}, rows)
    out = {r["s"]: r.asDict() for r in hypothesis.pearson(df, "x", "y", ["s"]).collect()}
    mx, my = sum(xs) / 5, sum(ys) / 5
    sxy = sum((a - mx) * (b - my) for a, b in zip(xs, ys))
    r = sxy / math.sqrt(sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys))
    assert close(out["a"]["estimate"], r) and out["a"]["n"] == 5
    t = r * math.sqrt(3 / (1 - r * r))
    assert close(out["a"]["p_value"], tails.t_sf_two_sided(t, 3))
    assert out["b"]["estimate"] is None and out["b"]["p_value"] is None
    assert close(out["c"]["estimate"], 1.0) and out["c"]["p_value"] < 1e-6
    logs = {r["s"]: r.asDict() for r in hypothesis.pearson(df, "x", "y", ["s"], log_x=True, log_y=True).collect()}
    assert logs["c"]["n"] == 3


@pytest.mark.parametrize("f", [0.3, 1.0, 2.5, 13.5, 60.0])
@pytest.mark.parametrize("n", [6, 50, 10_000, 10**9])
def test_tails_agree(f, n):
    """F(1, v) is t squared; F(2, v) has a closed form."""
    assert close(tails.f_sf(f, 1, n), tails.t_sf_two_sided(math.sqrt(f), n), 1e-8)
    assert close(tails.f_sf(f, 2, n), math.exp(-n / 2 * math.log1p(2 * f / n)), 1e-7)


def test_tail_of_many_degrees_of_freedom_is_normal():
    assert close(tails.t_sf_two_sided(1.96, 10**9), math.erfc(1.96 / math.sqrt(2)), 1e-6)
    assert close(tails.chi2_sf_1df(3.841458820694124), 0.05, 1e-9)


def test_pearson_without_spread(spark):
    """A facet in which one variable is constant, or of too few points, is listed without an estimate."""
    rows = [("flat", float(k), 0.0) for k in range(5)] + [("two", 1.0, 2.0), ("two", 2.0, 3.0)] + [("line", float(k), 2.0 * k) for k in range(4)]
    df = frame(spark, {"s": "s", "x": "d", "y": "d"}, rows)
    got = {r["s"]: (r["estimate"], r["n"], r["p_value"]) for r in hypothesis.pearson(df, "x", "y", ["s"]).collect()}
    assert got["flat"] == (None, 5, None) and got["two"] == (None, 2, None)
    assert abs(got["line"][0] - 1) < 1e-12 and got["line"][1] == 4 and got["line"][2] < 1e-9
