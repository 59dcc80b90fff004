import math
import random

import numpy as np
import pytest
from helpers import close, frame

from morphotab.operators import density

COLUMNS = {"s": "s", "f": "s", "x": "d", "y": "d"}


def sample(n=240, seed=5):
    rng = random.Random(seed)
    return [
        ("p" if i % 3 else "q", rng.choice("ab"), rng.gauss(10, 2), rng.gauss(5, 1) if i % 7 else None)
        for i in range(n)
    ]


def test_histogram_counts_every_row_once(spark):
    rows = sample()
    df = frame(spark, COLUMNS, rows)
    out = density.histogram(df, "x", "f", "s", bins=12).collect()
    assert sum(r["count"] for r in out) == len(rows)
    assert min(r["bin"] for r in out) == 1 and max(r["bin"] for r in out) == 12
    xs = [r[2] for r in rows]
    first = next(r for r in out if r["bin"] == 1)
    assert close(first["x"], min(xs))
    inside = density.histogram(df, "x", "f", "s", limits=(9.0, 11.0)).collect()
    assert sum(r["count"] for r in inside) == sum(9 <= x <= 11 for x in xs)


def test_histogram_shares(spark):
    df = frame(spark, COLUMNS, sample())
    for free in (False, True):
        out = density.histogram_percent(df, "x", "f", "s", free_x=free).collect()
        for panel in "pq":
            assert close(sum(r["percent"] for r in out if r["s"] == panel), 1.0)
    assert close(sum(r["percent"] for r in density.binned_percent(df, "x", "f", "s").collect()), 1.0)


def test_histogram_without_spread(spark):
    df = frame(spark, COLUMNS, [("p", "a", 4.0, None)] * 3)
    out = density.histogram(df, "x", "f", "s").collect()
    assert [(r["bin"], r["count"], r["x"]) for r in out] == [(1, 3, 4.0)]
    assert density.histogram(df, "x", "f", "s", bins=1).first()["count"] == 3


def nrd0(x):
    sd = np.std(x, ddof=1)
    iqr = np.quantile(x, 0.75) - np.quantile(x, 0.25)
    lo = min(sd, iqr / 1.34) or sd or abs(x[0]) or 1.0
    return 0.9 * lo * len(x) ** -0.2


def exact(x, at, bw):
    return np.exp(-0.5 * ((at[:, None] - x[None, :]) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))


@pytest.mark.parametrize("every", [2, 1 << 18])
def test_kde_matches_the_kernel_sum(spark, every):
    rows = sample()
    df = frame(spark, COLUMNS, rows)
    out = density.kde(df, "x", "f", "s", adjust=1.5, points=64, finish=every).collect()
    xs = np.array([r[2] for r in rows])
    for s, f in {(r[0], r[1]) for r in rows}:
        own = np.array([r[2] for r in rows if r[:2] == (s, f)])
        got = sorted((r["point"], r["x"], r["density"], r["scaled"], r["n"]) for r in out if (r["s"], r["f"]) == (s, f))
        at = np.linspace(xs.min(), xs.max(), 64)
        expected = exact(own, at, nrd0(own) * 1.5)
        assert np.allclose([g[1] for g in got], at)
        assert np.allclose([g[2] for g in got], expected, atol=2e-4)
        assert got[0][4] == len(own) and close(max(g[3] for g in got), 1.0)


def test_kde_of_equal_values_and_single_values(spark):
    df = frame(spark, COLUMNS, [("p", "a", 4.0, None)] * 3 + [("p", "b", 1.0, None)])
    out = density.kde(df, "x", "f", "s", points=16).collect()
    assert {r["f"] for r in out} == {"a"}
    assert all(math.isfinite(r["density"]) for r in out)


def test_violin(spark):
    rows = sample()
    df = frame(spark, COLUMNS, rows)
    out = density.violin(df, "x", "f", "s", points=32).collect()
    own = [r[2] for r in rows if r[:2] == ("q", "a")]
    got = sorted((r["point"], r["y"], r["median"]) for r in out if (r["s"], r["f"]) == ("q", "a"))
    assert close(got[0][1], min(own)) and close(got[-1][1], max(own))
    assert close(got[0][2], float(np.median(own)))


def test_density2d_matches_the_kernel_sum(spark):
    rows = sample()
    df = frame(spark, COLUMNS, rows)
    out = density.density2d(df, "x", "y", "s", points=20).collect()
    both = [(r[0], r[2], r[3]) for r in rows if r[3] is not None]
    gx = np.linspace(min(b[1] for b in both), max(b[1] for b in both), 20)
    gy = np.linspace(min(b[2] for b in both), max(b[2] for b in both), 20)
    for s in "pq":
        x = np.array([b[1] for b in both if b[0] == s])
        y = np.array([b[2] for b in both if b[0] == s])

        def nrd(v):
            h = (np.quantile(v, 0.75) - np.quantile(v, 0.25)) / 1.34
            return 1.06 * min(np.std(v, ddof=1), h) * len(v) ** -0.2

        ax = np.exp(-0.5 * ((gx[:, None] - x) / nrd(x)) ** 2) / math.sqrt(2 * math.pi)
        ay = np.exp(-0.5 * ((gy[:, None] - y) / nrd(y)) ** 2) / math.sqrt(2 * math.pi)
        expected = ax @ ay.T / (len(x) * nrd(x) * nrd(y))
        got = np.zeros((20, 20))
        for r in out:
            if r["s"] == s:
                got[r["i"], r["j"]] = r["density"]
        assert np.abs(got - expected).max() < 0.01 * expected.max()
    assert close(max(r["ndensity"] for r in out), 1.0)


def test_density_peak(spark):
    df = frame(spark, COLUMNS, sample())
    top = density.density_peak(df, "x", "f").first()["Max"]
    assert close(top, max(r["density"] for r in density.kde(df, "x", "f", "f").collect()))
