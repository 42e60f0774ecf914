"""Rank statistics of continuous values against brute force over all pairs, with ranges and pieces made small."""

import numpy as np
import pytest

from incidentry.operators import continuous as R


@pytest.fixture
def small_ranges(monkeypatch):
    monkeypatch.setattr(R, "RANGE_ROWS", 60)


def values(seed, n=700):
    """Different values, ties, and one value that a third of the rows have."""
    rng = np.random.default_rng(seed)
    x, y = np.round(rng.normal(size=n), 2), rng.normal(size=n)
    x[::3] = 0.25
    y[::7] = -1.0
    return x, np.where(rng.random(n) < 0.3, x + 0.1, y)


def brute_tau(x, y):
    a, b = np.sign(x[:, None] - x), np.sign(y[:, None] - y)
    up = np.triu_indices(len(x), 1)
    a, b = a[up], b[up]
    c, d = int((a * b > 0).sum()), int((a * b < 0).sum())
    return c, d, (c - d) / np.sqrt(float((a != 0).sum())) / np.sqrt(float((b != 0).sum()))


@pytest.mark.parametrize("seed", [1, 2])
def test_kendall(spark, small_ranges, seed):
    x, y = values(seed)
    d = spark.createDataFrame([*zip(x.tolist(), y.tolist(), strict=True), (None, 1.0), (1.0, None), (float("nan"), 2.0)], "x double, y double")
    got = R.kendall(d, "x", "y").first()
    c, k, tau = brute_tau(x, y)
    assert (got["n"], got["concordant"], got["discordant"]) == (len(x), c, k) and abs(got["tau"] - tau) < 1e-12


def test_kendall_edges(spark):
    tau = lambda rows: R.kendall(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    assert tau([])["tau"] == 0 and tau([])["n"] == 0 and tau([(1.0, 2.0)])["tau"] == 0 and tau([(1.0, 2.0), (1.0, 3.0)])["tau"] == 0
    assert tau([(1.0, 2.0), (2.0, 3.0)])["tau"] == 1 and tau([(1.0, 2.0), (2.0, 1.0)] * 3)["tau"] == -1


def test_discordant_pairs():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        x, y, w = rng.integers(0, 30, n), rng.integers(0, 30, n).astype(float), rng.integers(1, 5, n)
        want = ((x[:, None] < x) & (y[:, None] > y)) * w[:, None] * w
        assert R.discordant(x, y, w) == want.sum()


def average(v):
    order = np.sort(v)
    return (np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2


def test_ranks_and_rho(spark, small_ranges):
    x, y = values(3)
    d = spark.createDataFrame([(a, b, 1.0) for a, b in zip(x.tolist(), y.tolist(), strict=True)], "x double, y double, same double")
    got = {(r["column"], r["v"]): r["rank"] for r in R.average_ranks(d, ["x", "y"]).collect()}
    assert got == {("x", a): r for a, r in zip(x, average(x), strict=True)} | {("y", b): r for b, r in zip(y, average(y), strict=True)}
    rho = {r["column"]: r["rho"] for r in R.spearman(d, ["x", "same"], "y").collect()}
    assert abs(rho["x"] - np.corrcoef(average(x), average(y))[0, 1]) < 1e-12 and rho["same"] == 0


@pytest.mark.parametrize("few", [10_000, 0])
def test_rho_of_rows_that_lack_values(spark, small_ranges, monkeypatch, few):
    monkeypatch.setattr(R, "FEW", few)
    x, y = values(6)
    none = x.tolist()
    none[4::5] = [None] * len(none[4::5])
    none[1], target = float("nan"), [None, *y.tolist()[1:]]
    d = spark.createDataFrame([*zip(none, y.tolist(), [2.0] * 700, [None] * 700, target, strict=True)], "x double, y double, same double, none double, t double")
    got = {r["column"]: (r["n"], r["rho"]) for r in R.spearman(d, ["x", "y", "same", "none"], "t").collect()}
    both = np.array([i for i in range(2, 700) if i % 5 != 4])
    assert got.keys() == {"x", "y", "same"} and got["same"] == (699, 0) and got["x"][0] == len(both) and abs(got["y"][1] - 1) < 1e-12
    assert abs(got["x"][1] - np.corrcoef(average(x[both]), average(y[both]))[0, 1]) < 1e-12
    flat = R.spearman(d, ["x"], "same").first()
    assert (flat["n"], flat["rho"]) == (559, 0) and R.spearman(d.limit(0), ["x"], "t").count() == 0


def test_rho_writes_no_pairs_of_values(spark, monkeypatch):
    """A step holds a row a target, however many columns there are."""
    sizes, write = [], R.written
    monkeypatch.setattr(R, "written", lambda df: sizes.append((out := write(df)).count()) or out)
    d = spark.range(500).selectExpr("id % 3 AS a", "id % 5 AS b", "id % 7 AS c", "id * 37 % 500 AS t")
    assert R.spearman(d, ["a", "b", "c"], "t").count() == 3 and max(sizes) <= 500


def test_dominance(spark, small_ranges):
    x, y = values(5, 900)
    g = np.array(["a", "b", "b", "c"])[np.arange(900) % 4]
    d = spark.createDataFrame([*zip(g.tolist(), y.tolist(), strict=True), (None, 1.0), ("a", None)], "g string, v double")
    got = {(r["a"], r["b"]): (r["delta"], r["mean_diff"]) for r in R.dominance(d, "g", "v").collect()}
    for a, b in (("a", "b"), ("a", "c"), ("b", "c")):
        u, v = y[g == a], y[g == b]
        assert abs(got[a, b][0] - np.sign(u[:, None] - v).mean()) < 1e-12 and abs(got[a, b][1] - (u.mean() - v.mean())) < 1e-9
    assert len(got) == 3
