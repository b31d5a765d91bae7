"""Folds per target, pairwise correlations and lagged change against plain NumPy."""

import numpy as np
import pytest

from areascope.operators.correlation import pairwise_corr
from areascope.operators.design import design
from areascope.operators.panel import lagged_change
from areascope.operators.sweeps import Model, cv_r2_per_target


def plain_folds(sizes: dict, k: int) -> dict:
    loads, out = [0] * k, {}
    for size, g in sorted(((n, g) for g, n in sizes.items()), reverse=True):
        out[g] = loads.index(min(loads))
        loads[out[g]] += size
    return out


def test_folds_per_target_equal_refits(spark):
    rng = np.random.default_rng(2)
    n, k = 600, 3
    g, x = rng.integers(0, 12, n), rng.normal(size=n)
    y = np.stack([x + rng.normal(size=n), -x + rng.normal(size=n)], axis=1)
    y[(g < 3) & (rng.random(n) < 0.9), 0] = np.nan  # other group sizes, other folds
    y[rng.random(n) < 0.3, 1] = np.nan
    rows = [(int(g[i]), float(x[i]), *[None if np.isnan(v) else float(v) for v in y[i]]) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, x double, a double, b double")
    data, layout = design(df, ["g"], ["a", "b"], numeric={"x": ["x"]})
    got = {r["outcome"]: r for r in cv_r2_per_target(data, layout, [Model("x", ("x",), alpha=0.0)], "g", k).collect()}
    maps = []
    for o, name in enumerate("ab"):
        have = ~np.isnan(y[:, o])
        folds = plain_folds({int(v): int(c) for v, c in zip(*np.unique(g[have], return_counts=True))}, k)
        maps.append(folds)
        fold = np.array([folds.get(int(v), -1) for v in g])
        scores = []
        for f in range(k):
            train, test = have & (fold != f), have & (fold == f)
            line = np.polyfit(x[train], y[train, o], 1)
            left = y[test, o] - np.polyval(line, x[test])
            scores.append(1 - (left**2).sum() / ((y[test, o] - y[test, o].mean()) ** 2).sum())
        assert np.isclose(got[name]["r2_mean"], np.mean(scores)) and got[name]["n"] == have.sum()
        assert np.isclose(got[name]["r2_std"], np.std(scores))
    assert maps[0] != maps[1]


@pytest.mark.parametrize("shift", [0.0, 1e7])
def test_pairwise_correlation(spark, shift):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 4)) + shift, rng.normal(size=(300, 2))
    y[:, 0] += x[:, 1] - shift
    x[:, 3] = 5.0
    x[rng.random((300, 4)) < 0.2] = np.nan
    y[rng.random((300, 2)) < 0.2] = np.nan
    f = lambda v, i: None if np.isnan(v) and i % 2 else float(v)
    rows = [([f(v, i) for v in x[i]], f(y[i, 0], i), f(y[i, 1], i), 1) for i in range(300)]
    rows += [(None, 1.0, 1.0, 1), ([1.0], 2.0, None, 1)]
    df = spark.createDataFrame(rows, "v array<double>, a double, b double, place int").repartition(5)
    got = {(r["place"], r["variable"]): r for r in pairwise_corr(df, "v", 4, ["a", "b"]).collect()}
    x = np.vstack([x, [np.nan] * 4, [1.0, np.nan, np.nan, np.nan]])
    y = np.vstack([y, [1.0, 1.0], [2.0, np.nan]])
    for i in range(4):
        for j, name in enumerate("ab"):
            both = ~np.isnan(x[:, i]) & ~np.isnan(y[:, j])
            r = got[i, name]
            assert r["n"] == both.sum()
            if i == 3:
                assert r["corr"] is None
            elif shift == 0 or i:
                assert np.isclose(r["corr"], np.corrcoef(x[both, i], y[both, j])[0, 1], atol=1e-6)
    empty = pairwise_corr(df.where("false"), "v", 4, ["a", "b"]).collect()
    assert len(empty) in (0, 8) and all(r["n"] == 0 and r["corr"] is None for r in empty)


def test_lagged_change_does_not_bridge_gaps(spark):
    rows = [(1, 2000, [1.0, 2.0], 5.0), (1, 2001, [2.0, None], 7.0), (1, 2003, [9.0, 9.0], None),
            (1, 2004, [10.0, 7.0], 1.0), (2, 2001, [0.0, 0.0], 0.0), (3, 2000, None, 1.0), (3, 2001, [1.0, 1.0], 4.0)]
    df = spark.createDataFrame(rows, "unit long, year int, v array<double>, y double")
    got = {(r["unit"], r["year"]): (r["v"], r["y"]) for r in lagged_change(df, "unit", "year", "v", ["y"]).collect()}
    assert got == {(1, 2001): ([1.0, None], 2.0), (1, 2004): ([1.0, -2.0], None), (3, 2001): (None, 3.0)}
    two = lagged_change(df, "unit", "year", "v", ["y"], lag=2).collect()
    assert [(r["unit"], r["year"]) for r in two] == [(1, 2003)]
