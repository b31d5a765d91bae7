"""Boosted trees over Spark rounds against the same trees grown in NumPy from the rows."""

import numpy as np
import pytest

from areascope.operators import boosting as bo
from areascope.operators import sweeps
from areascope.operators.design import design
from areascope.operators.sweeps import Model

COLS = ["a", "b", "c"]


def made(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)).round(2)
    y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] ** 2 + rng.normal(scale=0.1, size=n)
    z = x[:, 2] * 2 + rng.normal(scale=0.1, size=n)
    x[rng.random((n, 3)) < 0.15] = np.nan
    z[rng.random(n) < 0.2] = np.nan
    return x, np.stack([y, z], axis=1), rng.integers(0, 3, n), rng.integers(0, 2, n)


def frame(spark, x, y, fold, group):
    f = lambda v: None if np.isnan(v) else float(v)
    rows = [(int(fold[i]), int(group[i]), *map(f, x[i]), *map(f, y[i])) for i in range(len(x))]
    return spark.createDataFrame(rows, "fold int, g int, a double, b double, c double, y double, z double").repartition(4)


def plain_boost(x, y, train, edges, trees, step, leaves, least=20, bins=64):
    """Predictions of all rows; every histogram is counted from the rows of a leaf."""
    b = bo.bin_matrix(x, edges, bins)
    pred = np.full(len(x), y[train].mean())
    for _ in range(trees):
        left = y - pred

        def histograms(tree, node):
            here = train & (tree.leaves(b, bins) == node)
            n, s = np.zeros((x.shape[1], bins + 1)), np.zeros((x.shape[1], bins + 1))
            for i in np.flatnonzero(here):
                for f in range(x.shape[1]):
                    n[f, b[i, f]] += 1
                    s[f, b[i, f]] += left[i]
            return n, s

        pred = pred + bo.grow(histograms, leaves, least, step).predict(b, bins)
    return pred


def r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_cv_equals_numpy(spark):
    x, y, fold, group = made()
    rows, layout = design(frame(spark, x, y, fold, group), ["fold"], ["y", "z"], numeric={"n": COLS}, missing="keep")
    model = Model("t", ("n",), "gbt", trees=4, step=0.3, leaves=6)
    got = {(r["outcome"], r["fold"]): r for r in sweeps.fold_scores(rows, layout, [model]).collect()}
    edges = bo.feature_edges(rows, 3, 64)
    assert len(got) == 6
    for o, name in enumerate(["y", "z"]):
        for f in range(3):
            have = ~np.isnan(y[:, o])
            train, test = have & (fold != f), have & (fold == f)
            p = plain_boost(x, y[:, o], train, edges, 4, 0.3, 6)
            r = got[name, f]
            assert np.isclose(r["r2"], r2(y[test, o], p[test]), atol=1e-9)
            assert (r["n_train"], r["n_test"]) == (train.sum(), test.sum())
    assert got["y", 0]["r2"] > 0.5


def test_groups_and_residual_equal_numpy(spark):
    x, y, fold, group = made(600, 8)
    df = frame(spark, x, y, fold, group)
    rows, layout = design(df, ["fold", "g"], ["y"], numeric={"n": COLS}, missing="keep")
    model = Model("t", ("n",), "gbt", trees=2, step=0.5, leaves=4)
    got = {(r["g"], r["fold"]): r["r2"] for r in sweeps.fold_scores(rows, layout, [model], "fold", ["g"], 20).collect()}
    edges = bo.feature_edges(rows, 3, 64)
    for g in range(2):
        for f in range(3):
            train, test = (group == g) & (fold != f), (group == g) & (fold == f)
            p = plain_boost(x, y[:, 0], train, edges, 2, 0.5, 4)
            assert np.isclose(got[g, f], r2(y[test, 0], p[test]), atol=1e-9)
    split = df.withColumn("test", df.fold == 0)
    rows, layout = design(split, ["test"], ["y"], numeric={"i": ["a"], "v": ["b", "c"]}, missing="keep")
    index = Model("a", ("i",), "gbt", trees=3, step=0.4, leaves=4)
    second = Model("v", ("v",), "gbt", trees=3, step=0.4, leaves=4)
    r = sweeps.residual_r2(rows, layout, [index], second).first()
    edges = bo.feature_edges(rows, 3, 64)
    train, test = fold != 0, fold == 0
    p1 = plain_boost(x[:, :1], y[:, 0], train, edges[:1], 3, 0.4, 4)
    p2 = plain_boost(x[:, 1:], y[:, 0] - p1, train, edges[1:], 3, 0.4, 4)
    assert np.isclose(r["r2_index"], r2(y[test, 0], p1[test]), atol=1e-9)
    assert np.isclose(r["r2_residual"], r2((y[:, 0] - p1)[test], p2[test]), atol=1e-9)


@pytest.mark.parametrize("missing", [0, 30])
def test_best_split_against_every_split(missing):
    rng = np.random.default_rng(missing)
    for _ in range(50):
        b = rng.integers(0, 5, 100)
        b[:missing] = 8
        v = rng.normal(size=100)
        n = np.bincount(b, minlength=9).astype(float)[None]
        s = np.bincount(b, v, minlength=9)[None]
        best = 0.0
        for cut in range(8):
            for left in (False, True):
                side = np.where(b == 8, left, b <= cut)
                if 20 <= side.sum() <= 80:
                    gain = v[side].sum() ** 2 / side.sum() + v[~side].sum() ** 2 / (~side).sum() - v.sum() ** 2 / 100
                    best = max(best, gain)
        found = bo.best_split(n, s, 20)
        assert np.isclose(found[0] if found else 0.0, best)


def test_small_or_empty_tables(spark):
    x, y, fold, group = made(30)
    df = frame(spark, x, y, fold, group)
    model = Model("t", ("n",), "gbt", trees=1, step=1.0, leaves=2)
    rows, layout = design(df, ["fold"], ["y"], numeric={"n": COLS}, missing="keep")
    assert sweeps.fold_scores(rows, layout, [model], min_rows=100).collect() == []
    assert len(sweeps.fold_scores(rows, layout, [model], min_rows=10).collect()) == 3
    rows, layout = design(df.where("false"), ["fold"], ["y"], numeric={"n": COLS}, missing="keep")
    assert sweeps.fold_scores(rows, layout, [model]).collect() == []


def test_best_first_takes_the_largest_gain_next():
    """Against growth that knows every split at once, one leaf at a time."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(500, 3))
    y = np.where(x[:, 0] > 1, 5.0, 0.0) + x[:, 1] ** 2 + rng.normal(size=500)
    b = bo.bin_matrix(x, [sorted(np.quantile(x[:, i], np.linspace(0.05, 0.95, 19))) for i in range(3)], 64)

    def counts(rows):
        n, s = np.zeros((3, 65)), np.zeros((3, 65))
        for f in range(3):
            np.add.at(n[f], b[rows, f], 1)
            np.add.at(s[f], b[rows, f], y[rows])
        return n, s

    rounds = []

    def histograms(tree, node):
        rounds.append(node)
        return counts(tree.leaves(b, 64) == node)

    for leaves in (1, 2, 5, 9):
        parts = [np.ones(500, dtype=bool)]
        while len(parts) < leaves:
            found = [(bo.best_split(*counts(rows), 20), rows) for rows in parts]
            found = [(best, i) for i, (best, _) in enumerate(found) if best]
            best, i = max(found, key=lambda t: t[0][0])
            low = b[:, best[1]] <= best[2]
            parts[i : i + 1] = [parts[i] & low, parts[i] & ~low]
        want = np.zeros(500)
        for rows in parts:
            want[rows] = y[rows].mean()
        assert np.allclose(bo.grow(histograms, leaves, 20, 1.0).predict(b, 64), want)


@pytest.mark.parametrize("limit, rounds", [(50_000, 1), (270, 9), (0, 9)])
def test_rounds_are_for_large_fits_only(spark, monkeypatch, limit, rounds):
    """Fits over the limit grow by rounds, smaller ones and those on one feature in a task: same scores."""
    x, y, fold, group = made(600, 8)
    group = np.where(np.arange(600) < 150, 0, 1)  # 300 training rows of group 1, 100 of group 0
    df = frame(spark, x, y, fold, group)
    rows, layout = design(df, ["fold", "g"], ["y"], numeric={"n": COLS, "one": ["b"]}, missing="keep")
    asked, plain = [], bo._round
    monkeypatch.setattr(bo, "_round", lambda *a: asked.append(a[-1]) or plain(*a))
    monkeypatch.setattr(bo, "FIT_ROWS", limit)
    models = [Model("n", ("n",), "gbt", trees=4, step=0.5, leaves=4), Model("one", ("one",), "gbt", trees=4, step=0.5, leaves=4)]
    found = sweeps.fold_scores(rows, layout, models, "fold", ["g"], 20).collect()
    got = {(r["model"], r["g"], r["fold"]): r["r2"] for r in found}
    edges = bo.feature_edges(rows, layout.p, 64)
    assert len(got) == 12
    for (model, g, f), r in got.items():
        train, test = (group == g) & (fold != f), (group == g) & (fold == f)
        cols = [0, 1, 2] if model == "n" else [1]
        p = plain_boost(x[:, cols], y[:, 0], train, [edges[c] for c in cols], 4, 0.5, 4)
        assert np.isclose(r, r2(y[test, 0], p[test]), atol=1e-9)
    assert len(asked) == 1 if rounds == 1 else len(asked) >= rounds
    large = {key for one in asked[1:] for key in one}
    assert len(large) == {50_000: 0, 270: 3, 0: 6}[limit]
