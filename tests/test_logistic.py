"""Logistic fits of counted people against a plain NumPy fit of single people."""

import numpy as np
import pytest

from areascope.operators import logistic
from areascope.operators.design import design
from areascope.operators.logistic import auc, count_people, counted, held_out_logistic
from areascope.operators.sweeps import Model

MODELS = [
    Model("index", ("index",), alpha=0.5), Model("vector", ("vector",)),
    Model("both", ("index", "vector"), alpha=2.0),
]


def plain_fit(x, y, alpha):
    x = np.hstack([np.ones((len(x), 1)), x])
    ridge = alpha * np.r_[0.0, np.ones(x.shape[1] - 1)]
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve((x.T * (p * (1 - p))) @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
    return w


def plain_auc(p, y):
    yes, no = p[y == 1], p[y == 0]
    return np.mean((yes[:, None] > no) + 0.5 * (yes[:, None] == no))


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(7)
    n, m, dims = 60, 3000, 3
    index, vector = rng.normal(size=n), rng.normal(size=(n, dims))
    test = np.arange(n) % 4 == 0
    area = np.minimum(rng.geometric(0.05, m) - 1, n - 1)  # the first areas hold most people
    area[rng.random(m) < 0.33] = 1
    chance = 1 / (1 + np.exp(-(0.8 * index + vector @ [1.0, -0.5, 0.0])[area]))
    ill, rare = (rng.random(m) < chance) * 1.0, (rng.random(m) < 0.1) * 1.0
    ill[rng.random(m) < 0.2] = np.nan
    people = spark.createDataFrame(
        [(int(a), None if np.isnan(i) else bool(i), float(r)) for a, i, r in zip(area, ill, rare)]
        + [(None, True, 1.0), (5000, True, 1.0), (2, None, None), (2, None, float("nan"))],
        "area int, ill boolean, rare double",
    )
    areas = spark.createDataFrame(
        [(a, bool(test[a]), float(index[a]), [float(v) for v in vector[a]]) for a in range(n)],
        "area int, test boolean, i double, v array<double>",
    )
    outcomes = ["ill", "rare"]
    lived_in = areas.join(count_people(people, "area", outcomes), "area", "left")
    rows, layout = design(
        lived_in, ["test"], counted(outcomes), vector=("v", dims), numeric={"index": ["i"]}, scale=False
    )
    data = {"index": index[:, None][area], "vector": vector[area], "ill": ill, "rare": rare, "test": test[area]}
    return rows, layout, outcomes, data


def test_equals_a_fit_of_single_people(world):
    rows, layout, outcomes, data = world
    got = {(r.outcome, r.model): r for r in held_out_logistic(rows, layout, MODELS, outcomes, 7).collect()}
    assert len(got) == 6
    for o in outcomes:
        y, have = data[o], ~np.isnan(data[o])
        for m in MODELS:
            x = np.hstack([data[b] for b in m.blocks])
            train, test = have & ~data["test"], have & data["test"]
            w = plain_fit(x[train], y[train], m.alpha)
            p = 1 / (1 + np.exp(-(w[0] + x[test] @ w[1:])))
            loss = -np.mean(np.where(y[test] == 1, np.log(p), np.log(1 - p)))
            r = got[o, m.name]
            assert (r.n_train, r.n_test) == (train.sum(), test.sum())
            assert r.log_loss == pytest.approx(loss, abs=1e-9)
            assert r.auc == pytest.approx(plain_auc(p, y[test]), abs=1e-9)


def test_separable_single_class_and_empty(spark):
    rows = [(i, float(i), 1.0 if i > 5 else 0.0, 1.0, None) for i in range(12)]
    df = spark.createDataFrame(rows, "area int, i double, split double, always double, nobody double")
    outcomes = ["split", "always", "nobody"]
    lived_in = df.select("area", "i").join(count_people(df, "area", outcomes), "area")
    data, layout = design(lived_in, [], counted(outcomes), numeric={"index": ["i"]})
    weights = logistic.fit_logistic(data, layout, [Model("m", ("index",), alpha=0.1)], outcomes)
    assert all(np.isfinite(w).all() for w in weights.values())
    assert weights["split", "m"][1] > 1 and weights["always", "m"][0] > 3
    assert not weights["nobody", "m"].any()
    none = lived_in.where("false")
    data, layout = design(none, [], counted(outcomes), numeric={"index": ["i"]})
    assert not logistic.fit_logistic(data, layout, [Model("m", ("index",))], outcomes)["split", "m"].any()


def test_wrong_outcome_stops(spark):
    df = spark.createDataFrame([(1, 2.0)], "area int, y double")
    with pytest.raises(Exception, match="neither 0 nor 1"):
        count_people(df, "area", ["y"]).collect()


def test_auc_in_buckets(spark):
    rng = np.random.default_rng(3)
    p, y = rng.integers(0, 40, 900) / 40, rng.integers(0, 2, 900)
    p[:300] = 0.5  # a score shared by a third
    rows = [("a", float(s), float(t), 1.0 - float(t)) for s, t in zip(p, y)] + [("b", 0.1, 1.0, 0.0)]
    df = spark.createDataFrame(rows, "k string, p double, yes double, no double")
    for size in (10, 10_000):
        got = {r.k: r.auc for r in auc(df, ["k"], "p", "yes", "no", size).collect()}
        assert got["a"] == pytest.approx(plain_auc(p, y)) and got["b"] is None
