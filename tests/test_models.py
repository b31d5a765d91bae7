"""Folds, cross-product sums, sweeps, learners and components against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.operators import gram as gram_module
from areascope.operators import sweeps
from areascope.operators.design import design
from areascope.operators import folds
from areascope.operators.folds import group_folds, holdout, row_folds, with_group_folds
from areascope.operators.gram import Sums, gram
from areascope.operators.learners import fit_predict
from areascope.operators.projection import Projection, pca_apply, pca_fit, pca_fit_sample
from areascope.operators.stats import fold_summary, gate, r2_score
from areascope.operators.sweeps import Model

N, DIMS = 700, 6


@pytest.fixture(autouse=True, params=[1, 8])
def outcomes_per_task(request, monkeypatch):
    monkeypatch.setattr(sweeps, "OUTCOMES_PER_TASK", request.param)


@pytest.fixture(scope="module")
def areas(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, DIMS)) + 3
    index = rng.normal(size=N) * 10 + 50
    state = np.where(rng.random(N) < 0.4, 0, rng.integers(1, 12, N))
    y1 = x @ rng.normal(size=DIMS) + np.sin(index / 10) + rng.normal(size=N) * 0.3 + 1000
    y2 = x[:, 0] ** 2 + 0.05 * index + rng.normal(size=N) * 0.5
    y2[rng.random(N) < 0.3] = np.nan
    few = np.where(rng.random(N) < 0.1, y1, np.nan)
    rows = [
        (i, int(state[i]), [float(v) for v in x[i]], float(index[i]) if i % 13 else None,
         float(y1[i]), None if np.isnan(y2[i]) else float(y2[i]),
         None if np.isnan(few[i]) else float(few[i]))
        for i in range(N)
    ]
    df = spark.createDataFrame(
        rows, "id int, state int, v array<double>, idx double, y1 double, y2 double, few double"
    ).repartition(5).cache()
    return df, x, state, index, y1, y2, few


def np_ridge(x, y, alpha):
    mx, my = x.mean(0), y.mean()
    b = np.linalg.solve((x - mx).T @ (x - mx) + alpha * np.eye(x.shape[1]), (x - mx).T @ (y - my))
    return b, my - mx @ b


def np_r2(y, p):
    return 1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_gram_sums(spark, areas, monkeypatch):
    df, x, state, _, y1, y2, few = areas
    rows = df.select("state", F.col("v").alias("x"), F.array("y1", "y2", "few").alias("y"))
    monkeypatch.setattr(gram_module, "FLUSH_BYTES", 3000)
    sums = gram(rows, ["state"], DIMS, 3).toPandas()
    for s, part in sums.groupby("state"):
        got = Sums.from_rows(part, DIMS, 3)
        for o, y in enumerate((y1, y2, few)):
            keep = (state == s) & ~np.isnan(y)
            z = np.hstack([np.ones((keep.sum(), 1)), x[keep]])
            xx, xy, yy, n = got.outcome(o)
            assert n == keep.sum()
            np.testing.assert_allclose(xx, z.T @ z, rtol=1e-9, atol=1e-8)
            np.testing.assert_allclose(xy, z.T @ y[keep], rtol=1e-9, atol=1e-8)
            assert yy == pytest.approx((y[keep] ** 2).sum(), rel=1e-9, abs=1e-9)


def test_group_folds(spark):
    sizes = {"a": 50, "b": 7, "c": 7, "d": 5, "e": 3, "f": 1}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "g string")
    got = {r.g: r.fold for r in group_folds(df, "g", 3).collect()}
    assert got == {"a": 0, "c": 1, "b": 2, "d": 1, "e": 2, "f": 2}
    loads = [sum(sizes[g] for g in got if got[g] == f) for f in range(3)]
    assert sorted(loads) == [11, 12, 50]
    few = {r.fold for r in group_folds(df.where("g IN ('a', 'b')"), "g", 5).collect()}
    assert few == {0, 1}
    assert with_group_folds(df, "g", 3).count() == 73


@pytest.mark.parametrize("keys", [[], ["target"]])
def test_folds_by_size_equal_the_list(spark, keys):
    """Any number of groups, hot sizes, names that are null, several ranges of one size."""
    rng = np.random.default_rng(5)
    sizes = np.concatenate([[4000, 900, 37], rng.integers(1, 60, 80), np.ones(300, dtype=int)])
    rows = [(t, f"g{i:04d}" if i else None, int(n) + t) for t in (0, 1) for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "target int, g string, size long")
    df = df if keys else df.where("target = 1").drop("target")
    want = {tuple(r) for r in folds.group_folds_of(df, "g", 5, df, keys).collect()}
    got = folds.place_groups(df, "g", 5, df, keys, max_groups=10, rows_per_part=40).collect()
    assert len(got) == df.count() and {tuple(r) for r in got} == want


def test_row_folds_and_holdout(spark, areas):
    df, *_ = areas
    folds = row_folds(df, "id", 2, 42, ["state"]).groupBy("state", "fold").count().collect()
    by_state = {}
    for r in folds:
        by_state.setdefault(r.state, []).append(r["count"])
    assert all(max(c) - min(c) <= 1 for c in by_state.values() if len(c) == 2)
    split = holdout(df, "state", 0.2, 42)
    tests = split.select("state", "test").distinct().collect()
    assert len(tests) == 12 and sum(r.test for r in tests) == 2  # 2.4 rounds to 2


def test_cv_matches_refits(spark, areas):
    df, x, state, _, y1, y2, few = areas
    folded = with_group_folds(df, "state", 4)
    fold_of = {r.id: r.fold for r in folded.select("id", "fold").collect()}
    fold = np.array([fold_of[i] for i in range(N)])
    rows, layout = design(folded, ["fold"], ["y1", "y2", "few"], vector=("v", DIMS))
    got = {(r.outcome): r for r in sweeps.cv_r2(
        rows, layout, [Model("emb", ("vector",))], min_rows=100).collect()}
    assert set(got) == {"y1", "y2"}  # the third has under 100 rows
    z = (x - x.mean(0)) / x.std(0)
    for name, y in (("y1", y1), ("y2", y2)):
        scores = []
        for f in range(4):
            tr, te = (fold != f) & ~np.isnan(y), (fold == f) & ~np.isnan(y)
            b, a = np_ridge(z[tr], y[tr], 1.0)
            scores.append(np_r2(y[te], z[te] @ b + a))
        assert got[name].r2_mean == pytest.approx(np.mean(scores), abs=1e-8)
        assert got[name].r2_std == pytest.approx(np.std(scores), abs=1e-8)
        assert got[name].n == (~np.isnan(y)).sum()


def test_two_stage_and_sets(spark, areas):
    df, x, state, index, y1, y2, _ = areas
    split = holdout(df, "state", 0.2, 42)
    test_of = {r.id: r.test for r in split.select("id", "test").collect()}
    test = np.array([test_of[i] for i in range(N)])
    rows, layout = design(
        split, ["test"], ["y1", "y2"], vector=("v", DIMS), binned={"idx": "idx"}, bins=8
    )
    second = Model("emb", ("vector",))
    first = Model("idx", ("idx",), "bins")
    got = {r.outcome: r for r in sweeps.residual_r2(
        rows, layout, [first], second, min_test=20).collect()}
    known = index.copy()
    known[np.arange(N) % 13 == 0] = np.nan
    edges = np.nanquantile(known, [i / 8 for i in range(1, 8)])
    bins = np.where(np.isnan(known), 8, np.searchsorted(edges, np.nan_to_num(known)))
    z = (x - x.mean(0)) / x.std(0)
    for name, y in (("y1", y1), ("y2", y2)):
        ok = ~np.isnan(y)
        tr, te = ~test & ok, test & ok
        means = {k: y[tr & (bins == k)].mean() for k in set(bins[tr])}
        p = np.array([means.get(k, y[tr].mean()) for k in bins])
        res = y - p
        b, a = np_ridge(z[tr], res[tr], 1.0)
        r = got[name]
        assert r.r2_index == pytest.approx(np_r2(y[te], p[te]), abs=1e-8)
        assert r.r2_residual == pytest.approx(np_r2(res[te], z[te] @ b + a), abs=1e-8)
        assert r.additional_var == pytest.approx(max(0, r.r2_residual) * max(0, 1 - r.r2_index))
        assert (r.n_train, r.n_test) == (tr.sum(), te.sum())
    sets = sweeps.compare_sets(
        rows, layout, [first, second, Model("both", ("idx", "vector"))], min_test=20
    ).collect()
    r2 = {(r.outcome, r.model): r.r2 for r in sets}
    assert r2[("y1", "idx")] == pytest.approx(got["y1"].r2_index)
    assert r2[("y1", "both")] > r2[("y1", "idx")]
    assert sweeps.compare_sets(rows, layout, [first], min_test=10**6).count() == 0


def test_sweep_by_group(spark, areas):
    df, x, state, _, y1, y2, _ = areas
    folded = row_folds(df, "id", 2, 42, ["state"])
    fold_of = {r.id: r.fold for r in folded.select("id", "fold").collect()}
    fold = np.array([fold_of[i] for i in range(N)])
    rows, layout = design(folded, ["state", "fold"], ["y1", "y2", "few"], vector=("v", DIMS))
    out = {r.state: r for r in sweeps.sweep_by(
        rows, layout, [Model("emb", ("vector",))], "state").collect()}
    z = (x - x.mean(0)) / x.std(0)
    for s in range(12):
        here = state == s
        if here.sum() < 50:
            assert s not in out
            continue
        per_outcome = []
        for y in (y1, y2):
            ok = here & ~np.isnan(y)
            if ok.sum() < 50:
                continue
            scores = []
            for f in (0, 1):
                tr, te = ok & (fold != f), ok & (fold == f)
                b, a = np_ridge(z[tr], y[tr], 1.0)
                scores.append(np_r2(y[te], z[te] @ b + a))
            per_outcome.append(np.mean(scores))
        if per_outcome:
            assert out[s].r2_emb == pytest.approx(np.mean(per_outcome), abs=1e-8)
            assert (out[s].n_outcomes, out[s].n_tracts) == (len(per_outcome), here.sum())


def test_ridge_closed_form(spark, areas):
    df, x, _, index, y1, *_ = areas
    wide = df.select("id", "y1", "idx", *[F.col("v")[i].alias(f"x{i}") for i in range(DIMS)])
    wide = wide.withColumn("train", F.col("id") < 500)
    names = [f"x{i}" for i in range(DIMS)]
    got = {r.id: r.prediction for r in fit_predict(wide, names, "y1", "train").collect()}
    b, a = np_ridge(x[:500], y1[:500], 1.0)
    np.testing.assert_allclose([got[i] for i in range(N)], x @ b + a, rtol=1e-9)
    # rows with a missing predictor are neither fitted nor predicted
    part = {r.id: r.prediction for r in fit_predict(wide, ["idx"], "y1", "train").collect()}
    assert part[13] is None and part[14] is not None
    keep = (np.arange(N) % 13 != 0) & (np.arange(N) < 500)
    b, a = np_ridge(index[keep][:, None], y1[keep], 1.0)
    assert part[14] == pytest.approx(index[14] * b[0] + a, rel=1e-9)


def test_bins_and_trees(spark, areas):
    df, *_ = areas
    wide = df.select("id", "y1", "idx", F.col("v")[0].alias("x0")).withColumn(
        "train", F.col("id") % 2 == 0
    )
    bins = fit_predict(wide, ["idx"], "y1", "train", "bins", bins=5)
    assert bins.where("prediction IS NULL").count() == 0
    assert bins.select("prediction").distinct().count() == 6  # five bins and the missing one
    trees = fit_predict(wide, ["idx", "x0"], "y1", "train", "gbt", trees=5, depth=3)
    assert trees.where("prediction IS NULL").count() == 0
    scored = r2_score(trees.where("train"), "y1", "prediction").first()
    assert 0.0 < scored.r2 < 1.0 and scored.n == 350
    with pytest.raises(ValueError):
        fit_predict(wide, ["idx"], "y1", "train", "other")


def test_trees_on_counted_bins_equal_mllib(spark, monkeypatch):
    """Same predictions as trees on the rows themselves, which are counted by bin before trees read them."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from areascope.operators import learners

    rng = np.random.default_rng(4)
    n = 3000
    a, b, c = rng.integers(0, 12, n), rng.normal(size=n).round(3), rng.normal(size=n)
    y = a * 0.3 + np.where(b > 0.4, 2.0, 0.0) + rng.normal(scale=0.5, size=n)
    hole = rng.random(n) < 0.3
    df = spark.createDataFrame(
        [(i, float(a[i]), None if hole[i] else float(b[i]), float(c[i] > 1), float(y[i]), bool(i % 5)) for i in range(n)],
        "id int, a double, b double, c double, y double, train boolean",
    ).repartition(4)
    read, plain = [], GBTRegressor.fit
    monkeypatch.setattr(learners.GBTRegressor, "fit", lambda self, rows: read.append(rows.count()) or plain(self, rows))
    settings = {"trees": 6, "step": 0.5, "depth": 4}
    got = {r.id: r.prediction for r in fit_predict(df, ["a", "b", "c"], "y", "train", "gbt", **settings).collect()}
    twice = df.unionAll(df.withColumn("id", F.col("id") + n))
    fit_predict(twice, ["a", "b", "c"], "y", "train", "gbt", **settings)
    assert read[0] == read[1] <= 12 * 33 * 2 < 2400  # as many rows for twice the table
    mean = df.where("train").agg(F.avg("b")).first()[0]
    x = F.array(F.col("a"), F.coalesce("b", F.lit(mean)), F.col("c"),
                *[F.col(k).isNull().cast("double") for k in ("a", "b", "c")])
    rows = df.withColumn("x", array_to_vector(x))
    model = plain(GBTRegressor(featuresCol="x", labelCol="y", maxIter=6, stepSize=0.5, maxDepth=4,
                               minInstancesPerNode=20, seed=42), rows.where("train"))
    want = {r.id: r.prediction for r in model.transform(rows).collect()}
    np.testing.assert_allclose([got[i] for i in range(n)], [want[i] for i in range(n)], atol=1e-9)
    values = rows.where("train").select(F.coalesce("b", F.lit(mean)).alias("b"))
    assert learners.tree_edges(values, "b") == learners.tree_edges(values, "b", rows_per_bucket=100)


def test_boosted_fit_is_not_cut(spark, monkeypatch):
    """The registered query fits the reference's 300 trees at a step of 0.05."""
    from inspect import signature

    from areascope.queries import models

    used = {}

    def record(df, *args, **more):
        call = signature(fit_predict).bind(df, *args, **more)
        call.apply_defaults()
        used.update(call.arguments)
        return df.withColumn("prediction", F.lit(0.0))

    monkeypatch.setattr(models, "fit_predict", record)
    models.boosted_fit(spark, "/root/testdata/sf0.001")
    assert (used["learner"], used["trees"], used["step"]) == ("gbt", 300, 0.05)


def test_pca(spark, areas, tmp_path):
    df, x, *_ = areas
    holes = df.select("id", F.when(F.col("id") == 5, F.array(*[F.lit(None).cast("double")] * DIMS))
                      .otherwise(F.col("v")).alias("v"))
    model = pca_fit(holes, "v", 3)
    kept = np.delete(x, 5, axis=0)
    centred = kept - kept.mean(0)
    _, s, vt = np.linalg.svd(centred, full_matrices=False)
    np.testing.assert_allclose(model.ratios, (s**2 / (s**2).sum())[:3], rtol=1e-9)
    vt = vt[:3] * np.sign(vt[:3][range(3), np.abs(vt[:3]).argmax(1)])[:, None]
    np.testing.assert_allclose(model.components, vt, atol=1e-9)
    model.save(str(tmp_path / "pca"))
    loaded = Projection.load(str(tmp_path / "pca"))
    got = {r.id: r.pc for r in pca_apply(holes, "v", loaded).collect()}
    assert got[5] is None
    np.testing.assert_allclose(got[7], (x[7] - kept.mean(0)) @ vt.T, atol=1e-9)
    shares = model.explained(df).collect()
    assert shares[-1].cumulative == pytest.approx(sum(model.ratios))
    assert len(pca_fit_sample(holes, "v", "id", 2, 0.05, 1).ratios) == 2


def test_scores_and_gates(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0), ("a", 3.0, 2.0), ("b", 2.0, 2.0), ("b", 2.0, 2.0), ("c", 2.0, 1.0),
         ("c", 2.0, None)],
        "k string, y double, p double",
    )
    got = {r.k: (r.n, r.r2, r.mae) for r in r2_score(df, "y", "p", ["k"]).collect()}
    assert got == {"a": (2, 0.5, 0.5), "b": (2, 1.0, 0.0), "c": (1, 0.0, 1.0)}
    folds = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("a", float("nan"))], "k string, r2 double")
    r = fold_summary(folds, ["k"], "r2").first()
    assert r.r2_mean == pytest.approx(0.3) and r.r2_std == pytest.approx(0.1)
    kept = gate(df, ["k"], {"n": (F.lit(True), 2), "ones": (F.col("p") == 1, 1)})
    assert {r.k for r in kept.collect()} == {"a", "c"}


def test_measures_with_error(spark, areas):
    df, x, state, index, y1, *_ = areas
    split = holdout(df.where("idx IS NOT NULL"), "state", 0.2, 42)
    test_of = {r.id: r.test for r in split.select("id", "test").collect()}
    split = split.withColumn("flat", F.lit(3.0))
    rows, layout = design(
        split, ["test"], ["y1", "few", "flat"], vector=("v", DIMS), numeric={"idx": ["idx"]},
        scale=False,
    )
    models = [Model("emb", ("vector",)), Model("idx", ("idx",))]
    got = {(r.outcome, r.model): r for r in sweeps.score_measures(
        rows, layout, models, min_test=20).collect()}
    assert set(got) == {("y1", "emb"), ("y1", "idx")}  # few: under 20 test rows; flat: constant
    have = np.array([i in test_of for i in range(N)])
    test = np.array([test_of.get(i, False) for i in range(N)])
    for name, z in (("emb", x), ("idx", index[:, None])):
        b, a = np_ridge(z[have & ~test], y1[have & ~test], 1.0)
        p = z[test] @ b + a
        r = got[("y1", name)]
        assert r.r2 == pytest.approx(np_r2(y1[test], p), abs=1e-8)
        assert r.mae == pytest.approx(np.abs(y1[test] - p).mean(), rel=1e-8)
        assert (r.n_train, r.n_test) == ((have & ~test).sum(), test.sum())


def test_holdout_with_many_groups(spark, areas, monkeypatch):
    import areascope.operators.folds as folds

    df, *_ = areas
    listed = {(r.id, r.test) for r in holdout(df, "state", 0.2, 42).select("id", "test").collect()}
    monkeypatch.setattr(folds, "LISTED_GROUPS", 0)
    joined = {(r.id, r.test) for r in holdout(df, "state", 0.2, 42).select("id", "test").collect()}
    assert listed == joined


def test_vectors_with_holes(spark):
    nan = float("nan")
    rows = [(1, [1.0, 2.0], 1.0), (2, [3.0, None], 2.0), (3, [nan, 6.0], 3.0), (4, None, 4.0), (5, [5.0], 5.0)]
    df = spark.createDataFrame(rows, "id int, v array<double>, y double")
    out, layout = design(df, ["id"], ["y"], vector=("v", 2))
    got = {r.id: r.x for r in out.collect()}
    s = np.std([1.0, 3.0, 5.0])
    assert layout.cols("vector") == [1, 2, 3]
    assert got[1] == pytest.approx([-2 / s, -1, 0]) and got[2] == pytest.approx([0, 0, 1])
    assert got[3] == pytest.approx([0, 1, 1]) and got[4] == [0, 0, 1]
    assert got[5] == pytest.approx([2 / s, 0, 1])
    part, _ = design(df, ["id"], ["y"], vector=("v", 2), train="id <= 2")
    assert {r.id: r.x for r in part.collect()}[5] == pytest.approx([3, 0, 1])


def test_sums_leave_out_incomplete_rows(spark):
    rows = [([1.0, 2.0], [1.0]), (None, [9.0]), ([3.0, None], [9.0]), ([float("nan"), 1.0], [9.0]), ([2.0, 5.0], [None])]
    df = spark.createDataFrame(rows, "x array<double>, y array<double>")
    xx, xy, yy, n = Sums.from_rows(gram(df, [], 2, 1).toPandas(), 2, 1).outcome(0)
    assert n == 1 and yy == 1.0 and list(xy) == [1.0, 1.0, 2.0] and xx[0, 0] == 1
