"""Ranks and quantiles: the bucketed path must equal the simple one, whatever the skew."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.functions.ranking import (
    exact_quantiles,
    grouped_stats,
    hash_rank,
    percentile_rank,
    value_rank,
)
from areascope.operators import joins
from areascope.operators.stats import area_decile, histogram, paginate, sample_groups, sample_rows

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.fixture(scope="module")
def skewed(spark):
    """Key 0 holds most rows, one value is shared by a third of them, some are missing."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(3000):
        key = 0 if rng.random() < 0.6 else int(rng.integers(1, 40))
        value = 7.0 if rng.random() < 0.35 else float(np.round(rng.lognormal(2, 2), 3))
        if rng.random() < 0.05:
            value = None
        rows.append((i, None if key == 39 else key, value))
    return spark.createDataFrame(rows, "id int, k int, v double").repartition(6).cache()


def by_key(skewed):
    out = {}
    for r in skewed.collect():
        if r.v is not None:
            out.setdefault(r.k, []).append(r.v)
    return out


@pytest.mark.parametrize("per_bucket", [10**6, 100, 17])
def test_quantiles_by_key(skewed, per_bucket):
    got = {r.k: r.q for r in exact_quantiles(
        skewed, ["k"], "v", PROBS, rows_per_bucket=per_bucket).collect()}
    want = by_key(skewed)
    assert set(got) == set(want)
    for k, values in want.items():
        np.testing.assert_allclose(got[k], np.quantile(values, PROBS), rtol=1e-12)


@pytest.mark.parametrize("per_bucket", [10**6, 50])
def test_quantiles_overall(skewed, per_bucket):
    got = exact_quantiles(skewed, [], "v", PROBS, rows_per_bucket=per_bucket).first().q
    values = [v for vs in by_key(skewed).values() for v in vs]
    np.testing.assert_allclose(got, np.quantile(values, PROBS), rtol=1e-12)


def test_quantiles_when_all_groups_are_large(skewed, monkeypatch):
    import areascope.functions.ranking as ranking

    monkeypatch.setattr(ranking, "BROADCAST_ROWS", 3)
    got = {r.k: r.q for r in exact_quantiles(
        skewed, ["k"], "v", PROBS, rows_per_bucket=10).collect()}
    want = by_key(skewed)
    assert set(got) == set(want)
    for k, values in want.items():
        np.testing.assert_allclose(got[k], np.quantile(values, PROBS), rtol=1e-12)


def test_quantiles_of_one_shared_value(spark):
    df = spark.createDataFrame([(i % 2, 4.0) for i in range(50)], "k int, v double")
    for per_bucket in (10**6, 5):
        got = exact_quantiles(df, ["k"], "v", [0.5], rows_per_bucket=per_bucket).collect()
        assert {r.k: r.q for r in got} == {0: [4.0], 1: [4.0]}


def test_quantiles_when_hits_are_many(skewed, monkeypatch):
    import areascope.functions.ranking as ranking

    monkeypatch.setattr(ranking, "is_small", lambda *a: False)
    got = {r.k: r.q for r in exact_quantiles(
        skewed, ["k"], "v", PROBS, rows_per_bucket=60).collect()}
    for k, values in by_key(skewed).items():
        np.testing.assert_allclose(got[k], np.quantile(values, PROBS), rtol=1e-12)


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("per_bucket", [10**6, 100])
def test_grouped_stats(skewed, keys, per_bucket):
    out = grouped_stats(
        skewed, keys, "v", [F.count("v").alias("n"), F.max("v").alias("top")], [0.5],
        rows_per_bucket=per_bucket,
    ).collect()
    want = by_key(skewed)
    if not keys:
        want = {None: [v for vs in want.values() for v in vs]}
    assert len(out) == len(want)
    for r in out:
        values = want[r.k if keys else None]
        assert (r.n, r.top) == (len(values), max(values))
        assert r.q[0] == pytest.approx(np.median(values))


@pytest.mark.parametrize("per_bucket", [10**6, 100])
@pytest.mark.parametrize("shuffled", [False, True])
def test_percentile_rank(skewed, per_bucket, shuffled, monkeypatch):
    if shuffled:
        monkeypatch.setattr(joins, "is_small", lambda *a: False)
        import areascope.functions.ranking as ranking

        monkeypatch.setattr(ranking, "BROADCAST_ROWS", 0)
    rows = percentile_rank(skewed, "v", "nr", per_bucket).collect()
    assert len(rows) == 3000
    values = np.sort([r.v for r in rows if r.v is not None])
    for r in rows:
        if r.v is None:
            assert r.nr is None
        else:
            lo, hi = np.searchsorted(values, r.v), np.searchsorted(values, r.v, side="right")
            assert r.nr == pytest.approx((lo + 1 + hi) / 2 / len(values) * 100)


@pytest.mark.parametrize("per_bucket", [10**6, 40])
def test_hash_rank(skewed, per_bucket):
    ranked = hash_rank(skewed, "id", 42, "r", ["k"], per_bucket).collect()
    plain = hash_rank(skewed, "id", 42, "r", ["k"]).collect()
    assert {(r.id, r.r) for r in ranked} == {(r.id, r.r) for r in plain}
    groups = {}
    for r in ranked:
        groups.setdefault(r.k, []).append(r.r)
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in groups.values())


@pytest.mark.parametrize("per_bucket", [10**6, 40])
@pytest.mark.parametrize("descending", [False, True])
def test_value_rank(skewed, per_bucket, descending):
    rows = value_rank(skewed, "v", "id", "r", descending, per_bucket).collect()
    assert sorted(r.r for r in rows) == list(range(1, 3001))
    ordered = [r.v for r in sorted(rows, key=lambda r: r.r)]
    there = [v for v in ordered if v is not None]
    assert there == sorted(there, reverse=descending)
    assert all(v is None for v in ordered[len(there):])


def test_decile_edges_go_low(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "x double")
    got = {r.x: r.decile for r in area_decile(df, "x").collect()}
    assert got[0.0] == 1 and got[1.0] == 1 and got[1.0 + 1] == 2 and got[10.0] == 10
    assert got[None] is None
    ties = spark.createDataFrame([(5.0,)] * 20 + [(9.0,)], "x double")
    assert {r.decile for r in area_decile(ties, "x").where("x = 5").collect()} == {1}


def test_histogram_last_bin_closed_and_constant(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (9.99,), (10.0,)], "x double")
    bins = {r.bin: r.n for r in histogram(df, "x", 10).collect()}
    assert bins[9] == 2 and bins[0] == 1 and bins[1] == 1 and len(bins) == 10
    flat = spark.createDataFrame([(3.0,)] * 4, "x double")
    assert {r.bin: r.n for r in histogram(flat, "x", 5).collect()}[0] == 4


def test_samples(spark, skewed):
    assert sample_groups(skewed, "k", 1, frac=0.2).count() == 8  # 39 keys, 7.8
    assert sample_groups(skewed, "k", 1, k=5).count() == 5
    a = {r.id for r in sample_rows(skewed, "id", 10, 0.1, 7).collect()}
    b = {r.id for r in sample_rows(skewed, "id", 10, 0.1, 7, rows_per_bucket=50).collect()}
    assert a == b and len(a) == 300
    assert sample_rows(skewed, "id", 10**6, 0.1, 7).count() == 3000


def test_paginate(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(23)], "id int, v double")
    pages = paginate(df, "v", "id", 10, rows_per_bucket=5).collect()
    assert sorted((r.page, r.slot) for r in pages) == [(i // 10, i % 10) for i in range(23)]


def test_salted_join_equals_join(spark, skewed):
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(30)], "k int, name string")
    for how in ("left", "inner", "left_semi"):
        want = skewed.join(dim, "k", how).collect()
        got = joins.salted_join(skewed, dim, ["k"], how).select(
            *skewed.join(dim, "k", how).columns
        ).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_order_like_works_scores_out_once(spark):
    """Scores that come out otherwise each time still give every place once."""
    from areascope.operators.stats import order_like

    @F.udf("double")
    def noise(_):
        import random

        return random.random()

    keys = spark.range(200).withColumnRenamed("id", "key").repartition(4)
    ordering = keys.withColumn("score", noise.asNondeterministic()("key"))
    got = order_like(keys, "key", ordering, "score", rows_per_bucket=3).collect()
    assert sorted(r["position"] for r in got) == list(range(1, 201))


def test_equal_means_tie_in_any_order_of_rows(spark, tmp_path):
    from areascope.queries.summaries import scores

    prices = [0.1, 0.2, 0.3]
    rows = [(1, p) for p in prices] + [(2, p) for p in reversed(prices)]
    df = spark.createDataFrame(rows, "l_suppkey long, l_extendedprice double").coalesce(1)
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = {r["score"] for r in scores(spark, str(tmp_path)).collect()}
    assert len(found) == 1
