"""Counts, scores, gates, percentiles, histograms, ordering and sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.functions.ranking import (
    exact_quantiles,
    grouped_stats,
    hash_rank,
    seeded_hash,
    value_rank,
)
from areascope.functions.scalars import edges_below, r2_from_sums
from areascope.operators.joins import lookup_join, union_all
from areascope.session import ROWS_PER_BUCKET, materialise

TOP_ROWS = 1_000_000


# --- counts and ranges --------------------------------------------------------------------


def count_by(df: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(out))


def n_distinct(df: DataFrame, c: str, out: str) -> DataFrame:
    """Exact distinct count. One distinct level, then a count, so no set is held in a task."""
    return df.select(c).where(F.col(c).isNotNull()).distinct().agg(
        F.count(F.lit(1)).alias(out)
    )


def distinct_sorted(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns).distinct().orderBy(*columns)


def range_and_median(
    df: DataFrame, c: str, keys: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Smallest, largest and median value, overall or per key."""
    keys = list(keys or [])
    ends = [F.min(c).alias("min"), F.max(c).alias("max")]
    out = grouped_stats(df, keys, c, ends, [0.5], "__q", rows_per_bucket)
    return out.select(*keys, "min", "max", F.col("__q")[0].alias("median"))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, missing, mean, population std, min and max of each column, one pass."""
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.count_if(F.col(c).isNull()).alias("missing"),
            F.avg(c).alias("mean"),
            F.stddev_pop(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def preview(df: DataFrame, n: int = 3) -> DataFrame:
    return df.limit(n)


def median_by(
    df: DataFrame, keys: list[str], c: str, out: str = "median",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    q = exact_quantiles(df, keys, c, [0.5], "__q", rows_per_bucket)
    return q.select(*keys, F.col("__q")[0].alias(out))


# --- scores -------------------------------------------------------------------------------


def r2_score(
    df: DataFrame, y: str, p: str, keys: list[str] | None = None, out: str = "r2"
) -> DataFrame:
    """R² and mean absolute error of predictions, per key, with the number of rows."""
    seen = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    miss = F.col(y) - F.col(p)
    return (
        seen.groupBy(*(keys or []))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(miss * miss).alias("__sse"),
            (F.var_pop(y) * F.count(y)).alias("__sst"),
            F.avg(F.abs(miss)).alias("mae"),
        )
        .withColumn(out, r2_from_sums(F.col("__sse"), F.col("__sst")))
        .drop("__sse", "__sst")
    )


def fold_summary(
    scores: DataFrame, keys: list[str], score: str, more: list[Column] | None = None
) -> DataFrame:
    """Mean and population standard deviation over folds; a missing or NaN score is skipped."""
    s = F.when(~F.isnan(score), F.col(score))
    return scores.groupBy(*keys).agg(
        F.avg(s).alias(f"{score}_mean"), F.stddev_pop(s).alias(f"{score}_std"), *(more or [])
    )


def gate(df: DataFrame, keys: list[str], at_least: dict[str, tuple[Column, int]]) -> DataFrame:
    """Keys for which every named condition holds on at least so many rows, with the counts."""
    counts = df.groupBy(*keys).agg(
        *[F.count_if(cond).alias(name) for name, (cond, _) in at_least.items()]
    )
    for name, (_, n) in at_least.items():
        counts = counts.where(F.col(name) >= n)
    return counts


def varies(df: DataFrame, keys: list[str], c: str, least: float = 1e-6) -> DataFrame:
    """Keys whose values are not (nearly) constant."""
    return (
        df.groupBy(*keys).agg(F.stddev_pop(c).alias("__sd")).where(F.col("__sd") >= least)
    ).select(*keys)


# --- distributions ------------------------------------------------------------------------


def percentile_edges(
    df: DataFrame, c: str, n: int = 10, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """One row with the n+1 interpolated percentile edges of a column."""
    return exact_quantiles(df, [], c, [i / n for i in range(n + 1)], "edges", rows_per_bucket)


def area_decile(
    df: DataFrame, c: str, out: str = "decile", n: int = 10,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Label 1..n: one more than the number of interior edges strictly below the value."""
    found = percentile_edges(df, c, n, rows_per_bucket).first()  # n + 1 numbers
    inner = [e for e in found["edges"][1:-1] if e is not None]
    return df.withColumn(out, F.when(F.col(c).isNotNull(), edges_below(F.col(c), inner) + 1))


def histogram(df: DataFrame, c: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between smallest and largest value; the last bin includes its end.

    Bins without rows are listed with zero.
    """
    span = df.agg(
        F.min(F.col(c).cast("double")).alias("lo"), F.max(F.col(c).cast("double")).alias("hi")
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.floor(F.try_divide(F.col(c) - F.col("lo"), width))
    inside = (
        df.where(F.col(c).isNotNull())
        .select(F.col(c).cast("double").alias(c))
        .crossJoin(F.broadcast(span))  # one row
        .groupBy(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = span.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"),
        F.col("lo"), width.alias("w"),
    ).select(
        "bin",
        (F.col("lo") + F.col("bin") * F.col("w")).alias("low"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"),
    )
    return every.join(inside, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def distribution(
    df: DataFrame, keys: list[str], c: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Shape of a value per key: count, mean, extremes, quartiles and median."""
    base = [
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max")
    ]
    out = grouped_stats(df, keys, c, base, [0.25, 0.5, 0.75], "__q", rows_per_bucket)
    return out.select(
        *keys, "n", "mean", "min", "max", F.col("__q")[0].alias("q1"),
        F.col("__q")[1].alias("median"), F.col("__q")[2].alias("q3"),
    )


# --- order and sample ---------------------------------------------------------------------


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """First k rows in order; every task keeps only its own k."""
    return df.orderBy(*order).limit(k)


def best_worst(df: DataFrame, score: str, key: str, n: int = 3) -> DataFrame:
    """The n best and n worst rows by score, ranked from each end."""
    best = top_k(df, [F.desc_nulls_last(score), F.asc(key)], n).withColumn("end", F.lit("best"))
    worst = top_k(
        df.where(F.col(score).isNotNull()), [F.asc(score), F.asc(key)], n
    ).withColumn("end", F.lit("worst"))
    return union_all(best, worst)


def order_like(
    df: DataFrame, key: str, ordering: DataFrame, score: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Sort rows by the place their key has in another result (lowest score first).

    The scores are written once: ranking passes over them several times, and sums of doubles worked
    out again may differ in the last bit, which would count a row in one bucket and place it in another.
    """
    ordering = materialise(ordering.select(key, score))
    ranked = value_rank(ordering, score, key, "position", rows_per_bucket=rows_per_bucket)
    places = ranked.select(key, "position")
    return lookup_join(df, places, key, "inner").orderBy("position")


def sample_groups(
    df: DataFrame, key: str, seed: int, k: int | None = None, frac: float | None = None,
    top_rows: int = TOP_ROWS, rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Distinct keys chosen without replacement in seeded hash order: k, or a share of them
    (at least one, halves to even). Up to `top_rows` are kept by every task, more are ranked."""
    groups = df.select(key).where(F.col(key).isNotNull()).distinct()
    if k is None:
        k = max(1, round(frac * groups.count()))
    if k <= top_rows:
        return groups.orderBy(seeded_hash(F.col(key), seed), key).limit(k)
    ranked = hash_rank(groups, key, seed, "__r", rows_per_bucket=rows_per_bucket)
    return ranked.where(F.col("__r") <= k).drop("__r")


def sample_rows(
    df: DataFrame, key: str, at_least: int, frac: float, seed: int,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """max(at_least, frac of the rows) rows in seeded hash order, all when there are fewer."""
    n = max(at_least, int(df.count() * frac))
    ranked = hash_rank(df, key, seed, "__r", rows_per_bucket=rows_per_bucket)
    return ranked.where(F.col("__r") <= n).drop("__r")


def paginate(
    df: DataFrame, value: str, key: str, size: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Page number (from 0) and place on the page, rows ordered by value (ties by key hash)."""
    ranked = value_rank(df, value, key, "__r", rows_per_bucket=rows_per_bucket)
    return (
        ranked.withColumn("page", F.expr(f"(__r - 1) div {int(size)}"))
        .withColumn("slot", F.pmod(F.col("__r") - 1, F.lit(size)).cast("int"))
        .drop("__r")
    )
