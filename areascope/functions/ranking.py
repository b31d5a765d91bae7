"""Exact ranks, quantiles and row numbers that never sort a whole group in one task.

The idea is the same everywhere: cut the ordered values into buckets of bounded size, add up
counts per bucket, turn them into running offsets (one short row per bucket) and order only
inside a bucket. Bucket edges are plain literals in the plan, so a recomputed task sees the
same buckets. Any edges give the exact result; balanced edges only keep tasks even.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.operators.joins import is_small, join_null_safe, lookup_join
from areascope.session import BROADCAST_ROWS, ROWS_PER_BUCKET, materialise

MAX_BUCKETS = 16384

# Groups of at most this many rows are aggregated whole; an aggregate holds many at a time.
GROUP_ROWS = 100_000


def value_edges(
    df: DataFrame, value: str, rows_per_bucket: int, n: int | None = None
) -> list[float]:
    """Bucket edges that hold about `rows_per_bucket` rows each; empty when one bucket will do."""
    n = df.count() if n is None else n
    if n <= rows_per_bucket:
        return []
    buckets = min(MAX_BUCKETS, math.ceil(n / rows_per_bucket))
    grid = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(value, grid, 0.25 / buckets)))


def with_bucket(df: DataFrame, value: str, edges: list[float], out: str) -> DataFrame:
    if not edges:
        return df.withColumn(out, F.lit(0.0))
    splits = [-math.inf, *edges, math.inf]
    cut = Bucketizer(splits=splits, inputCol=value, outputCol=out, handleInvalid="keep")
    return cut.transform(df)


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: list[float], out: str = "q",
    rows_per_bucket: int = ROWS_PER_BUCKET, n_rows: int | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles of the non-null values per key: (keys..., out array).

    Groups that fit a task, as counted, take one `percentile` aggregate (or, without keys, one
    ordered pass). In large groups rows are only counted by bucket, which says where each
    wanted rank lies, and the rows of those buckets alone are moved: equal values first become
    one counted row (a value may be shared by a third of the rows), then a bucket is ordered.
    """
    v = "__v"
    data = df.where(F.col(value).isNotNull()).select(
        *keys, F.col(value).cast("double").alias(v)
    )
    rows = data.count() if n_rows is None else n_rows
    if not keys:
        edges = value_edges(data, v, rows_per_bucket, rows)
        return _select_ranks(data, keys, probs, out, edges, rows)
    plain = F.percentile(v, F.array(*[F.lit(p) for p in probs])).alias(out)
    if rows <= rows_per_bucket:
        return data.groupBy(*keys).agg(plain)

    sizes = data.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    large = materialise(sizes.where(F.col("__size") > min(GROUP_ROWS, rows_per_bucket)))
    found = large.agg(F.count(F.lit(1)).alias("n"), F.sum("__size").alias("rows")).first()
    if found["n"] == 0:
        return data.groupBy(*keys).agg(plain)
    if found["n"] > BROADCAST_ROWS:
        edges = value_edges(data, v, rows_per_bucket, rows)
        return _select_ranks(data, keys, probs, out, edges, rows)
    marked = join_null_safe(data, F.broadcast(large), keys, "left")
    few = marked.where("__size IS NULL").drop("__size").groupBy(*keys).agg(plain)
    many = marked.where("__size IS NOT NULL").drop("__size")
    # at least two buckets, so that no large group is taken whole
    per_bucket = min(rows_per_bucket, found["rows"] // 2)
    edges = value_edges(many, v, per_bucket, found["rows"])
    return few.unionByName(_select_ranks(many, keys, probs, out, edges, found["rows"]))


def _select_ranks(
    data: DataFrame, keys: list[str], probs: list[float], out: str, edges: list[float], rows: int
) -> DataFrame:
    """Quantiles by counting rows per bucket and ordering only the buckets that hold a rank."""
    v, b, n = "__v", "__b", "__n"

    def low(p: float) -> Column:
        return F.floor((F.col("__total") - 1) * F.lit(p))

    def high(p: float) -> Column:
        return F.ceil((F.col("__total") - 1) * F.lit(p))

    bucketed = with_bucket(data, v, edges, b)
    if keys or edges:
        sizes = bucketed.groupBy(*keys, b).agg(F.count(F.lit(1)).alias("__cnt"))
        per_key = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        before = per_key.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
        sizes = sizes.withColumn(
            "__offset", F.coalesce(F.sum("__cnt").over(before), F.lit(0))
        ).withColumn("__total", F.sum("__cnt").over(per_key))
        wanted = F.lit(False)
        for p in probs:
            for rank in (low(p), high(p)):
                wanted |= (rank >= F.col("__offset")) & (rank < F.col("__offset") + F.col("__cnt"))
        hit = materialise(sizes.where(wanted).drop("__cnt"))
        counted = [F.count(F.lit(1)).alias(n)]
        if is_small(hit):
            near = join_null_safe(bucketed, F.broadcast(hit), [*keys, b])
            near = near.groupBy(*keys, b, v, "__offset", "__total").agg(*counted)
        else:
            # very many keys: collapse equal values before they are moved
            near = join_null_safe(bucketed.groupBy(*keys, b, v).agg(*counted), hit, [*keys, b])
    else:
        near = bucketed.groupBy(b, v).agg(F.count(F.lit(1)).alias(n))
        near = near.withColumns({"__offset": F.lit(0), "__total": F.lit(rows)})
    running = F.sum(n).over(
        W.partitionBy(*keys, b).orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    near = near.withColumn("__end", F.col("__offset") + running).withColumn(
        "__start", F.col("__end") - F.col(n)
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("__start")) & (rank < F.col("__end")), F.col(v)))

    picks = [F.max("__total").alias("__total")]
    for j, p in enumerate(probs):
        picks += [at(low(p)).alias(f"__lo{j}"), at(high(p)).alias(f"__hi{j}")]
    found = near.groupBy(*keys).agg(*picks)
    values = [
        F.col(f"__lo{j}")
        + (F.col(f"__hi{j}") - F.col(f"__lo{j}"))
        * ((F.col("__total") - 1) * F.lit(p) - low(p))
        for j, p in enumerate(probs)
    ]
    return found.select(*keys, F.array(*values).alias(out))


def grouped_stats(
    df: DataFrame, keys: list[str], value: str, aggs: list[Column], probs: list[float],
    out: str = "q", rows_per_bucket: int = ROWS_PER_BUCKET, stored: bool = False,
) -> DataFrame:
    """Plain aggregates together with exact quantiles of the non-null values per key.

    Few rows: one aggregate does both. Many: the rows are written once (unless they are
    `stored` already), then the aggregates combine on the map side and the quantiles go
    through buckets.
    """
    seen = df.where(F.col(value).isNotNull())
    n = seen.count()
    if n <= rows_per_bucket and keys:
        q = F.percentile(F.col(value).cast("double"), F.array(*[F.lit(p) for p in probs]))
        return seen.groupBy(*keys).agg(*aggs, q.alias(out))
    if n > rows_per_bucket and not stored:
        seen = materialise(seen)
    base = seen.groupBy(*keys).agg(*aggs)
    q = exact_quantiles(seen, keys, value, probs, out, rows_per_bucket, n)
    return join_null_safe(base, q, keys)


def percentile_rank(
    df: DataFrame, value: str, out: str, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Average-tie rank over the non-null values, as a percentage of their number.

    Ranks are worked out on distinct values and looked up, so ties cost nothing and a missing
    value simply finds no rank.
    """
    v, b, n = "__v", "__b", "__n"
    data = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(v))
    rows = data.count()
    edges = value_edges(data, v, rows_per_bucket, rows)
    freq = with_bucket(data, v, edges, b).groupBy(b, v).agg(F.count(F.lit(1)).alias(n))
    sizes = freq.groupBy(b).agg(F.sum(n).alias("__cnt"))
    one = W.partitionBy(F.lit(0))  # at most MAX_BUCKETS rows
    before = one.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(
        b,
        F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__offset"),
        F.sum("__cnt").over(one).alias("__total"),
    )
    inside = F.sum(n).over(
        W.partitionBy(b).orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    place = F.col("__offset") + inside - F.col(n) + (F.col(n) + F.lit(1)) / F.lit(2.0)
    ranks = freq.join(F.broadcast(sizes), b).select(
        F.col(v).alias("__key"), (place / F.col("__total") * 100).alias(out)
    )
    keyed = df.withColumn("__key", F.col(value).cast("double"))
    known = rows if rows <= BROADCAST_ROWS else None  # no more distinct values than rows
    return lookup_join(keyed, ranks, "__key", at_most=known).drop("__key")


def seeded_hash(key: Column, seed: int) -> Column:
    """Order that looks random, is fixed by the seed and is the same in any SQL engine."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}")))


def hash_digits(n: int, rows_per_bucket: int) -> int:
    """Leading hex digits of a hash that cut n rows into parts of at most about `rows_per_bucket`."""
    return 0 if n <= rows_per_bucket else math.ceil(math.log(n / rows_per_bucket, 16))


def hash_rank(
    df: DataFrame, key: str, seed: int, out: str, within: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number the rows 1..n (per `within` group) in seeded hash order; `key` is unique there.

    Hashes are uniform, so leading digits of the hash cut even the heaviest group evenly.
    """
    groups = list(within or [])
    h, b = "__h", "__b"
    n = df.count()
    digits = hash_digits(n, rows_per_bucket)
    hashed = df.withColumn(h, seeded_hash(F.col(key), seed))
    if digits == 0:
        order = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
        nth = F.row_number().over(order.orderBy(h, key)).cast("bigint")
        return hashed.withColumn(out, nth).drop(h)
    hashed = hashed.withColumn(b, F.substring(h, 1, digits))
    sizes = hashed.groupBy(*groups, b).agg(F.count(F.lit(1)).alias("__cnt"))
    per_group = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(0))
    before = per_group.orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    sizes = materialise(
        sizes.select(
            *groups, b, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__offset")
        )
    )
    if is_small(sizes):
        sizes = F.broadcast(sizes)
    inside = F.row_number().over(W.partitionBy(*groups, b).orderBy(h, key))
    return (
        join_null_safe(hashed, sizes, [*groups, b])
        .withColumn(out, F.col("__offset") + inside)
        .drop(h, b, "__offset")
    )


def value_rank(
    df: DataFrame, value: str, key: str, out: str, descending: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Number all rows 1..n by a numeric column without one global sort task.

    Missing values come last; rows with the same value follow the hash of their key, so a
    value shared by very many rows can be cut further and no bucket is larger than planned.
    """
    v, b, s, h = "__v", "__b", "__s", "__h"
    signed = -F.col(value).cast("double") if descending else F.col(value).cast("double")
    data = df.withColumns({v: signed, h: F.md5(F.col(key).cast("string"))})
    edges = value_edges(data.where(F.col(v).isNotNull()), v, rows_per_bucket)
    order = [F.asc_nulls_last(v), h, key]
    if not edges:
        whole = W.partitionBy(F.lit(0)).orderBy(*order)
        return data.withColumn(out, F.row_number().over(whole).cast("bigint")).drop(v, h)
    # A value shared by many rows is itself an edge: the first value of its bucket. It and
    # the missing values get buckets of their own, cut by the leading digits of the hash.
    missing = F.col(v).isNull()
    shared = F.col(v).isin(edges) | missing
    data = with_bucket(data, v, edges, b)
    most = data.where(shared).groupBy(v).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()
    digits = max(1, hash_digits(most[0] or 0, rows_per_bucket))
    data = data.withColumns(
        {
            b: F.when(missing, F.lit(float(len(edges) + 2))).otherwise(F.col(b)),
            s: F.when(shared, F.concat(F.lit("0"), F.substring(h, 1, digits))).otherwise("1"),
        }
    )
    sizes = data.groupBy(b, s).agg(F.count(F.lit(1)).alias("__cnt"))
    before = W.partitionBy(F.lit(0)).orderBy(b, s).rowsBetween(W.unboundedPreceding, -1)
    sizes = materialise(
        sizes.select(b, s, F.coalesce(F.sum("__cnt").over(before), F.lit(0)).alias("__offset"))
    )
    inside = F.row_number().over(W.partitionBy(b, s).orderBy(*order))
    return (
        lookup_join(data, sizes, [b, s])
        .withColumn(out, F.col("__offset") + inside)
        .drop(v, h, b, s, "__offset")
    )
