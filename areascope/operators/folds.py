"""Splits that keep areas of one group together, and seeded row folds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.functions.ranking import hash_rank
from areascope.operators.joins import lookup_join
from areascope.operators.stats import sample_groups
from areascope.session import ROWS_PER_BUCKET, materialise

MAX_GROUPS = 10_000
LISTED_GROUPS = 1_000


def group_folds(
    df: DataFrame, group: str, k: int = 5, max_groups: int = MAX_GROUPS
) -> DataFrame:
    """(group, fold): groups from largest to smallest, each put in the lightest fold so far.

    Of equal groups the one with the larger name comes first; rows are only counted.
    """
    sizes = materialise(df.groupBy(group).agg(F.count(F.lit(1)).alias("size")))
    return place_groups(sizes, group, k, df, max_groups=max_groups)


def place_groups(
    sizes: DataFrame, group: str, k: int, df: DataFrame, keys: list[str] | None = None,
    max_groups: int = MAX_GROUPS, rows_per_part: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Folds of groups by (keys..., group, size), laid for each key on its own.

    Up to `max_groups` groups a key are one list; more are placed by size, with equal folds.
    """
    by = sizes.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"))
    if (by.agg(F.max("n")).first()[0] or 0) <= max_groups:
        return group_folds_of(sizes, group, k, df, keys)
    return folds_by_size(sizes, group, k, list(keys or []), rows_per_part)


def fold_turns(loads: list[int], size: int, count: int) -> tuple[list[int], list[list[int]]]:
    """Which folds take `count` groups of one size in turn; adds them to `loads`.

    The lightest fold takes groups until it draws level with the next, then both take turns, and
    so on: group j from 0 goes to folds[i][(j - first[i]) % len(folds[i])] of the last first[i] <= j.
    """
    low = min(loads)
    order = sorted(range(len(loads)), key=lambda f: ((loads[f] - low) % size, f))
    level = [(load - low) // size for load in loads]
    first, folds = [], []
    for t in sorted(set(level)):
        start = sum(max(0, t - q) for q in level)
        if start >= count:
            break
        first.append(start)
        folds.append([f for f in order if level[f] <= t])
    for i, active in enumerate(folds):
        n = (first[i + 1] if i + 1 < len(first) else count) - first[i]
        for place, f in enumerate(active):
            loads[f] += (n - place + len(active) - 1) // len(active) * size
    return first, folds


def folds_by_size(
    sizes: DataFrame, group: str, k: int, keys: list[str], rows_per_part: int = ROWS_PER_BUCKET
) -> DataFrame:
    """The folds of `group_folds_of` for any number of groups.

    Groups of one size are only counted for the walk, which holds k loads; there are at most
    sqrt(2 * rows) sizes. A group's place among its equals comes from ranges of (size, name) of
    about `rows_per_part` groups and the counts before them.
    """
    n = sizes.count()
    desc = [F.col("size").desc(), F.col(group).desc()]
    ranges = sizes.repartitionByRange(max(1, -(-n // rows_per_part)), *keys, *desc)
    ranges = materialise(ranges.withColumn("__part", F.spark_partition_id()))
    equals = [*keys, "size"]
    counts = ranges.groupBy(*equals, "__part").agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    earlier = W.partitionBy(*equals).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    before = counts.select(*equals, "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__j"))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, loads = None, [0] * k
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                if row[:-2] != key:
                    key, loads = row[:-2], [0] * k
                found.append((*row[:-1], *fold_turns(loads, int(row[-2]), int(row[-1]))))
            yield pd.DataFrame(found, columns=[*batch.columns[:-1], "first", "folds"])

    histogram = counts.groupBy(*equals).agg(F.sum("n").alias("n"))
    histogram = histogram.repartition(*keys) if keys else histogram.repartition(1)
    schema = T.StructType(
        [
            *[histogram.schema[c] for c in equals],
            T.StructField("first", T.ArrayType(T.LongType())),
            T.StructField("folds", T.ArrayType(T.ArrayType(T.IntegerType()))),
        ]
    )
    turns = materialise(
        histogram.sortWithinPartitions(*keys, F.col("size").desc()).mapInPandas(walk, schema)
    )
    placed = lookup_join(ranges, before, [*equals, "__part"], "inner")
    inside = F.row_number().over(W.partitionBy(*equals, "__part").orderBy(F.col(group).desc()))
    placed = placed.withColumn("__j", F.col("__j") + inside - 1)
    placed = lookup_join(placed, turns, equals, "inner")
    at = F.size(F.filter("first", lambda x: x <= F.col("__j"))) - 1
    takers = F.get("folds", at)
    nth = F.pmod(F.col("__j") - F.get("first", at), F.size(takers)).cast("int")
    return placed.select(*keys, group, F.get(takers, nth).alias("fold"))


def group_folds_of(
    sizes: DataFrame, group: str, k: int, df: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """Folds of groups whose sizes fit one row (per key)."""
    kind = df.schema[group].dataType.simpleString()
    keys = list(keys or [])
    ranked = sizes.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("size", F.col(group).alias("g"))), asc=False).alias("s")
    )
    start = F.struct(
        F.array_repeat(F.lit(0).cast("bigint"), k).alias("loads"),
        F.array().cast(f"array<struct<g:{kind},fold:int>>").alias("done"),
    )

    def put(acc, item):
        fold = (F.array_position(acc["loads"], F.array_min(acc["loads"])) - 1).cast("int")
        loads = F.transform(
            acc["loads"], lambda load, i: F.when(i == fold, load + item["size"]).otherwise(load)
        )
        placed = F.struct(item["g"].alias("g"), fold.alias("fold"))
        return F.struct(loads.alias("loads"), F.array_append(acc["done"], placed).alias("done"))

    placed = ranked.select(*keys, F.explode(F.aggregate("s", start, put)["done"]).alias("d"))
    return placed.select(*keys, F.col("d.g").alias(group), "d.fold")


def with_group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    return lookup_join(df, group_folds(df, group, k), group, "inner")


def row_folds(
    df: DataFrame, key: str, k: int, seed: int, within: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Shuffled folds of equal size (per group): seeded rank modulo k."""
    ranked = hash_rank(df, key, seed, "__r", within, rows_per_bucket)
    return ranked.withColumn("fold", F.pmod(F.col("__r") - 1, F.lit(k)).cast("int")).drop("__r")


def holdout(df: DataFrame, group: str, frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Add `test`: true for the rows of the held-out share of groups.

    Few groups (states) become a literal list in the plan; many are joined.
    """
    k = max(1, round(frac * df.select(group).dropna().distinct().count()))
    held = sample_groups(df, group, seed, k=k)
    if k <= LISTED_GROUPS:
        names = [r[0] for r in held.collect()]
        return df.withColumn("test", F.coalesce(F.col(group).isin(names), F.lit(False)))
    held = held.withColumn("test", F.lit(True))
    joined = lookup_join(df, held, group, at_most=k)
    return joined.withColumn("test", F.coalesce("test", F.lit(False)))
