"""Joins on area keys, with the broadcast and skew decisions made in one place."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.session import BROADCAST_ROWS, materialise

# A key is heavy when it holds more rows than one task should get; its rows are cut into as
# many parts as that takes. There are at most rows / ROWS_PER_TASK heavy keys.
ROWS_PER_TASK = 1_000_000


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """True when the frame has at most `rows` rows. A count adds up on the map side; a limit
    before it would send that many rows of every partition to one task."""
    return df.count() <= rows


def lookup_join(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "left",
    rows: int = BROADCAST_ROWS, at_most: int | None = None, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Join rows to a lookup table, which never adds rows of its own.

    A small table is broadcast, so the large side does not move; `at_most` is its known
    largest size, else it is counted. A larger one is shuffled with heavy keys salted: the
    lookup row of a heavy key is repeated once per salt.
    """
    keys = [on] if isinstance(on, str) else list(on)
    if how in ("right", "full", "outer", "right_outer", "full_outer"):
        raise ValueError(f"a lookup keeps the rows of its left side: {how}")
    if at_most <= rows if at_most is not None else is_small(right, rows):
        return left.join(F.broadcast(right), keys, how)
    return salted_join(left, right, keys, how, rows_per_task)


def heavy_keys(df: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(keys..., __salts) of keys with more than `rows_per_task` rows, in as many parts."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    parts = F.ceil(F.col("__n") / F.lit(rows_per_task)).cast("int")
    return counts.where(F.col("__n") > rows_per_task).select(*keys, parts.alias("__salts"))


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Shuffle join that cuts the left rows of heavy keys, and of missing keys, into parts.

    The left side and the heavy keys are written first: the parts of a row then follow from its
    place in a fixed copy, so rows that are equal in all columns are spread as well, and a task
    that runs again finds them where they were.
    """
    if how not in ("inner", "left", "leftouter", "left_outer", "left_semi", "left_anti"):
        raise ValueError(f"a salted join can't keep all rows of the repeated side: {how}")
    left = materialise(left)
    heavy = materialise(heavy_keys(left, keys, rows_per_task))
    n, most = heavy.agg(F.count(F.lit(1)), F.max("__salts")).first()
    if n <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    any_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    salts = F.coalesce("__salts", F.when(any_null, F.lit(most or 64)), F.lit(1))
    row = F.xxhash64(F.monotonically_increasing_id())
    spread = (
        left.withColumn("__row", row)
        .join(heavy, keys, "left")
        .withColumn("__salt", F.pmod("__row", salts).cast("int"))
        .drop("__salts", "__row")
    )
    repeated = (
        right.join(heavy, keys, "left")
        .withColumn(
            "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))
        )
        .drop("__salts")
    )
    return spread.join(repeated, [*keys, "__salt"], how).drop("__salt")


def keys_minus(a: DataFrame, b: DataFrame, key: str | list[str]) -> DataFrame:
    """Keys of `a` that `b` does not have."""
    keys = [key] if isinstance(key, str) else list(key)
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti")


def keep_keys(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows whose key is in the computed set."""
    cols = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*cols).distinct(), cols, "left_semi")


def outer_assemble(
    frames: list[DataFrame], key: str, value_columns: list[list[str]]
) -> DataFrame:
    """Full outer join of any number of frames on one key, as one union and one aggregate.

    Each frame is unique on the key, so the first value of a column is its only value and
    one shuffle replaces a chain of joins.
    """
    every = list(dict.fromkeys(c for cols in value_columns for c in cols))
    parts = [
        frame.select(key, *cols) for frame, cols in zip(frames, value_columns, strict=True)
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.groupBy(key).agg(*[F.first(c, ignorenulls=True).alias(c) for c in every])


def cross_specs(outcomes: DataFrame, specs: DataFrame) -> DataFrame:
    """Every outcome with every predictor set. Both are short lists of names, checked here:
    the product is a work list, never data rows."""
    if not is_small(outcomes) or not is_small(specs, 1_000):
        raise ValueError("work lists of a sweep must be short")
    return outcomes.crossJoin(F.broadcast(specs))


def union_all(*frames: DataFrame) -> DataFrame:
    """Stack frames by column name; a column missing in one is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def available(columns: list[str], wanted: list[str]) -> list[str]:
    """The wanted columns the frame has, in the wanted order."""
    have = set(columns)
    return [c for c in wanted if c in have]


def join_null_safe(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner"
) -> DataFrame:
    """Join in which missing keys match each other, as groups with a missing key do."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    same = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.lit(True)
    )
    return left.join(renamed, same, how).drop(*[f"__r_{k}" for k in keys])
