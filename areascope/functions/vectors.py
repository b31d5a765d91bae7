"""Array-of-double vectors: completeness, assembly, pooling and area-weighted means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_vector(v: Column) -> Column:
    """True when the vector is there and no element is null or NaN."""
    return v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))


def assemble(columns: list[str]) -> Column:
    """One array<double> from many numeric columns, missing values kept as null."""
    return F.expr("array(" + ", ".join(f"CAST(`{c}` AS DOUBLE)" for c in columns) + ")")


def double_array(values: list[float]) -> Column:
    """Literal array of finite doubles, as one expression."""
    return F.expr("array(" + ", ".join(f"{float(v)!r}D" for v in values) + ")")


def spread(v: str, names: list[str]) -> list[Column]:
    """One column per vector element, for wide sinks."""
    return [F.get(F.col(v), F.lit(i)).alias(name) for i, name in enumerate(names)]


def weighted_mean(
    df: DataFrame, key: str | list[str], vector: str, weight: str, dims: int,
    total: str = "total_area", carry: list[str] | None = None,
) -> DataFrame:
    """Weighted mean vector per key, Σ(v·w)/Σw, with the total weight.

    One plain sum per dimension keeps it a hash aggregate with map-side partial sums: what is
    shuffled is one row per key and map task, however many rows a key holds. A zero total
    weight gives null elements.
    """
    keys = [key] if isinstance(key, str) else list(key)
    w = f"CAST(`{weight}` AS DOUBLE)"
    sums = [F.expr(f"sum(get(`{vector}`, {i}) * {w}) AS __s{i}") for i in range(dims)]
    extra = [F.any_value(c).alias(c) for c in carry or []]
    grouped = df.groupBy(*keys).agg(F.expr(f"sum({w}) AS `{total}`"), *extra, *sums)
    parts = ", ".join(f"try_divide(__s{i}, `{total}`)" for i in range(dims))
    return grouped.select(
        *keys, F.expr(f"array({parts})").alias(vector), total, *(carry or [])
    )


def mean_pool(df: DataFrame, key: str | list[str], vector: str, dims: int) -> DataFrame:
    """Plain mean vector per key (over time steps or band sets), missing elements skipped."""
    keys = [key] if isinstance(key, str) else list(key)
    means = [
        F.expr(f"avg(CAST(get(`{vector}`, {i}) AS DOUBLE)) AS __s{i}") for i in range(dims)
    ]
    grouped = df.groupBy(*keys).agg(*means)
    parts = ", ".join(f"__s{i}" for i in range(dims))
    return grouped.select(*keys, F.expr(f"array({parts})").alias(vector))


def vector_rows(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Long form: one row per key and dimension (pos from 0)."""
    return df.select(*keys, F.posexplode(vector).alias("pos", "value"))


def unit(v: Column) -> Column:
    """The vector at length one; missing for a vector with a missing element or of length zero
    (or so near to it that only rounding is left)."""
    doubles = v.cast("array<double>")
    length = F.sqrt(F.aggregate(doubles, F.lit(0.0), lambda s, e: s + e * e))
    good = complete_vector(doubles) & (length > 1e-9) & (length < float("inf"))
    return F.when(good, F.transform(doubles, lambda e: e / length))


def mean_direction(df: DataFrame, key: str | list[str], vector: str, dims: int) -> DataFrame:
    """Mean of the vectors' directions per key, at length one again.

    Vectors without a direction (see unit) are skipped; a key without any, or whose directions
    cancel each other, has a missing vector.
    """
    pooled = mean_pool(df.withColumn(vector, unit(F.col(vector))), key, vector, dims)
    return pooled.withColumn(vector, unit(F.col(vector)))
