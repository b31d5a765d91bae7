"""Area keys, lenient casts and dictionary lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.operators.joins import lookup_join


def to_double(c: Column) -> Column:
    """Text to number; text that is no number, and NaN, become null."""
    return nan_to_null(c.try_cast("double"))


def nan_to_null(c: Column) -> Column:
    """Spark aggregates do not skip NaN, so both kinds of missing become null at the source."""
    return F.when(~F.isnan(c), c)


def pad_geoid(c: Column, width: int = 11) -> Column:
    """Left-pad ids with zeros; longer ids stay whole (plain lpad would cut them)."""
    text = c.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def make_geoid(state: Column, county: Column, tract: Column) -> Column:
    return F.concat(state, county, tract)


def state_of(geoid: Column) -> Column:
    return F.substring(geoid, 1, 2)


def tract_of(block_group: Column) -> Column:
    return F.substring(block_group, 1, 11)


def map_default(
    df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_value: str, out: str,
    default: str = "Unknown",
) -> DataFrame:
    """Look `key` up in a dimension table; keys it lacks get `default`."""
    side = dim.select(F.col(dim_key).alias(key), F.col(dim_value).alias(out))
    return lookup_join(df, side, key).withColumn(out, F.coalesce(out, F.lit(default)))


def map_or_self(
    df: DataFrame, key: str, dim: DataFrame, dim_key: str, dim_value: str, out: str
) -> DataFrame:
    """Look `key` up; keys the dimension lacks are shown as they are."""
    side = dim.select(F.col(dim_key).alias(key), F.col(dim_value).alias(out))
    return lookup_join(df, side, key).withColumn(
        out, F.coalesce(F.col(out), F.col(key).cast("string"))
    )


def index_labels(
    df: DataFrame, variable: str, membership: DataFrame, out: str = "indices"
) -> DataFrame:
    """Names of the indices a variable belongs to, sorted and comma-joined; "" when in none.

    `membership` is long: (variable, index).
    """
    labels = membership.groupBy(F.col("variable").alias(variable)).agg(
        F.array_join(F.array_sort(F.collect_set("index")), ", ").alias(out)
    )
    return lookup_join(df, labels, variable).withColumn(out, F.coalesce(out, F.lit("")))


def in_registry(df: DataFrame, variable: str, registry: DataFrame) -> DataFrame:
    """Keep the rows whose variable the registry lists."""
    listed = registry.select(F.col("variable").alias(variable)).distinct()
    return df.join(listed, variable, "left_semi")
