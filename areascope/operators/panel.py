"""Panels: units observed over years."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions.vectors import complete_vector


def drop_incomplete(df: DataFrame, vector: str) -> DataFrame:
    """Drop rows whose vector has a null or NaN element."""
    return df.where(complete_vector(F.col(vector)))


def complete_units(df: DataFrame, unit: str, year: str) -> DataFrame:
    """Units observed in every year the panel has."""
    years = df.agg(F.count_distinct(year).alias("__years"))
    per_unit = (
        df.select(unit, year).distinct().groupBy(unit).agg(F.count(F.lit(1)).alias("__seen"))
    )
    return per_unit.crossJoin(F.broadcast(years)).where("__seen = __years").select(unit)


def complete_panel(df: DataFrame, unit: str, year: str) -> DataFrame:
    """Rows of the units observed in every year."""
    return df.join(complete_units(df, unit, year), unit, "left_semi")


def trajectory_ends(df: DataFrame, unit: str, year: str, values: list[str]) -> DataFrame:
    """First and last year of each unit with the values there.

    min_by/max_by combine on the map side, so a unit with very many rows stays cheap.
    """
    aggs = [F.min(year).alias("first_year"), F.max(year).alias("last_year")]
    for v in values:
        aggs += [
            F.min_by(v, year).alias(f"first_{v}"), F.max_by(v, year).alias(f"last_{v}")
        ]
    return df.groupBy(unit).agg(*aggs)


def trajectories(df: DataFrame, unit: str, year: str) -> DataFrame:
    """All rows by unit and year, the first and the last of each unit marked."""
    ends = df.groupBy(unit).agg(F.min(year).alias("__first"), F.max(year).alias("__last"))
    return (
        df.join(ends, unit)
        .withColumn("is_first", F.col(year) == F.col("__first"))
        .withColumn("is_last", F.col(year) == F.col("__last"))
        .drop("__first", "__last")
        .orderBy(unit, year)
    )


def lagged_change(
    df: DataFrame, unit: str, year: str, vector: str, values: list[str], lag: int = 1
) -> DataFrame:
    """(unit, year, vector, values...): each less the unit's own `lag` years before.

    A year whose earlier one is not there has no change: a gap is not bridged. Rows meet by unit and
    year, so a unit with many years is spread over tasks. A missing element or value, or one that was
    missing, has a missing change. Units and years have one row each.
    """
    before = df.select(
        unit, (F.col(year) + lag).alias(year), F.col(vector).alias("__v"),
        *[F.col(c).alias(f"__{i}") for i, c in enumerate(values)],
    )
    change = F.when(
        F.size(vector) == F.size("__v"), F.zip_with(vector, "__v", lambda now, was: now - was)
    )
    return df.select(unit, year, vector, *values).join(before, [unit, year]).select(
        unit, year, change.alias(vector),
        *[(F.col(c) - F.col(f"__{i}")).alias(c) for i, c in enumerate(values)],
    )
