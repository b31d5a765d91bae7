"""Survey preparation: names, sentinel codes, percentages, composites, year choice, pivots."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.functions.keys import pad_geoid
from areascope.functions.scalars import (
    complement,
    safe_ratio,
    share,
    sum_skipnull,
    sum_strict,
)
from areascope.operators.joins import lookup_join, union_all


def rename_map(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns the map lists; names the frame lacks are ignored."""
    return df.withColumnsRenamed(names)


def cols_like(df: DataFrame, prefix: str = "", suffix: str = "") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix) and c.endswith(suffix)]


def null_sentinels(df: DataFrame, columns: list[str], floor: float = -99999.0) -> DataFrame:
    """Missing-data codes to null in all the given columns, in one projection."""
    wanted = set(columns)
    return df.selectExpr(
        *[
            f"CASE WHEN `{c}` >= {floor}D THEN `{c}` END AS `{c}`" if c in wanted else f"`{c}`"
            for c in df.columns
        ]
    )


def to_percent(
    df: DataFrame, specs: list[tuple[str, str, str]], drop: list[str] | None = None
) -> DataFrame:
    """Counts as a percentage of their universe, where the frame has both; counts are dropped."""
    have = set(df.columns)
    usable = [s for s in specs if s[0] in have and s[1] in have]
    out = df.withColumns(
        {name: F.expr(f"try_divide(`{num}`, `{den}`) * 100D") for num, den, name in usable}
    )
    return out.drop(*[num for num, _, _ in usable], *(drop or []))


def to_percent_long(
    df: DataFrame, specs: DataFrame, keys: list[str], variable: str, value: str
) -> DataFrame:
    """The same on long rows (keys..., variable, value), one aggregate and no self-join.

    `specs` has (numerator, denominator, name). Each row is sent to the percentages it takes
    part in, so the number of survey variables does not widen the plan.
    """
    roles = specs.select(
        F.explode(
            F.array(
                F.struct(F.col("numerator").alias("var"), F.lit(True).alias("num"), "name"),
                F.struct(F.col("denominator").alias("var"), F.lit(False).alias("num"), "name"),
            )
        ).alias("r")
    ).select(F.col("r.var").alias(variable), "r.num", "r.name")
    per_variable = roles.groupBy(variable).agg(
        F.collect_list(F.struct("num", "name")).alias("roles")
    )
    sent = lookup_join(df, per_variable, variable, "inner").select(
        *keys, value, F.explode("roles").alias("role")
    )
    num = F.max(F.when(F.col("role.num"), F.col(value)))
    den = F.max(F.when(~F.col("role.num"), F.col(value)))
    return (
        sent.groupBy(*keys, F.col("role.name").alias(variable))
        .agg(num.alias("__num"), den.alias("__den"))
        .select(*keys, variable, share(F.col("__num"), F.col("__den")).alias(value))
    )


def composites(df: DataFrame) -> DataFrame:
    """Add the composite indicators whose parts the frame has."""
    have = df.columns
    made = {}
    for line in registry.lines(registry.COMPOSITES):
        head, parts = line.split(" = ")
        rule, name = head.split()
        cols = [c for part in parts.split() for c in have if fnmatch(c, part)]
        complete = len(cols) >= len(parts.split())
        if complete:
            made[name] = (sum_skipnull if rule == "any" else sum_strict)([F.col(c) for c in cols])
    if "nh_white_pct" in have:
        made["minority_pct"] = complement(F.col("nh_white_pct"))
    if {"hh_income_lt10k_pct", "hh_income_ge200k_pct"} <= set(have):
        made["income_disparity_ratio"] = safe_ratio(
            F.col("hh_income_lt10k_pct"), F.col("hh_income_ge200k_pct")
        )
    return df.withColumns(made)


def prepare_survey(raw: DataFrame, late_sentinels: bool = False) -> DataFrame:
    """Raw survey table (GEOID, NAME, codes) to named percentages and composites by tract.

    Sentinel codes are removed before ratios are taken, so no percentage is built from one;
    `late_sentinels` removes them from the finished percentages instead.
    """
    df = raw.withColumn("tract_fips", pad_geoid(F.col("GEOID"))).drop("GEOID", "NAME")
    df = rename_map(df, registry.survey_names())
    numbers = [c for c in df.columns if c != "tract_fips"]
    if not late_sentinels:
        df = null_sentinels(df, numbers)
    df = to_percent(df, registry.share_specs(), registry.DROPPED_AFTER_SHARES.split())
    if late_sentinels:
        df = null_sentinels(df, [c for c in df.columns if c != "tract_fips"])
    return composites(df)


def prefer_year(
    df: DataFrame, measure: str, year: str, first: int = 2022, fallback: int = 2023
) -> DataFrame:
    """Rows of the first year for measures it has, of the fallback year for the others.

    The choice is made per measure, not per area: an area the first year lacks stays absent.
    """
    known = df.where(F.col(year) == first).select(measure).distinct()
    later = df.where(F.col(year) == fallback).select(measure).distinct()
    filled = later.join(known, measure, "left_anti")
    chosen = union_all(
        known.withColumn(year, F.lit(first)), filled.withColumn(year, F.lit(fallback))
    )
    wanted = df.where(F.col(year).isin(first, fallback)).withColumn(
        year, F.col(year).cast("int")
    )
    return lookup_join(wanted, chosen, [measure, year], "left_semi")


def pivot_unique(
    df: DataFrame, index: list[str], on: str, value: str, names: list[str]
) -> DataFrame:
    """Long to wide with one value per cell; a second row for a cell fails the query.

    The names are given, so no extra pass looks them up and the result has a fixed schema.
    """
    cell = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit("more than one row for a cell")))
    cell = cell.otherwise(F.first(value))
    return df.groupBy(*index).pivot(on, names).agg(cell)


def pivot_names(df: DataFrame, on: str, limit: int = 10_000) -> list[str]:
    """Sorted distinct names for a pivot; a list too long to be columns is refused."""
    rows = df.select(on).distinct().orderBy(on).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{on} has more than {limit} values: keep it long")
    return [r[0] for r in rows]


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Drop a row when any of its measures is missing."""
    return df.dropna("any", subset=columns)


def complete_cases_long(df: DataFrame, area: str, measure: str, value: str) -> DataFrame:
    """Complete cases without widening: areas that have every measure."""
    have = df.where(F.col(value).isNotNull())
    n = df.agg(F.count_distinct(measure).alias("__all"))
    full = (
        have.groupBy(area)
        .agg(F.count_distinct(measure).alias("__have"))
        .crossJoin(F.broadcast(n))
        .where("__have = __all")
        .select(area)
    )
    return have.join(full, area, "left_semi")


def latest(df: DataFrame, year: str) -> DataFrame:
    """Rows of the most recent year."""
    last = df.agg(F.max(year).alias("__last"))
    return df.crossJoin(F.broadcast(last)).where(F.col(year) == F.col("__last")).drop("__last")
