"""Column formulas used by the survey, raster and model operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from areascope.functions.registry import SEASON_MONTHS


def share(num: Column, den: Column) -> Column:
    """Percentage of a universe; a zero or missing universe gives null."""
    return F.try_divide(num, den) * F.lit(100.0)


def null_below(c: Column, floor: float = -99999.0) -> Column:
    """Suppression codes are large negative numbers: anything below the floor is missing."""
    return F.when(c >= F.lit(floor), c)


def sum_skipnull(cols: list[Column]) -> Column:
    """Row sum that counts missing parts as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(0.0)) for c in cols])


def sum_strict(cols: list[Column]) -> Column:
    """Row sum that is missing when any part is."""
    return reduce(lambda a, b: a + b, cols)


def complement(c: Column) -> Column:
    return F.lit(100.0) - c


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b where b is positive, else missing."""
    return F.when(b > 0, a / b)


def additional_var(r2_residual: Column, r2_index: Column) -> Column:
    """Share of all variance gained: residual R² times the part the index left unexplained."""
    zero = F.lit(0.0)
    return F.greatest(zero, r2_residual) * F.greatest(zero, F.lit(1.0) - r2_index)


def utm_epsg(west: Column, east: Column) -> Column:
    """EPSG code of the northern UTM zone at the middle longitude."""
    zone = F.floor(((west + east) / F.lit(2.0) + F.lit(180.0)) / F.lit(6.0)) + 1
    return F.concat(F.lit("EPSG:"), (zone + 32600).cast("string"))


def area_label(square_km: Column) -> Column:
    """`12 km²`, or hectares (`50 ha`) below one square kilometre."""
    return F.when(
        square_km >= 1, F.concat(F.bround(square_km, 0).cast("long").cast("string"), F.lit(" km²"))
    ).otherwise(
        F.concat(F.bround(square_km * 100, 0).cast("long").cast("string"), F.lit(" ha"))
    )


def season(ts: Column) -> Column:
    """Season name of a date; winter has none."""
    expr = F.lit(None).cast("string")
    for name, (first, last) in SEASON_MONTHS.items():
        expr = F.when(F.month(ts).between(first, last), F.lit(name)).otherwise(expr)
    return expr


def solar_day(ts: Column, longitude: Column) -> Column:
    """Local date by the sun: UTC shifted by one hour per 15 degrees of longitude."""
    seconds = (longitude * F.lit(240.0)).cast("long")
    return F.to_date(ts + F.make_dt_interval(secs=seconds))


def stat_name(prefix: str, band: Column, stat: Column, width: int = 2) -> Column:
    """Column name of one area statistic, such as OE07_MEAN."""
    return F.concat_ws(
        "_", F.concat(F.lit(prefix), F.lpad(band.cast("string"), width, "0")), stat
    )


def r2_from_sums(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 when hit exactly, else 0."""
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sst > 0, F.lit(1.0) - F.try_divide(sse, sst)).when(sst.isNotNull(), flat)


def edges_below(c: Column, edges: list[float]) -> Column:
    """Number of edges strictly below a value; null for a missing value.

    Plain comparisons stay in generated code, which array functions do not.
    """
    return reduce(lambda a, b: a + b, [(c > F.lit(float(e))).cast("int") for e in edges], F.lit(0))
