"""Pixel tables: masking, daily mosaics, median composites, overviews, chips and maps.

A raster is a long table (row, col, band, value); its transform (a, c, e, f: pixel width, left,
pixel height, top) travels as columns or parameters.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.functions import registry
from areascope.operators.joins import lookup_join
from areascope.session import by_key

PIXEL = ["row", "col", "band"]


# --- masking and compositing --------------------------------------------------------------


def mask_classes(
    df: DataFrame, value: str = "value", scl: str = "scl", exclude_snow: bool = False
) -> DataFrame:
    """Null the value where the scene class hides the ground."""
    hidden = list(registry.CLOUDY_CLASSES) + ([registry.SNOW_CLASS] if exclude_snow else [])
    clear = F.coalesce(~F.col(scl).isin(hidden), F.lit(True))
    return df.withColumn(value, F.when(clear, F.col(value)))


def mosaic_day(
    obs: DataFrame, day: str, order: list[str], value: str = "value", scl: str = "scl",
    keys: list[str] | None = None,
) -> DataFrame:
    """One observation per pixel, band and day: the earliest one that has a value.

    The class band is merged the same way, before any masking, so a cloudy first scene hides
    a clear second one. min_by keeps one row per group on the map side.
    """
    keys = keys or PIXEL

    def first(c: str) -> Column:
        when = F.when(F.col(c).isNotNull(), F.struct(*order))
        return F.min_by(c, when).alias(c)

    return obs.groupBy(*keys, day).agg(first(value), first(scl))


def median_composite(
    daily: DataFrame, value: str = "value", keys: list[str] | None = None
) -> DataFrame:
    """Median over days per pixel and band, hidden days skipped; no clear day gives null.

    A group has at most one row per day of the period (see mosaic_day), so it fits any task.
    """
    keys = keys or PIXEL
    return daily.groupBy(*keys).agg(
        F.median(value).alias(value), F.count(value).alias("n_clear")
    )


def composite(
    obs: DataFrame, day: str, order: list[str], exclude_snow: bool = False,
    mask_first: bool = False, keys: list[str] | None = None,
) -> DataFrame:
    """Daily mosaic, mask, median: the cloud-free composite of one period."""
    if mask_first:
        obs = mask_classes(obs, exclude_snow=exclude_snow)
    daily = mosaic_day(obs, day, order, keys=keys)
    if not mask_first:
        daily = mask_classes(daily, exclude_snow=exclude_snow)
    return median_composite(daily, keys=keys)


def standardise(df: DataFrame, stats: DataFrame, value: str = "value") -> DataFrame:
    """(value - mean) / std of the band; `stats` is (band, mean, std)."""
    return (
        lookup_join(df, stats, "band", "inner")
        .withColumn(value, (F.col(value) - F.col("mean")) / F.col("std"))
        .drop("mean", "std")
    )


def band_stats(df: DataFrame) -> DataFrame:
    """The published band constants as a table, in the session of `df`."""
    rows = [(b, m, s) for b, (m, s) in registry.BAND_STATS.items()]
    return df.sparkSession.createDataFrame(rows, "band string, mean double, std double")


def overviews(
    pixels: DataFrame, levels: tuple[int, ...] = registry.OVERVIEW_LEVELS, value: str = "value",
    keys: list[str] | None = None,
) -> DataFrame:
    """Block averages at every level: (keys..., level, row, col, band, value); `keys` name the raster.

    Pixels are placed once, by the coarsest block (at most 32 x 32 of them); every level's
    grouping contains that block, so all levels are computed where the pixels already are.
    """
    top = max(levels)
    keys = list(keys or [])
    block = [*keys, "__br", "__bc", "band"]
    placed = (
        pixels.select(
            *keys, "row", "col", "band", F.col(value).cast("double").alias(value),
            F.floor(F.col("row") / top).alias("__br"), F.floor(F.col("col") / top).alias("__bc"),
        )
        .repartition(*block)
    )
    out = None
    for level in levels:
        part = (
            placed.groupBy(
                *block,
                F.floor(F.col("row") / level).cast("int").alias("__r"),
                F.floor(F.col("col") / level).cast("int").alias("__c"),
            )
            .agg(F.avg(value).alias(value))
            .select(
                *keys, F.lit(level).alias("level"), F.col("__r").alias("row"),
                F.col("__c").alias("col"), "band", value,
            )
        )
        out = part if out is None else out.unionByName(part)
    return out


# --- coordinates --------------------------------------------------------------------------


def scale_transform(df: DataFrame, stride: int) -> DataFrame:
    """Transform of a map with one cell per `stride` pixels."""
    return df.withColumns({"a": F.col("a") * stride, "e": F.col("e") * stride})


def chip_center(
    df: DataFrame, px: int, row: str = "row_off", col: str = "col_off"
) -> DataFrame:
    """Centre of a chip (or of a pixel, px=1) in map units: columns x and y."""
    half = F.lit(px / 2.0)
    return df.withColumns(
        {
            "x": F.col("c") + (F.col(col) + half) * F.col("a"),
            "y": F.col("f") + (F.col(row) + half) * F.col("e"),
        }
    )


# WGS84 ellipsoid and the third-order series of the transverse Mercator projection.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * 0.9996
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15
)


def utm_to_latlon(df: DataFrame, zone: Column, x: str = "x", y: str = "y") -> DataFrame:
    """Latitude and longitude (degrees) of northern UTM coordinates, as column arithmetic."""
    xi = F.col(y) / _RADIUS
    eta = (F.col(x) - 500000.0) / _RADIUS
    xi2, eta2 = xi, eta
    for j, b in enumerate(_BETA, 1):
        xi2 = xi2 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta2 = eta2 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    lat = chi
    for j, d in enumerate(_DELTA, 1):
        lat = lat + d * F.sin(2 * j * chi)
    lon = F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))) + (zone * 6 - 183)
    return df.withColumns({"lat": F.degrees(lat), "lon": lon})


def latlon_to_utm(lat: Column, lon: Column, zone: Column) -> tuple[Column, Column]:
    """UTM coordinates (x, y) of degrees, as column arithmetic; y is negative south of the equator."""
    k = 2 * math.sqrt(_N) / (1 + _N)
    sine, turn = F.sin(F.radians(lat)), F.radians(lon - (zone * 6 - 183))
    t = F.sinh(F.atanh(sine) - F.lit(k) * F.atanh(F.lit(k) * sine))
    xi, eta = F.atan2(t, F.cos(turn)), F.atanh(F.sin(turn) / F.sqrt(t * t + 1.0))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + F.lit(a) * F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j))
        y = y + F.lit(a) * F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j))
    return x * _RADIUS + 500000.0, y * _RADIUS


# --- chips --------------------------------------------------------------------------------


def chip_index(pixels: DataFrame, px: int) -> DataFrame:
    """Offsets of the chip a pixel falls in and its place inside the chip."""
    return pixels.withColumns(
        {
            "row_off": (F.col("row") - F.pmod("row", F.lit(px))).cast("int"),
            "col_off": (F.col("col") - F.pmod("col", F.lit(px))).cast("int"),
            "place": (F.pmod("row", F.lit(px)) * px + F.pmod("col", F.lit(px))).cast("int"),
        }
    )


def chip_grid(rasters: DataFrame, px: int, height: int, width: int) -> DataFrame:
    """Every chip offset of each raster (a row each): columns row_off and col_off."""

    def offsets(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(max(int(n) - 1, 0)), F.lit(px)))

    return rasters.withColumn("row_off", offsets(height)).withColumn("col_off", offsets(width))


def to_chips(
    pixels: DataFrame, px: int, bands: list[str], height: int, width: int, pad: float = 0.0,
    value: str = "value", keys: list[str] | None = None,
) -> DataFrame:
    """Non-overlapping chips (keys..., row_off, col_off, data), data = bands x px x px, row-major.

    The grid is dense: a chip without any pixel is there, too. Places beyond the raster's edge
    hold `pad`; places inside it without a pixel hold NaN. Pixels are unique per (keys, row, col,
    band), as every composite is, so a chip group has at most bands x px x px rows; two pixels at
    one place are an error. `keys` (raster, year, season) cuts several rasters in one pass.
    """
    bands, keys = list(bands), list(keys or [])
    number = F.array_position(F.array(*[F.lit(b) for b in bands]), F.col("band")) - 1
    placed = chip_index(pixels.where(F.col("band").isin(bands)), px).select(
        *keys, "row_off", "col_off",
        (number * px * px + F.col("place")).cast("int").alias("place"),
        F.col(value).cast("float").alias("v"),
    )
    depth, names = len(bands), [*keys, "row_off", "col_off"]
    schema = T.StructType(
        [placed.schema[n] for n in names] + [T.StructField("data", T.ArrayType(T.FloatType()))]
    )

    rasters = pixels.select(*keys).distinct() if keys else pixels.sparkSession.range(1).select()
    empty = chip_grid(rasters, px, height, width).select(
        *names, F.lit(-1).alias("place"), F.lit(None).cast("float").alias("v")
    )

    def fill(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        row_off, col_off = key[-2:]
        group = group[group["place"] >= 0]
        if group["place"].duplicated().any():
            raise ValueError(f"two pixels at one place of chip {key}")
        data = np.full((depth, px, px), np.float32(pad), dtype="float32")
        data[:, : max(0, height - row_off), : max(0, width - col_off)] = np.nan
        flat = data.reshape(-1)
        flat[group["place"].to_numpy()] = group["v"].to_numpy(dtype="float32")
        return pd.DataFrame({**dict(zip(names, ([k] for k in key), strict=True)), "data": [flat]})

    return by_key(placed.unionByName(empty), names).groupBy(*names).applyInPandas(fill, schema)


def stack_seasons(
    chips: DataFrame, order: list[str], keys: list[str] | None = None
) -> DataFrame:
    """One chip per raster (`keys`) and place with its seasons one after the other; a season that
    is missing there holds NaN."""
    place = [*(keys or []), "row_off", "col_off"]
    parts = [
        F.any_value(F.when(F.col("season") == s, F.col("data")), ignoreNulls=True).alias(f"__{s}")
        for s in order
    ]
    joined = chips.where(F.col("season").isin(order)).groupBy(*place).agg(*parts)
    seen = F.coalesce(*[F.col(f"__{s}") for s in order])
    nothing = F.transform(seen, lambda _: F.lit(float("nan")).cast("float"))
    whole = [F.coalesce(F.col(f"__{s}"), nothing) for s in order]
    return joined.select(*place, F.concat(*whole).alias("data"))


def chip_count(height: int, width: int, px: int) -> int:
    return math.ceil(height / px) * math.ceil(width / px)


def first_chips(chips: DataFrame, n: int) -> DataFrame:
    """The first n chips in reading order (a trial run)."""
    return chips.orderBy("row_off", "col_off").limit(n)


def from_chips(
    encoded: DataFrame, stride: int, height: int, width: int, keys: list[str] | None = None
) -> DataFrame:
    """Patch vectors back to maps (keys..., row, col, vector), cells beyond the raster trimmed.

    `encoded` has (row_off, col_off, grid, patches): grid x grid vectors, row-major.
    """
    keys = list(keys or [])
    cells = encoded.select(
        *keys, "row_off", "col_off", "grid", F.posexplode("patches").alias("pos", "vector")
    ).select(
        *keys,
        (F.floor(F.col("row_off") / stride) + F.floor(F.col("pos") / F.col("grid")))
        .cast("int").alias("row"),
        (F.floor(F.col("col_off") / stride) + F.pmod("pos", "grid")).cast("int").alias("col"),
        "vector",
    )
    return cells.where(
        (F.col("row") < math.ceil(height / stride)) & (F.col("col") < math.ceil(width / stride))
    )
