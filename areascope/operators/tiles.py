"""Tiles of 100 km in the grid of UTM zones, and vector maps stored as one byte per band.

A tile is named by zone, latitude band and square, such as 18TWL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.functions.vectors import mean_direction, unit
from areascope.operators.joins import lookup_join
from areascope.operators.raster import latlon_to_utm

# Fixed values of the grid: band letters from 80° south, column letters of three zones, row letters.
BANDS = "CDEFGHJKLMNPQRSTUVWX"
COLUMNS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
ROWS = "ABCDEFGHJKLMNPQRSTUV"
SIDE = 100_000.0

# Codes of one byte: -127 to 127, and this one for a missing element.
MISSING = -128


# --- names --------------------------------------------------------------------------------


def grid_zone(lat: Column, lon: Column) -> Column:
    """UTM zone of a place (longitude from -180 to below 180), with the wider zones of Norway and
    Svalbard."""
    plain = (F.floor((lon + 180.0) / 6.0) + 1).cast("int")
    norway = (lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12)
    svalbard = F.when(lon < 9, 31).when(lon < 21, 33).when(lon < 33, 35).otherwise(37)
    return (
        F.when(norway, 32).when((lat >= 72) & (lon >= 0) & (lon < 42), svalbard).otherwise(plain)
    )


def _letter(letters: str, place: Column) -> Column:
    return F.substring(F.lit(letters), (place + 1).cast("int"), F.lit(1))


def _turned(lon: Column) -> Column:
    """A longitude given as any angle, from -180 to below 180."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def _inside(lat: Column, lon: Column) -> Column:
    return (lat >= -80) & (lat <= 84) & lon.isNotNull() & ~F.isnan(lon)


def _square(lat: Column, x: Column, y: Column) -> dict[str, Column]:
    """Band of latitude, place of the square in its UTM system and whether that is the southern one."""
    return {
        "band": F.least(F.floor((lat + 80.0) / 8.0), F.lit(len(BANDS) - 1)),
        "col": F.floor(x / SIDE), "row": F.floor(y / SIDE), "south": lat < 0,
    }


def _named(zone: Column, band: Column, col: Column, row: Column, south: Column) -> dict[str, Column]:
    """Name, code of the UTM system and lower-left corner of a square."""
    name = F.concat(
        F.lpad(zone.cast("string"), 2, "0"), _letter(BANDS, band),
        _letter(COLUMNS, F.pmod(zone - 1, F.lit(3)) * 8 + col - 1),
        _letter(ROWS, F.pmod(row + F.when(zone % 2 == 0, 5).otherwise(0), F.lit(20))),
    )
    epsg = F.concat(
        F.lit("EPSG:"), (zone + F.when(south, 32700).otherwise(32600)).cast("string")
    )
    corner = row * SIDE + F.when(south, 1e7).otherwise(0.0)
    return {"tile": name, "epsg": epsg, "x": col * SIDE, "y": corner}


def tile_of(lat: Column, lon: Column) -> Column:
    """Struct (tile, epsg, x, y) of the tile a place lies in: name, code of its UTM system and
    lower-left corner there. Missing outside 80° south to 84° north and for missing coordinates.

    Longitudes may be given as any angle.
    """
    lon = _turned(lon)
    zone = grid_zone(lat, lon)
    square = _square(lat, *latlon_to_utm(lat, lon, zone))
    parts = [c.alias(name) for name, c in _named(zone, **square).items()]
    return F.when(_inside(lat, lon), F.struct(*parts))


# --- tiles of scenes ----------------------------------------------------------------------


def _lattice(low: Column, high: Column, step: float) -> Column:
    """Both ends and the multiples of `step` between them."""
    first, last = F.ceil(low / step), F.floor(high / step)
    inner = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.array_distinct(F.concat(F.array(low, high), F.transform(inner, lambda i: i * F.lit(step))))


def scene_tiles(scenes: DataFrame, key: str, step: float = 0.25) -> DataFrame:
    """(key, tile, epsg, x, y): the tiles each scene's box (west, south, east, north) holds a lattice
    point of, every tile once. The lattice has the box's edges and the multiples of `step` degrees, so
    a tile that reaches into the box by more than a step is found. A box with west > east goes over
    the date line; a box with a missing side or south > north has no tiles.
    """
    east = F.when(F.col("west") > F.col("east"), F.col("east") + 360.0).otherwise(F.col("east"))
    whole = F.col("west").isNotNull() & F.col("east").isNotNull() & (F.col("south") <= F.col("north"))
    lattices = scenes.where(whole).select(
        key, _lattice(F.col("west"), east, step).alias("__lons"),
        _lattice(F.col("south"), F.col("north"), step).alias("__lats"),
    )
    points = lattices.select(key, "__lats", F.explode("__lons").alias("__lon"))
    points = points.select(key, F.explode("__lats").alias("__lat"), _turned(F.col("__lon")).alias("__lon"))
    lat, lon, zone = F.col("__lat"), F.col("__lon"), F.col("__zone")
    # every step is a column of its own, so that none is worked out again wherever the next one needs it
    points = points.where(_inside(lat, lon)).withColumn("__zone", grid_zone(lat, lon))
    x, y = latlon_to_utm(lat, lon, zone)
    points = points.select(key, "__lat", "__zone", x.alias("__x"), y.alias("__y"))
    square = _square(lat, F.col("__x"), F.col("__y"))
    found = points.select(key, "__zone", *[c.alias(f"__{n}") for n, c in square.items()]).distinct()
    names = _named(zone, **{n: F.col(f"__{n}") for n in square})
    return found.select(key, *[c.alias(n) for n, c in names.items()]).distinct()


def tile_list(scenes: DataFrame, key: str, step: float = 0.25) -> DataFrame:
    """Every tile the scenes reach, once: (tile, epsg, x, y, x2, y2, scenes), the square's corners
    and the number of scenes; a square cut by a border of bands is a tile on each side."""
    tiles = scene_tiles(scenes, key, step)
    counted = tiles.groupBy("tile", "epsg", "x", "y").agg(F.count(F.lit(1)).alias("scenes"))
    return counted.withColumns({"x2": F.col("x") + SIDE, "y2": F.col("y") + SIDE})


# --- one byte per band --------------------------------------------------------------------


def _finite(e: Column) -> Column:
    value = e.cast("double")
    return F.when(F.abs(value) < float("inf"), value)


def byte_scales(cells: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """(keys..., middle, scale): per raster and band the middle of its values and the width of a code,
    a 254th of their range. One aggregate with a number per band; missing and non-finite values are
    skipped. A band without values has middle and scale 0."""
    parts = [_finite(F.get(vector, F.lit(i))) for i in range(dims)]
    lows = [F.min(p).alias(f"__l{i}") for i, p in enumerate(parts)]
    highs = [F.max(p).alias(f"__h{i}") for i, p in enumerate(parts)]
    found = cells.groupBy(*keys).agg(*lows, *highs)
    # halves first, so the widest range does not overflow
    middle = [F.coalesce(F.col(f"__l{i}") / 2 + F.col(f"__h{i}") / 2, F.lit(0.0)) for i in range(dims)]
    scale = [F.coalesce(F.col(f"__h{i}") / 254 - F.col(f"__l{i}") / 254, F.lit(0.0)) for i in range(dims)]
    return found.select(*keys, F.array(*middle).alias("middle"), F.array(*scale).alias("scale"))


def to_bytes(cells: DataFrame, scales: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """Replace the vector by `codes`, a binary of one signed byte per band.

    Decoding gives a value within half a scale of the one encoded. Missing and non-finite elements
    (and a missing or short vector's) become the code -128.
    """
    def code(i: Column) -> Column:
        value, scale = _finite(F.get(vector, i)), F.get("scale", i)
        steps = F.coalesce(F.try_divide(value - F.get("middle", i), scale), value * 0)
        near = F.greatest(F.lit(-127), F.least(F.lit(127), F.floor(steps + 0.5))).cast("int")
        return F.when(value.isNull(), MISSING).otherwise(near)  # least and greatest skip missing values

    pairs = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.lpad(F.hex(F.pmod(code(i), F.lit(256))), 2, "0"),
    )
    scaled = lookup_join(cells, scales, keys, "inner")
    return scaled.withColumn("codes", F.unhex(F.array_join(pairs, ""))).drop(vector, "middle", "scale")


def from_bytes(coded: DataFrame, scales: DataFrame, keys: list[str], vector: str, dims: int) -> DataFrame:
    """Replace `codes` by the vector of doubles they stand for."""
    def value(i: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.col("codes"), i + 1, F.lit(1))), 16, 10).cast("int")
        signed = F.when(byte > 127, byte - 256).otherwise(byte)
        return F.when(signed != MISSING, F.get("middle", i) + signed * F.get("scale", i))

    scaled = lookup_join(coded, scales, keys, "inner")
    values = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), value)
    return scaled.withColumn(vector, values).drop("codes", "middle", "scale")


# --- overviews of vector maps -------------------------------------------------------------


def vector_overviews(
    cells: DataFrame, dims: int, levels: tuple[int, ...] = registry.OVERVIEW_LEVELS,
    keys: list[str] | None = None,
) -> DataFrame:
    """Mean directions of blocks at every level: (keys..., level, row, col, vector), at length one.

    Each level averages the map's own cells. Cells are placed once, by the coarsest block.
    """
    keys, top = list(keys or []), max(levels)
    block = [*keys, "__br", "__bc"]
    placed = cells.select(
        *keys, "row", "col", unit(F.col("vector")).alias("vector"),
        F.floor(F.col("row") / top).alias("__br"), F.floor(F.col("col") / top).alias("__bc"),
    ).repartition(*block)

    def one(level: int) -> DataFrame:
        part = placed.withColumns(
            {c: F.floor(F.col(c) / level).cast("int") for c in ("row", "col")}
        )
        pooled = mean_direction(part, [*block, "row", "col"], "vector", dims)
        return pooled.select(*keys, F.lit(level).alias("level"), "row", "col", "vector")

    return reduce(DataFrame.unionByName, [one(level) for level in levels])
