"""Polygons in well-known binary form, as geographic files hold them, to the rings the joins use."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.operators.raster import latlon_to_utm

RINGS = "array<array<struct<x:double,y:double>>>"

# Fixed values of the format: kinds of geometry and the flags for further coordinates.
POLYGON, MULTIPOLYGON = 3, 6
HAS_Z, HAS_M, HAS_SRID = 0x80000000, 0x40000000, 0x20000000


def _rings(data: bytes, at: int = 0) -> tuple[list[np.ndarray], int]:
    """Rings (n x 2) of a polygon or multipolygon that starts at `at`, and where it ends."""
    order = "<" if data[at] == 1 else ">"

    def number(place: int) -> int:
        return int(np.frombuffer(data, f"{order}u4", 1, place)[0])

    kind, at = number(at + 1), at + 5
    more = kind & (HAS_Z | HAS_M)
    if kind & HAS_SRID:
        at += 4
    kind &= 0x0FFFFFFF
    # further coordinates by flags, or by thousands: 1 and 2 add one, 3 adds two
    width = 2 + (1, 1, 2)[kind // 1000 - 1] if kind >= 1000 else 2 + more.bit_count()
    kind %= 1000
    if kind not in (POLYGON, MULTIPOLYGON):
        raise ValueError(f"an area is a polygon or a multipolygon, not geometry {kind}")
    found: list[np.ndarray] = []
    parts, at = number(at), at + 4
    for _ in range(parts):
        if kind == MULTIPOLYGON:
            inner, at = _rings(data, at)
            found += inner
            continue
        n, at = number(at), at + 4
        points = np.frombuffer(data, f"{order}f8", n * width, at).reshape(n, width)[:, :2]
        at += 8 * n * width
        if n > 1 and (points[0] == points[-1]).all():
            points = points[:-1]
        found.append(points.astype("float64"))
    return found, at


def parse_areas(df: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Replace a binary geometry column by `rings`.

    The rings of all parts follow each other: with the even-odd rule of the join, holes and parts
    need no mark. The closing point of a ring is left out. Both byte orders; further coordinates
    are skipped. A missing or empty geometry has no rings, and so meets no point.
    """
    rest = [f for f in df.schema.fields if f.name not in (geometry, "rings")]
    ring = T.ArrayType(T.ArrayType(T.DoubleType()))
    schema = T.StructType([*rest, T.StructField("xs", ring), T.StructField("ys", ring)])

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rings = [_rings(bytes(g))[0] if g else [] for g in frame[geometry]]
            out = frame[[f.name for f in rest]].copy()
            out["xs"] = [[r[:, 0] for r in one] for one in rings]
            out["ys"] = [[r[:, 1] for r in one] for one in rings]
            yield out

    parsed = df.select(*[F.col(f"`{f.name}`") for f in rest], geometry).mapInPandas(parse, schema)
    point = F.zip_with(
        "xs", "ys", lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    )
    return parsed.select(*[F.col(f"`{f.name}`") for f in rest], point.cast(RINGS).alias("rings"))


def align(areas: DataFrame, zone: Column | int) -> DataFrame:
    """Rings in degrees (x = longitude, y = latitude) to the UTM zone of a raster."""
    zone = F.lit(zone) if isinstance(zone, int) else zone

    def moved(p: Column) -> Column:
        x, y = latlon_to_utm(p["y"], p["x"], zone)
        return F.struct(x.alias("x"), y.alias("y"))

    return areas.withColumn("rings", F.transform("rings", lambda ring: F.transform(ring, moved)))


def read_areas(
    spark: SparkSession, path: str, key: str = "GEOID", geometry: str = "geometry",
    zone: Column | int | None = None,
) -> DataFrame:
    """(key, rings) of a parquet table with binary geometries, in the raster's system when `zone`
    names it (the table then holds degrees)."""
    areas = parse_areas(spark.read.parquet(path).select(key, geometry), geometry)
    return areas if zone is None else align(areas, zone)


def with_geometry(areas: DataFrame, geometry: str = "geometry") -> DataFrame:
    """Replace `rings` by a binary polygon (little-endian, rings closed); missing stays missing."""

    @F.pandas_udf("binary")
    def packed(rings: pd.Series) -> pd.Series:
        return rings.map(_pack, na_action="ignore")

    flat = F.transform("rings", lambda ring: F.flatten(F.transform(ring, lambda p: F.array(p["x"], p["y"]))))
    return areas.withColumn(geometry, packed(flat)).drop("rings")


def _pack(rings: np.ndarray) -> bytes:
    out = [b"\x01", np.array([POLYGON, len(rings)], "<u4").tobytes()]
    for ring in rings:
        points = np.asarray(ring, "<f8").reshape(-1, 2)
        closed = np.vstack([points, points[:1]])
        out += [np.array([len(closed)], "<u4").tobytes(), closed.tobytes()]
    return b"".join(out)
