"""Grid tiles, polygons in binary form, directions and one-byte vectors."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.functions.vectors import mean_direction
from areascope.operators import raster, tiles
from areascope.operators.spatial import pixels_in_areas
from areascope.sources.areas import align, parse_areas, read_areas, with_geometry

PLACES = [
    (40.7128, -74.0060, "18TWL", 32618), (37.7749, -122.4194, "10SEG", 32610),
    (51.5, -0.12, "30UXC", 32630), (48.8566, 2.3522, "31UDQ", 32631),
    (-33.8688, 151.2093, "56HLH", 32756), (59.91, 10.75, "32VNM", 32632), (60.39, 5.32, "32VKN", 32632),
]


def test_names_of_known_places(spark):
    df = spark.createDataFrame([p[:2] for p in PLACES], "lat double, lon double")
    got = df.select(tiles.tile_of(F.col("lat"), F.col("lon")).alias("t"), "lat").collect()
    want = {lat: (name, f"EPSG:{code}") for lat, _, name, code in PLACES}
    assert {r.lat: (r.t.tile, r.t.epsg) for r in got} == want
    # any turn of the earth is the same place; poles and holes have none
    df = spark.createDataFrame(
        [(40.7128, -74.006 + 360), (89.0, 0.0), (None, 0.0), (0.0, None), (0.0, float("nan")), (float("nan"), 0.0)],
        "lat double, lon double",
    )
    names = [r.t and r.t.tile for r in df.select(tiles.tile_of(F.col("lat"), F.col("lon")).alias("t")).collect()]
    assert names == ["18TWL", None, None, None, None, None]


def test_projection_and_its_inverse(spark):
    df = spark.range(200).select(
        (F.rand(3) * 80).alias("la"), (F.rand(4) * 6 - 75 - 3 + 3).alias("lo")
    )
    x, y = raster.latlon_to_utm(F.col("la"), F.col("lo"), F.lit(18))
    back = raster.utm_to_latlon(df.withColumns({"x": x, "y": y}), F.lit(18)).collect()
    for r in back:
        assert r.lat == pytest.approx(r.la, abs=1e-7) and r.lon == pytest.approx(r.lo, abs=1e-7)


BOX = "id string, west double, south double, east double, north double"


def test_tiles_of_boxes(spark):
    scenes = spark.createDataFrame(
        [
            ("border", -72.6, 41.2, -71.4, 41.9),  # from zone 18 into zone 19
            ("dates", 179.9, 10.0, -179.9, 10.1), ("point", -71.4, 41.8, -71.4, 41.8),
            ("holes", None, 0.0, 1.0, 1.0), ("turned", 0.0, 2.0, 1.0, 1.0), ("equator", 3.0, -0.1, 3.1, 0.1),
        ],
        BOX,
    )
    got = tiles.scene_tiles(scenes, "id", 0.1).collect()
    names = {}
    for r in got:
        names.setdefault(r.id, set()).add(r.tile)
    assert names["point"] == {"19TCG"}
    assert {n[:3] for n in names["border"]} == {"18T", "19T"} and "19TCG" in names["border"]
    assert {n[:3] for n in names["dates"]} == {"60P", "01P"}
    assert {n[2] for n in names["equator"]} == {"M", "N"}
    assert set(names) == {"point", "border", "dates", "equator"}
    assert len(got) == len({(r.id, r.tile) for r in got})
    listed = {r.tile: r for r in tiles.tile_list(scenes, "id", 0.1).collect()}
    assert listed["19TCG"].scenes == 2 and listed["19TCG"].x2 == 400_000
    for r in got:  # every corner names its own square
        lat_lon = spark.createDataFrame([(r.x + 5e4, r.y + 5e4)], "x double, y double")
        if r.epsg.startswith("EPSG:326"):
            place = raster.utm_to_latlon(lat_lon, F.lit(int(r.epsg[-2:]))).first()
            assert abs(place.lat) < 43
    assert tiles.tile_list(spark.createDataFrame([], BOX), "id").count() == 0


def wkb(parts, order="<", kind=6, width=2, flag=0):
    def polygon(rings, code):
        out = struct.pack(order + "BII", order == "<", code, len(rings))
        for ring in rings:
            out += struct.pack(order + "I", len(ring) + 1)
            for x, y in [*ring, ring[0]]:
                out += struct.pack(order + "d" * width, x, y, *([7.0] * (width - 2)))
        return out

    single = 3 + flag
    if kind == 3:
        return polygon(parts[0], single)
    return struct.pack(order + "BII", order == "<", 6 + flag, len(parts)) + b"".join(polygon(p, single) for p in parts)


SQUARE, HOLE = [(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]
FAR = [(20, 0), (22, 0), (21, 5)]


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("width, flag", [(2, 0), (3, 1000), (3, 0x80000000), (4, 3000), (4, 0xC0000000)])
def test_rings_of_binary_polygons(spark, order, width, flag):
    if flag > 0x7FFFFFFF and order == ">":
        flag = 2000 if width == 3 else 3000
    data = wkb([[SQUARE, HOLE], [FAR]], order, 6, width, flag)
    df = spark.createDataFrame([("a", data, 1), ("b", None, 2), ("c", b"", 3)], "GEOID string, geometry binary, rings int")
    got = {r.GEOID: [[(p.x, p.y) for p in ring] for ring in r.rings] for r in parse_areas(df).collect()}
    assert got == {"a": [SQUARE, HOLE, FAR], "b": [], "c": []}


def test_points_in_areas_of_a_file(spark, tmp_path):
    rows = [("a", wkb([[SQUARE, HOLE], [FAR]])), ("h", wkb([[HOLE]], kind=3)), ("none", None)]
    spark.createDataFrame(rows, "GEOID string, geometry binary").write.parquet(str(tmp_path / "areas"))
    areas = read_areas(spark, str(tmp_path / "areas"))
    points = spark.createDataFrame([(5.0, 5.0), (1.0, 1.0), (21.0, 1.0), (15.0, 1.0)], "x double, y double")
    met = {(r.x, r.y): r.GEOID for r in pixels_in_areas(points, areas, cell=3.0).collect()}
    assert met == {(5.0, 5.0): "h", (1.0, 1.0): "a", (21.0, 1.0): "a"}
    again = parse_areas(with_geometry(areas)).collect()
    assert {r.GEOID: r.rings for r in again} == {r.GEOID: r.rings for r in areas.collect()}


def test_align_to_a_raster(spark):
    ring = [(-75.0, 42.0), (-74.0, 42.0), (-74.0, 43.0)]
    df = spark.createDataFrame([("a", wkb([[ring]], kind=3))], "GEOID string, geometry binary")
    (corner, east, _), = align(parse_areas(df), 18).first().rings
    assert corner.x == pytest.approx(500000, abs=1e-6) and corner.y == pytest.approx(4649776.22, abs=0.01)
    assert east.x > 580000


def test_long_border(spark):
    n = 100_000
    turn = np.linspace(0, 2 * math.pi, n, endpoint=False)
    ring = list(zip((100 * np.cos(turn)).tolist(), (100 * np.sin(turn)).tolist()))
    df = spark.createDataFrame([("a", wkb([[ring]], kind=3))], "GEOID string, geometry binary")
    points = spark.range(400).select(
        (F.col("id") % 20 * 11.0 - 104).alias("x"), (F.floor(F.col("id") / 20) * 11.0 - 104).alias("y")
    )
    met = pixels_in_areas(points, parse_areas(df), cell=5.0).collect()
    want = sum(1 for i in range(20) for j in range(20) if math.hypot(i * 11 - 104, j * 11 - 104) < 100)
    assert len(met) == want


def test_wrong_geometry(spark):
    point = struct.pack("<BIdd", 1, 1, 0.0, 0.0)
    df = spark.createDataFrame([("a", point)], "GEOID string, geometry binary")
    with pytest.raises(Exception, match="polygon"):
        parse_areas(df).collect()


def test_bytes_round_trip(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 5)) * [1, 100, 1e-6, 0, 1]
    rows = [(int(i % 3), i, [float(v) for v in data[i]]) for i in range(300)]
    nan, inf = float("nan"), float("inf")
    rows += [(0, 300, [None, nan, inf, -inf, 1.0]), (1, 301, None), (1, 302, [1.0]), (7, 303, [nan] * 5)]
    df = spark.createDataFrame(rows, "tile int, i int, v array<double>")
    scales = tiles.byte_scales(df, ["tile"], "v", 5)
    coded = tiles.to_bytes(df, scales, ["tile"], "v", 5)
    assert all(len(r.codes) == 5 for r in coded.collect())
    width = {r.tile: r.scale for r in scales.collect()}
    back = {r.i: r for r in tiles.from_bytes(coded, scales, ["tile"], "v", 5).collect()}
    for tile, i, v in rows[:300]:
        for j in range(5):
            assert abs(back[i].v[j] - v[j]) <= width[tile][j] * 0.5000001 + 1e-300
    assert back[300].v[:4] == [None] * 4 and back[300].v[4] is not None
    assert back[301].v == [None] * 5 and back[302].v[1:] == [None] * 4 and back[303].v == [None] * 5


def test_directions(spark):
    rows = [("a", [3.0, 4.0]), ("a", [0.0, 2.0]), ("o", [1.0, 1.0]), ("o", [-2.0, -2.0]), ("z", [0.0, 0.0]), ("n", None),
            ("a", [float("nan"), 1.0])]
    got = {r.k: r.v for r in mean_direction(spark.createDataFrame(rows, "k string, v array<double>"), "k", "v", 2).collect()}
    want = np.array([0.6, 1.8]) / math.hypot(0.6, 1.8)
    assert np.allclose(got["a"], want) and got["o"] is got["z"] is got["n"] is None


def test_vector_overviews(spark):
    rng = np.random.default_rng(1)
    grid = rng.normal(size=(6, 5, 3))
    rows = [(r, c, [float(v) for v in grid[r, c]]) for r in range(6) for c in range(5)]
    df = spark.createDataFrame(rows, "row int, col int, vector array<double>")
    got = {(r.level, r.row, r.col): r.vector for r in tiles.vector_overviews(df, 3, (2, 4)).collect()}
    units = grid / np.linalg.norm(grid, axis=2, keepdims=True)
    for (level, r, c), v in got.items():
        mean = units[r * level:(r + 1) * level, c * level:(c + 1) * level].reshape(-1, 3).mean(axis=0)
        assert np.allclose(v, mean / np.linalg.norm(mean))
    assert len(got) == 9 + 4


def test_scene_tiles_project_each_point_once(spark):
    """The projection's steps are columns; inlined they would be worked out again for each use."""
    scenes = spark.createDataFrame([(1, -75.5, 40.0, -74.5, 41.0)], BOX)
    plan = tiles.scene_tiles(scenes, "id", 0.25)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.upper().count("ATANH(") < 60
