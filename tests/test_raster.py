"""Masks, composites, chips, maps, polygons and resumable encoding."""

import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.functions.vectors import complete_vector, mean_pool, weighted_mean
from areascope.operators import raster, spatial
from areascope.operators.encode import encode_chips, patch_means
from areascope.sources.tables import exists
from areascope.streaming.resume import encode_arrivals, encode_pending, finish


def test_mask_every_class(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(12)] + [(None, 1.0)], "scl int, value double")
    kept = {r.scl for r in raster.mask_classes(df).collect() if r.value is not None}
    assert kept == {2, 4, 5, 6, 7, 11, None}
    snow = {r.scl for r in raster.mask_classes(df, exclude_snow=True).collect() if r.value}
    assert 11 not in snow


def test_composite_orders_day_before_mask(spark):
    rows = [
        # same day: the first scene is cloudy, the second clear
        (0, 0, "red", "d1", 1, 10.0, 9), (0, 0, "red", "d1", 2, 20.0, 4),
        (0, 0, "red", "d2", 3, 30.0, 4), (0, 0, "red", "d3", 4, 50.0, 4),
        # first scene has no value: the second fills in
        (0, 1, "red", "d1", 1, None, None), (0, 1, "red", "d1", 2, 7.0, 5),
        # always cloudy
        (0, 2, "red", "d1", 1, 5.0, 8), (0, 2, "red", "d2", 2, 6.0, 3),
    ]
    obs = spark.createDataFrame(
        rows, "row int, col int, band string, day string, ts int, value double, scl int"
    )
    got = {r.col: (r.value, r.n_clear) for r in raster.composite(obs, "day", ["ts"]).collect()}
    assert got == {0: (40.0, 2), 1: (7.0, 1), 2: (None, 0)}
    first = {r.col: r.value for r in raster.composite(
        obs, "day", ["ts"], mask_first=True).collect()}
    assert first[0] == 30.0


def full_raster(spark, h, w, bands, seed=0):
    rng = np.random.default_rng(seed)
    data = rng.random((len(bands), h, w)).astype("float32")
    rows = [
        (r, c, b, float(data[i, r, c]))
        for i, b in enumerate(bands) for r in range(h) for c in range(w)
    ]
    return data, spark.createDataFrame(rows, "row int, col int, band string, value float")


def test_chips_pad_and_map_trim(spark):
    h, w, px, patch = 26, 45, 16, 4
    data, pixels = full_raster(spark, h, w, ["a", "b"])
    chips = raster.to_chips(pixels, px, ["a", "b"], h, w)
    assert chips.count() == raster.chip_count(h, w, px) == 6
    padded = np.zeros((2, 32, 48), dtype="float32")
    padded[:, :h, :w] = data
    for r in chips.collect():
        got = np.array(r.data).reshape(2, px, px)
        np.testing.assert_array_equal(
            got, padded[:, r.row_off:r.row_off + px, r.col_off:r.col_off + px]
        )
    cells = raster.from_chips(encode_chips(chips, patch_means(patch), 2, px), patch, h, w).collect()
    assert len(cells) == math.ceil(h / patch) * math.ceil(w / patch)
    means = padded.reshape(2, 8, patch, 12, patch).mean(axis=(2, 4))
    for r in cells:
        np.testing.assert_allclose(r.vector, means[:, r.row, r.col], rtol=1e-5)
    order = [(r.row_off, r.col_off) for r in raster.first_chips(chips, 4).collect()]
    assert order == [(0, 0), (0, 16), (0, 32), (16, 0)]


def test_missing_pixels_are_not_zero(spark):
    _, pixels = full_raster(spark, 8, 8, ["a"])
    chips = raster.to_chips(pixels.where("NOT (row < 4 AND col < 4)"), 8, ["a"], 8, 8)
    cells = raster.from_chips(encode_chips(chips, patch_means(4), 1, 8), 4, 8, 8)
    got = {(r.row, r.col): r.vector[0] for r in cells.collect()}
    assert math.isnan(got[(0, 0)]) and not math.isnan(got[(1, 1)])


def test_encoder_with_metadata(spark):
    chips = spark.createDataFrame(
        [(0, 0, [1.0, 1.0, 1.0, 1.0], 41.0), (0, 2, [2.0] * 4, 42.0)],
        "row_off int, col_off int, data array<float>, lat double",
    )

    def load():
        def encode(data, extra):
            lat = extra["lat"].to_numpy()[:, None, None, None]
            return data.mean(axis=(1, 2, 3)).reshape(-1, 1, 1, 1) + lat

        return encode

    got = encode_chips(chips, load, 1, 2, extra=["lat"]).collect()
    assert {r.col_off: r.patches for r in got} == {0: [[42.0]], 2: [[44.0]]}


def test_seasons_stack_in_order(spark):
    chips = spark.createDataFrame(
        [(0, 0, "fall", [3.0]), (0, 0, "spring", [1.0]), (0, 0, "summer", [2.0]), (0, 8, "fall", [9.0])],
        "row_off int, col_off int, season string, data array<float>",
    )
    got = raster.stack_seasons(chips, list(registry.SEASON_MONTHS)).collect()
    data = {r.col_off: r.data for r in got}
    assert data[0] == [1.0, 2.0, 3.0]
    assert np.isnan(data[8][:2]).all() and data[8][2] == 9.0


def test_rasters_keep_apart_and_whole(spark):
    pixels = spark.createDataFrame(
        [("p", 0, 0, "a", 1.0), ("q", 0, 0, "a", 3.0)], "raster string, row int, col int, band string, value double"
    )
    chips = raster.to_chips(pixels, 4, ["a"], 6, 8, keys=["raster"])
    assert chips.count() == 2 * raster.chip_count(6, 8, 4) == 8
    encoded = encode_chips(chips, patch_means(2), 1, 4, keys=["raster"])
    got = {(r.raster, r.row, r.col): r.vector[0] for r in raster.from_chips(encoded, 2, 6, 8, ["raster"]).collect()}
    assert len(got) == 2 * 3 * 4 and got["p", 0, 0] == 1.0 and got["q", 0, 0] == 3.0
    assert np.isnan(got["p", 2, 3])
    over = raster.overviews(pixels, (2,), keys=["raster"]).collect()
    assert {(r.raster, r.value) for r in over} == {("p", 1.0), ("q", 3.0)}
    with pytest.raises(Exception, match="two pixels at one place"):
        raster.to_chips(pixels, 4, ["a"], 6, 8).collect()


def test_standardise(spark):
    df = spark.createDataFrame([("blue", 1087.0 + 2248.0), ("swir22", 1363.0)], "band string, value double")
    got = {r.band: r.value for r in raster.standardise(df, raster.band_stats(df)).collect()}
    assert got == {"blue": 1.0, "swir22": 0.0}


def test_overviews_one_shuffle(spark):
    data, pixels = full_raster(spark, 40, 33, ["a"], 3)
    out = raster.overviews(pixels)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(row" not in plan  # only the block placement moves pixels
    got = {(r.level, r.row, r.col): r.value for r in out.collect()}
    for level in registry.OVERVIEW_LEVELS:
        for r in range(math.ceil(40 / level)):
            for c in range(math.ceil(33 / level)):
                block = data[0, r * level:(r + 1) * level, c * level:(c + 1) * level]
                assert got[(level, r, c)] == pytest.approx(float(block.mean()), rel=1e-5)


def test_coordinates(spark):
    df = spark.createDataFrame([(0, 128, 10.0, 300000.0, -10.0, 4600000.0)],
                               "row_off int, col_off int, a double, c double, e double, f double")
    r = raster.chip_center(df, 128).first()
    assert (r.x, r.y) == (300000.0 + 192 * 10, 4600000.0 - 640)
    assert raster.scale_transform(df, 8).first().a == 80.0
    # 42°N 71.5°W is zone 19: easting 292,977.1 / northing 4,652,999.1 from the forward series
    lat, lon = math.radians(42.0), math.radians(-71.5)
    x, y = forward_utm(lat, lon, 19)
    p = spark.createDataFrame([(x, y)], "x double, y double")
    got = raster.utm_to_latlon(p, F.lit(19)).first()
    assert got.lat == pytest.approx(42.0, abs=1e-8) and got.lon == pytest.approx(-71.5, abs=1e-8)


def forward_utm(lat, lon, zone):
    """Forward transverse Mercator by its published third-order series."""
    a, f = 6378137.0, 1 / 298.257223563
    n = f / (2 - f)
    big_a = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    d = lon - math.radians(zone * 6 - 183)
    k = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(lat)) - k * math.atanh(k * math.sin(lat)))
    xi = math.atan2(t, math.cos(d))
    eta = math.atanh(math.sin(d) / math.sqrt(1 + t * t))
    e = eta + sum(al * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, al in enumerate(alpha, 1))
    nn = xi + sum(al * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, al in enumerate(alpha, 1))
    return 500000 + 0.9996 * big_a * e, 0.9996 * big_a * nn


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


AREAS = "GEOID string, rings array<array<struct<x:double,y:double>>>"


@pytest.mark.parametrize("rows", [20_000, 0])
@pytest.mark.parametrize("cell", [0.7, 3.0, 50.0])
def test_polygons(spark, rows, cell):
    areas = spark.createDataFrame(
        [
            ("left", [ring((0, 0), (5, 0), (5, 10), (0, 10))]),
            ("right", [ring((5, 0), (10, 0), (10, 10), (5, 10)), ring((6, 4), (8, 4), (8, 6), (6, 6))]),
            ("slant", [ring((0, 12), (10, 12), (3, 18), (0, 12))]),
            ("empty", [ring((20.1, 20.1), (20.2, 20.1), (20.2, 20.2))]),
        ],
        AREAS,
    )
    grid = [(r, c, c * 0.5, r * 0.5) for r in range(44) for c in range(44)]
    pixels = spark.createDataFrame(grid, "row int, col int, x double, y double")
    got = spatial.pixels_in_areas(pixels, areas, "GEOID", cell, rows=rows)
    found = {(r.row, r.col): r.GEOID for r in got.collect()}
    assert got.count() == len(found)  # nobody is in two areas
    for r, c, x, y in grid:
        want = None
        if 0 <= x < 5 and 0 <= y < 10:
            want = "left"
        elif 5 <= x < 10 and 0 <= y < 10 and not (6 <= x < 8 and 4 <= y < 6):
            want = "right"
        elif y < 12 or y > 18:
            pass
        else:
            want = "slant" if in_triangle(x, y) else None
        assert found.get((r, c)) == want, (x, y)


def in_triangle(x, y):
    pts = [(0, 12), (10, 12), (3, 18)]
    inside = False
    for (x1, y1), (x2, y2) in zip(pts, pts[1:] + pts[:1], strict=True):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            inside = not inside
    return inside


@pytest.mark.parametrize("per_bucket", [10**6, 30])
def test_zonal_stats(spark, per_bucket):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for area, n in (("big", 400), ("one", 1), ("small", 9)):
        for band in ("0", "1"):
            values = rng.normal(size=n).round(3)
            want[(area, band)] = values
            rows += [(area, band, float(v)) for v in values]
    rows += [("big", "0", None), ("big", "0", float("nan")), ("none", "0", None)]
    df = spark.createDataFrame(rows, "GEOID string, band string, value double")
    stats = spatial.zonal_stats(df, rows_per_bucket=per_bucket)
    got = {(r.GEOID, r.band): r for r in stats.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        r = got[k]
        np.testing.assert_allclose(
            [r.MEAN, r.MEDIAN, r.MINIMUM, r.MAXIMUM, r.STD],
            [v.mean(), np.median(v), v.min(), v.max(), v.std()], atol=1e-12,
        )
    wide = spatial.zonal_wide(stats, "GEOID", ["0", "1"])
    assert wide.columns[:3] == ["GEOID", "0_MEAN", "0_MEDIAN"] and wide.count() == 3


@pytest.mark.parametrize("dims", [3, 16, 37])
@pytest.mark.parametrize("per_group", [10**6, 50])
def test_vector_stats(spark, dims, per_group):
    """Slices and buckets give what NumPy gives; short, missing and empty vectors take no part."""
    rng = np.random.default_rng(6)
    area = np.array(["big"] * 90 + ["small"] * 7 + ["one"])
    x = rng.normal(size=(len(area), dims)).round(3)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[area == "small", 1] = np.nan
    x[0, 2:] = np.nan
    rows = [(a, [None if np.isnan(e) and i % 2 else float(e) for e in v]) for i, (a, v) in enumerate(zip(area, x))]
    rows[0] = ("big", rows[0][1][:2])
    rows += [("big", None), ("none", []), ("none", None)]
    df = spark.createDataFrame(rows, "GEOID string, vector array<float>").repartition(3)
    got = {(r.GEOID, r.place): r for r in spatial.vector_stats(df, "GEOID", "vector", dims, per_group).collect()}
    want = {(a, i): x[area == a, i] for a in ("big", "small", "one") for i in range(dims)}
    want = {k: v[~np.isnan(v)] for k, v in want.items() if not np.isnan(v).all()}
    assert set(got) == set(want)
    for k, v in want.items():
        r = got[k]
        assert r.n == len(v)
        np.testing.assert_allclose(
            [r.MEAN, r.MEDIAN, r.MINIMUM, r.MAXIMUM, r.STD],
            [v.mean(), np.median(v), v.min(), v.max(), v.std()], atol=1e-6,
        )
    assert spatial.vector_stats(df.limit(0), "GEOID", "vector", dims).count() == 0


def test_overlaps_each_pair_once(spark):
    box = "k int, west double, south double, east double, north double"
    rng = np.random.default_rng(2)

    def boxes(n):
        out = []
        for i in range(n):
            x, y, a, b = rng.uniform(0, 30, 4)
            out.append((i, float(x), float(y), float(x + a), float(y + b)))
        return out

    a, b = boxes(30), boxes(20)
    s = spark.createDataFrame(a, box).withColumnRenamed("k", "s")
    t = spark.createDataFrame(b, box).withColumnRenamed("k", "t")
    got = spatial.overlaps(s, t, "s", "t", 4.0).collect()
    want = {
        (i[0], j[0]) for i in a for j in b
        if i[1] <= j[3] and j[1] <= i[3] and i[2] <= j[4] and j[2] <= i[4]
    }
    assert sorted((r.s, r.t) for r in got) == sorted(want)


def test_vectors(spark):
    df = spark.createDataFrame(
        [("a", [1.0, 2.0], 1.0), ("a", [4.0, 8.0], 3.0), ("z", [1.0, 1.0], 0.0),
         ("n", [1.0, None], 1.0), ("m", [float("nan"), 1.0], 1.0), ("o", None, 1.0)],
        "k string, v array<double>, w double",
    )
    kept = df.where(complete_vector(F.col("v")))
    assert {r.k for r in kept.collect()} == {"a", "z"}
    got = {r.k: r for r in weighted_mean(kept, "k", "v", "w", 2).collect()}
    assert got["a"].v == [3.25, 6.5] and got["a"].total_area == 4.0
    assert got["z"].v == [None, None]
    assert {r.k: r.v for r in mean_pool(kept, "k", "v", 2).collect()}["a"] == [2.5, 5.0]


def test_resume(spark, tmp_path):
    data, pixels = full_raster(spark, 16, 32, ["a"])
    chips = raster.to_chips(pixels, 8, ["a"], 16, 32)
    out = str(tmp_path / "enc")
    calls = []

    def encode(part):
        calls.append(1)
        return encode_chips(part, patch_means(4), 1, 8)

    assert encode_pending(spark, chips.where("row_off = 0"), encode, out).count() == 4
    done = encode_pending(spark, chips, encode, out)
    assert done.count() == 8 and done.select("row_off", "col_off").distinct().count() == 8
    assert encode_pending(spark, chips, encode, out).count() == 8
    final = str(tmp_path / "final")
    assert finish(spark, out, final, 100).count() == 8 and not exists(spark, out)
    assert len(list((tmp_path / "final").glob("*.parquet"))) == 1
    assert finish(spark, out, final).count() == 8  # run again after it was done

    folder, target = str(tmp_path / "in"), str(tmp_path / "stream")
    name = f"job-{uuid.uuid4().hex}"
    chips.where("row_off = 0").write.mode("append").parquet(folder)
    assert encode_arrivals(spark, folder, encode, target, name).count() == 4
    chips.where("row_off = 8").write.mode("append").parquet(folder)
    assert encode_arrivals(spark, folder, encode, target, name).count() == 8
    assert encode_arrivals(spark, folder, encode, target, name).count() == 8
