"""Imagery to area statistics: scenes, composite, chips, vectors, areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.functions.scalars import solar_day
from areascope.operators import raster
from areascope.operators.encode import encode_chips, patch_means, standardised
from areascope.operators.joins import union_all
from areascope.operators.projection import Projection, pca_apply, pca_fit_sample
from areascope.operators.spatial import pixels_in_areas, vector_stats, zonal_wide
from areascope.sources.scenes import read_pixels, select_scenes, windows


def composites(
    scenes: DataFrame, pixels: DataFrame, box: tuple[float, float, float, float], year: int,
    seasonal: bool = False, max_cloud: float = 80.0,
) -> dict[str, DataFrame]:
    """Cloud-free composite per window of the year: name to (row, col, band, value).

    `pixels` has scene_id, ts, row, col, band, value, scl. The local day follows the box's
    middle longitude.
    """
    bands = registry.SEASONAL_BANDS if seasonal else registry.ANNUAL_BANDS
    middle = F.lit((box[0] + box[2]) / 2)
    out = {}
    for name, start, end in windows(year, seasonal):
        chosen = select_scenes(scenes, box, start, end, max_cloud)
        obs = read_pixels(pixels, chosen, bands).withColumn("day", solar_day(F.col("ts"), middle))
        out[name] = raster.composite(obs, "day", ["ts", "scene_id"])
    return out


def vector_map(
    found: dict[str, DataFrame], height: int, width: int, seasonal: bool = False,
    load: Callable | None = None, chip: int | None = None, patch: int | None = None,
    keys: list[str] | None = None, place: dict[str, float] | None = None,
) -> DataFrame:
    """Composites to maps of patch vectors (keys..., row, col, vector); `keys` name the raster.

    Seasonal composites are stacked and standardised by band after padding; `load` brings the
    encoder, by default the mean per band and patch. With `place` (a, c, e, f of the transform and
    the northern UTM zone) the encoder gets a second argument, the latitude and longitude of each
    chip's centre (columns lat and lon).
    """
    bands = registry.SEASONAL_BANDS if seasonal else registry.ANNUAL_BANDS
    px = chip or (registry.SEASONAL_CHIP if seasonal else registry.ANNUAL_CHIP)
    stride = patch or (registry.SEASONAL_PATCH if seasonal else registry.ANNUAL_PATCH)
    load = load or patch_means(stride)
    if not seasonal:
        (only,) = found.values()
        chips = raster.to_chips(only, px, bands, height, width, keys=keys)
    else:
        pixels = union_all(
            *[part.withColumn("season", F.lit(name)) for name, part in found.items()]
        )
        cut = raster.to_chips(pixels, px, bands, height, width, keys=[*(keys or []), "season"])
        chips = raster.stack_seasons(cut, list(found), keys)
        means, stds = zip(*[registry.BAND_STATS[b] for b in bands], strict=True)
        load = standardised(load, means * len(found), stds * len(found))
    channels = len(bands) * len(found)
    extra = []
    if place:
        chips = raster.chip_center(chips.withColumns({k: F.lit(float(place[k])) for k in "acef"}), px)
        chips, extra = raster.utm_to_latlon(chips, F.lit(int(place["zone"]))), ["lat", "lon"]
    encoded = encode_chips(chips, load, channels, px, extra=extra, keys=keys)
    return raster.from_chips(encoded, stride, height, width, keys)


def reduce_map(
    cells: DataFrame, dims: int = 64, projection: Projection | None = None, seed: int = 42
) -> tuple[DataFrame, Projection]:
    """Vectors to their first components, fitted on a sample unless a projection is given."""
    keyed = cells.withColumn("cell", F.concat_ws(":", "row", "col"))
    fitted = projection or pca_fit_sample(keyed, "vector", "cell", dims, seed=seed)
    scored = pca_apply(cells, "vector", fitted).drop("vector")
    return scored.withColumnRenamed("pc", "vector"), fitted


def area_table(
    cells: DataFrame, areas: DataFrame, transform: dict[str, float], stride: int, dims: int,
    prefix: str, year: int, sizes: DataFrame | None = None,
) -> DataFrame:
    """Statistics of the cells inside each area, wide: GEOID, year, <prefix><nn>_<STAT>...

    `transform` holds a, c, e, f of the input raster; `sizes` (GEOID, ALAND, AWATER) adds the
    areas the later analysis wants.
    """
    placed = cells.withColumns({k: F.lit(float(v)) for k, v in transform.items()})
    placed = raster.chip_center(raster.scale_transform(placed, stride), 1, "row", "col")
    cell = abs(float(transform["a"])) * stride * 32
    inside = pixels_in_areas(placed.select("x", "y", "vector"), areas, "GEOID", cell)
    width = 2 if dims <= 100 else 4
    stats = vector_stats(inside, "GEOID", "vector", dims)
    band = F.concat(F.lit(prefix), F.lpad(F.col("place").cast("string"), width, "0"))
    names = [f"{prefix}{i:0{width}d}" for i in range(dims)]
    wide = zonal_wide(stats.withColumn("band", band), "GEOID", names).withColumn("year", F.lit(year))
    return wide if sizes is None else wide.join(sizes, "GEOID", "left")
