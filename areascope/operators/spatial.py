"""Pixels in polygons, box overlaps and area statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.functions import registry
from areascope.functions.ranking import grouped_stats
from areascope.operators.joins import join_null_safe, lookup_join
from areascope.session import BROADCAST_ROWS, ROWS_PER_BUCKET, by_key, materialise

# Polygon pieces carry edge lists, so fewer rows of them are broadcast than of plain tables.
BROADCAST_PIECES = 20_000

# Vectors are summed up in slices of this many places; a group of them is at most 64 MB.
SLICE = 16
AREA_CELLS = 500_000


def ray_cast(edges: Column, x: Column, y: Column) -> Column:
    """Even-odd rule with half-open edges: a point on a shared border is in one area only."""

    def cross(inside: Column, e: Column) -> Column:
        spans = (e["y1"] > y) != (e["y2"] > y)
        at = F.try_divide((e["x2"] - e["x1"]) * (y - e["y1"]), e["y2"] - e["y1"]) + e["x1"]
        return F.when(spans & (x < at), ~inside).otherwise(inside)

    return F.aggregate(edges, F.lit(False), cross)


def area_edges(areas: DataFrame, key: str) -> DataFrame:
    """Polygons (key, rings) to their edge list and bounding box; holes are further rings."""

    def ring_edges(ring: Column) -> Column:
        following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
        return F.zip_with(
            ring, following,
            lambda p, q: F.struct(
                p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")
            ),
        )

    edges = areas.select(key, F.flatten(F.transform("rings", ring_edges)).alias("edges"))
    xs, ys = F.transform("edges", lambda e: e["x1"]), F.transform("edges", lambda e: e["y1"])
    return edges.withColumns(
        {
            "west": F.array_min(xs), "east": F.array_max(xs),
            "south": F.array_min(ys), "north": F.array_max(ys),
        }
    )


def _steps(low: str, high: str, cell: float) -> Column:
    return F.sequence(F.floor(F.col(low) / cell), F.floor(F.col(high) / cell))


def area_cells(areas: DataFrame, key: str, cell: float) -> DataFrame:
    """Polygons cut along a grid: (key, cx, cy, covered, edges).

    Edges go to the grid rows they cross first; a cell is then cut from the edges of its row only,
    so a border of very many edges is never copied whole. A cell no edge comes near is wholly inside
    (covered, no edges needed) or outside (dropped). Other cells keep only the edges a rightward ray
    from the cell can meet.
    """
    low, high = F.least("e.x1", "e.x2"), F.greatest("e.x1", "e.x2")
    bottom, top = F.least("e.y1", "e.y2"), F.greatest("e.y1", "e.y2")
    rows = area_edges(areas, key).select(key, F.explode("edges").alias("e"))
    rows = rows.withColumn("cy", F.explode(F.sequence(F.floor(bottom / cell), F.floor(top / cell))))
    # cells are compared by the same floor that places points, so both round alike
    placed = F.struct("e.*", F.floor(low / cell).alias("c1"), F.floor(high / cell).alias("c2"))
    strips = rows.groupBy(key, "cy").agg(
        F.collect_list(placed).alias("edges"),
        F.min(F.floor(low / cell)).alias("first"), F.max(F.floor(high / cell)).alias("last"),
    )
    pieces = strips.withColumn("cx", F.explode(F.sequence("first", "last")))
    pieces = pieces.withColumn("edges", F.filter("edges", lambda e: e["c2"] >= F.col("cx")))
    touched = F.exists("edges", lambda e: e["c1"] <= F.col("cx"))
    centre = ray_cast(F.col("edges"), (F.col("cx") + 0.5) * cell, (F.col("cy") + 0.5) * cell)
    pieces = pieces.withColumn("touched", touched).withColumn("covered", ~F.col("touched") & centre)
    return pieces.where("touched OR covered").select(
        key, "cx", "cy", "covered", F.when(~F.col("covered"), F.col("edges")).alias("edges")
    )


def pixels_in_areas(
    pixels: DataFrame, areas: DataFrame, key: str = "GEOID", cell: float = 1.0,
    x: str = "x", y: str = "y", rows: int = BROADCAST_PIECES,
) -> DataFrame:
    """Each pixel with the area its centre lies in; areas without a pixel do not appear.

    An equi-join on the grid cell (pieces broadcast when counted small, else shuffled with
    heavy cells salted), then the exact test only in cells an area border crosses.
    """
    located = pixels.withColumns(
        {"cx": F.floor(F.col(x) / cell), "cy": F.floor(F.col(y) / cell)}
    )
    met = lookup_join(located, area_cells(areas, key, cell), ["cx", "cy"], "inner", rows)
    inside = F.when(F.col("covered"), True).otherwise(
        ray_cast(F.col("edges"), F.col(x), F.col(y))
    )
    return met.where(inside).drop("cx", "cy", "covered", "edges")


def zonal_stats(
    inside: DataFrame, key: str = "GEOID", band: str = "band", value: str = "value",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Mean, median, min, max and population std per area and band, missing values skipped.

    Four of them combine on the map side; the median goes through counted buckets, so the
    largest area does not have to fit in a task. The located values are written once, so the
    spatial join behind them runs once.
    """
    seen = materialise(inside.where(~F.isnan(value)).select(key, band, value))
    base = [
        F.avg(value).alias("MEAN"), F.min(value).alias("MINIMUM"), F.max(value).alias("MAXIMUM"),
        F.stddev_pop(value).alias("STD"), F.count(value).alias("n"),
    ]
    out = grouped_stats(seen, [key, band], value, base, [0.5], "__q", rows_per_bucket, True)
    out = out.withColumn("MEDIAN", F.col("__q")[0])
    return out.select(key, band, "n", *registry.AREA_STATS)


def vector_stats(
    cells: DataFrame, key: str, vector: str, dims: int, rows_per_group: int = AREA_CELLS
) -> DataFrame:
    """`zonal_stats` of every place of a vector: (key, place, n, statistics), missing values skipped.

    Vectors move once, in slices of SLICE places, and an area's slices are summed up together. Only
    areas of more than `rows_per_group` vectors, as counted, get a row per place, for the buckets of
    `zonal_stats`. Places beyond the end of a vector are missing.
    """
    values = F.slice(F.col(vector).cast("array<double>"), 1, dims).alias("values")
    cells = materialise(cells.select(key, values))
    sizes = cells.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    large = materialise(sizes.where(F.col("__n") > rows_per_group))
    n_large, out = large.count(), None
    if n_large:
        large = F.broadcast(large) if n_large <= BROADCAST_ROWS else large
        marked = join_null_safe(cells, large, [key], "left")
        cells = marked.where("__n IS NULL").drop("__n")
        many = marked.where("__n IS NOT NULL").select(key, F.posexplode("values").alias("place", "value"))
        out = zonal_stats(many, key, "place", rows_per_bucket=min(ROWS_PER_BUCKET, rows_per_group))
    starts = F.sequence(F.lit(1), F.lit(dims), F.lit(SLICE))
    slices = F.transform(starts, lambda at: F.slice("values", at, SLICE))
    sliced = cells.select(key, F.posexplode(slices).alias("block", "part"))
    sliced = sliced.where(F.size("part") > 0)

    def summary(rows: pd.DataFrame) -> pd.DataFrame:
        block = int(rows["block"].iloc[0])
        x = np.full((len(rows), SLICE), np.nan)
        for i, part in enumerate(rows["part"]):
            x[i, : len(part)] = part
        n = (~np.isnan(x)).sum(axis=0)
        x = x[:, n > 0]
        stats = [f(x, axis=0) for f in (np.nanmean, np.nanmedian, np.nanmin, np.nanmax, np.nanstd)]
        named = dict(zip(registry.AREA_STATS, stats, strict=True))
        place = block * SLICE + np.flatnonzero(n)
        return pd.DataFrame({key: [rows[key].iloc[0]] * len(place), "place": place, "n": n[n > 0], **named})

    fields = [T.StructField(s, T.DoubleType()) for s in registry.AREA_STATS]
    schema = T.StructType(
        [cells.schema[key], T.StructField("place", T.IntegerType()), T.StructField("n", T.LongType()), *fields]
    )
    few = by_key(sliced, [key, "block"]).groupBy(key, "block").applyInPandas(summary, schema)
    return few if out is None else few.unionByName(out)


def zonal_wide(stats: DataFrame, key: str, names: list[str], band: str = "band") -> DataFrame:
    """One row per area, one column per band and statistic: <band>_<STAT>."""
    cells = stats.select(
        key, F.col(band).cast("string").alias("__b"),
        F.struct(*registry.AREA_STATS).alias("__s"),
    )
    wide = cells.groupBy(key).pivot("__b", names).agg(F.first("__s"))
    return wide.select(
        key,
        *[F.col(f"`{b}`.{s}").alias(f"{b}_{s}") for b in names for s in registry.AREA_STATS],
    )


def overlaps(
    scenes: DataFrame, areas: DataFrame, scene_key: str, area_key: str, cell: float
) -> DataFrame:
    """Scene and area pairs whose boxes (west, south, east, north) overlap.

    Both are listed by grid cell and joined on it; a pair is reported in one cell only, the
    one with the lower-left corner of the common box, so no distinct is needed.
    """

    def by_cell(df: DataFrame, key: str, tag: str) -> DataFrame:
        cells = df.withColumn("cx", F.explode(_steps("west", "east", cell))).withColumn(
            "cy", F.explode(_steps("south", "north", cell))
        )
        box = [F.col(c).alias(f"{tag}_{c}") for c in ("west", "south", "east", "north")]
        return cells.select("cx", "cy", key, *box)

    met = lookup_join(
        by_cell(scenes, scene_key, "s"), by_cell(areas, area_key, "a"), ["cx", "cy"], "inner"
    )
    return met.where(
        (F.col("s_west") <= F.col("a_east")) & (F.col("a_west") <= F.col("s_east"))
        & (F.col("s_south") <= F.col("a_north")) & (F.col("a_south") <= F.col("s_north"))
        & (F.col("cx") == F.floor(F.greatest("s_west", "a_west") / cell))
        & (F.col("cy") == F.floor(F.greatest("s_south", "a_south") / cell))
    ).select(scene_key, area_key)
