"""Scene catalogue, scene pixels and composite windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.functions.registry import SEASON_MONTHS


def select_scenes(
    scenes: DataFrame, box: tuple[float, float, float, float], start: str, end: str,
    max_cloud: float = 80.0,
) -> DataFrame:
    """Scenes that meet the box, fall in the period (last day included) and have cloud cover
    strictly below the limit."""
    west, south, east, north = box
    return scenes.where(
        (F.col("west") <= east) & (F.col("east") >= west)
        & (F.col("south") <= north) & (F.col("north") >= south)
        & in_window(F.col("ts"), start, end)
        & (F.col("cloud_cover") < max_cloud)
    )


def in_window(ts: Column, start: str, end: str) -> Column:
    """From the start of the first day to the end of the last."""
    return (ts >= F.lit(start).cast("timestamp_ntz")) & (
        ts < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    )


def windows(year: int, seasonal: bool) -> list[tuple[str, str, str]]:
    """(name, first day, last day) of the composites of a year; winter has none."""
    if not seasonal:
        return [("annual", f"{year}-01-01", f"{year}-12-31")]
    last = {5: 31, 8: 31, 11: 30}
    return [
        (name, f"{year}-{a:02d}-01", f"{year}-{b:02d}-{last[b]}")
        for name, (a, b) in SEASON_MONTHS.items()
    ]


def read_pixels(pixels: DataFrame, scenes: DataFrame, bands: list[str]) -> DataFrame:
    """Pixels of the chosen scenes and bands; the class code travels with each pixel.

    The band filter reaches the scan, the scene list is joined as a semi-join.
    """
    return pixels.where(F.col("band").isin(list(bands))).join(
        scenes.select("scene_id").distinct(), "scene_id", "left_semi"
    )


def stack_bands(df: DataFrame, keys: list[str], bands: list[str]) -> DataFrame:
    """Wide pixels (one column per band) to long rows."""
    pairs = F.array(
        *[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands]
    )
    return df.select(*keys, F.inline(pairs))
