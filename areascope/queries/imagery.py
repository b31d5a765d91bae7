"""Raster and polygon queries: driver tables in the role of pixels, scenes and areas."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from areascope.functions import registry
from areascope.functions.ranking import exact_quantiles
from areascope.functions.scalars import season, solar_day, stat_name
from areascope.functions.vectors import vector_rows
from areascope.operators import raster
from areascope.operators.encode import encode_chips, patch_means
from areascope.operators.spatial import overlaps, pixels_in_areas, vector_stats, zonal_stats, zonal_wide
from areascope.queries.base import query, rounded
from areascope.session import checkpoint_dir
from areascope.sources.scenes import read_pixels, stack_bands
from areascope.sources.tables import table
from areascope.streaming.resume import encode_pending, finish

CHIP, PATCH = 32, 8
FLAGS = ["A", "N", "R"]


def observations(spark, d):
    """Events as pixel observations: pixel = user, band = event type, class from the payload."""
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    return e.select(
        "event_id", "ts", F.col("user_id").alias("pixel"), F.col("event_type").alias("band"),
        F.when(k % 7 != 0, F.col("value")).alias("value"), (k % 12).alias("scl"),
    )


OBS_SQL = """
obs AS (
  SELECT event_id, ts, user_id AS pixel, event_type AS band,
         CASE WHEN k % 7 <> 0 THEN value END AS value, k % 12 AS scl
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))
"""


@query(f"""
WITH {OBS_SQL}
SELECT pixel, band, round(median(value), 6) AS value, count(*) AS n FROM obs
WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND value IS NOT NULL GROUP BY 1, 2
""")
def masked_median(spark, d):
    """Median over time of the clear observations, snow hidden too."""
    clear = raster.mask_classes(observations(spark, d), exclude_snow=True).where(
        "value IS NOT NULL"
    )
    mid = exact_quantiles(clear, ["pixel", "band"], "value", [0.5])
    n = clear.groupBy("pixel", "band").agg(F.count(F.lit(1)).alias("n"))
    return rounded(
        mid.select("pixel", "band", F.col("q")[0].alias("value")).join(n, ["pixel", "band"])
    )


DAY_SQL = f"""
{OBS_SQL},
daily AS (
  SELECT pixel, band,
         CAST(CAST(ts + to_seconds((pixel % 360 - 180) * 240) AS DATE) AS VARCHAR) AS day,
         arg_min(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value,
         arg_min(scl, (ts, event_id)) FILTER (scl IS NOT NULL) AS scl
  FROM obs GROUP BY 1, 2, 3)
"""


def with_solar_day(spark, d):
    lon = (F.col("pixel") % 360 - 180).cast("double")
    return observations(spark, d).withColumn("day", solar_day(F.col("ts"), lon).cast("string"))


@query(f"WITH {DAY_SQL} SELECT pixel, band, day, value, scl FROM daily")
def day_mosaic(spark, d):
    """One observation per pixel, band and solar day."""
    return raster.mosaic_day(
        with_solar_day(spark, d), "day", ["ts", "event_id"], keys=["pixel", "band"]
    )


@query(f"""
WITH {DAY_SQL}
SELECT pixel, band,
       round(median(CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10) THEN value END), 6) AS value,
       count(CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10) THEN value END) AS n_clear
FROM daily GROUP BY 1, 2
""")
def clear_composite(spark, d):
    """Daily mosaic, class mask, median; never clear gives null."""
    return rounded(
        raster.composite(
            with_solar_day(spark, d), "day", ["ts", "event_id"], keys=["pixel", "band"]
        )
    )


@query("""
WITH o AS (
  SELECT o_custkey AS pixel, o_orderpriority AS band, o_totalprice AS value,
         o_orderkey % 12 AS scl, o_orderkey, o_orderdate AS day,
         CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 'spring'
              WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 'summer'
              WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 'fall' END AS season
  FROM orders),
daily AS (
  SELECT season, pixel, band, day, arg_min(value, o_orderkey) AS value, arg_min(scl, o_orderkey) AS scl
  FROM o WHERE season IS NOT NULL GROUP BY 1, 2, 3, 4)
SELECT season, pixel, band,
       round(median(CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10) THEN value END), 6) AS value,
       count(CASE WHEN scl NOT IN (0, 1, 3, 8, 9, 10) THEN value END) AS n_clear
FROM daily GROUP BY 1, 2, 3
""")
def season_composite(spark, d):
    """Seasonal composites; winter has none."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("pixel"), F.col("o_orderpriority").alias("band"),
        F.col("o_totalprice").alias("value"), (F.col("o_orderkey") % 12).alias("scl"),
        "o_orderkey", F.col("o_orderdate").alias("day"), season(F.col("o_orderdate")).alias("season"),
    ).where("season IS NOT NULL")
    return rounded(
        raster.composite(o, "day", ["o_orderkey"], keys=["season", "pixel", "band"])
    )


@query("""
WITH s(band, mean, std) AS (
  VALUES ('blue', 1087.0::DOUBLE, 2248.0::DOUBLE), ('green', 1342.0, 2179.0), ('red', 1433.0, 2178.0)),
p AS (SELECT l_orderkey, l_linenumber, l_shipdate, 'blue' AS band, l_quantity AS value FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'green', l_extendedprice FROM lineitem
  UNION ALL SELECT l_orderkey, l_linenumber, l_shipdate, 'red', l_discount FROM lineitem)
SELECT band, l_linenumber, count(*) AS n, round(avg((value - mean) / std), 6) AS mean_value
FROM p JOIN s USING (band) GROUP BY 1, 2
""")
def standardised_bands(spark, d):
    """Wide pixels to long bands, standardised by the band constants."""
    li = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("blue"),
        F.col("l_extendedprice").alias("green"), F.col("l_discount").alias("red"),
    )
    long = stack_bands(li, ["l_orderkey", "l_linenumber"], ["blue", "green", "red"])
    out = raster.standardise(long, raster.band_stats(li))
    return rounded(
        out.groupBy("band", "l_linenumber").agg(
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")
        )
    )


def grid(spark, d):
    """Raster of mean log price: row = supplier, col = quantity - 1, band = return flag."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_suppkey").cast("int").alias("row"),
        (F.col("l_quantity") - 1).cast("int").alias("col"),
        F.col("l_returnflag").alias("band"),
    ).agg(F.avg(F.ln("l_extendedprice")).alias("value"))


GRID_SQL = """
grid AS (SELECT CAST(l_suppkey AS INTEGER) AS "row", CAST(l_quantity - 1 AS INTEGER) AS col,
                l_returnflag AS band, avg(ln(l_extendedprice)) AS value
         FROM lineitem GROUP BY 1, 2, 3)
"""


@query(f"""
WITH {GRID_SQL},
l AS (SELECT unnest([2, 4, 8, 16, 32]) AS level)
SELECT CAST(level AS INTEGER) AS level, CAST("row" // level AS INTEGER) AS "row",
       CAST(col // level AS INTEGER) AS col, band, round(avg(value), 6) AS value
FROM grid, l GROUP BY 1, 2, 3, 4
""")
def overview_pyramid(spark, d):
    """Block averages at five levels."""
    return rounded(raster.overviews(grid(spark, d)))


def two_grids(spark, d):
    """The same for open and finished lines, two rasters in one table."""
    return table(spark, d, "lineitem").groupBy(
        F.col("l_linestatus").alias("raster"), F.col("l_suppkey").cast("int").alias("row"),
        (F.col("l_quantity") - 1).cast("int").alias("col"), F.col("l_returnflag").alias("band"),
    ).agg(F.avg(F.ln("l_extendedprice")).alias("value"))


TWO_GRIDS_SQL = """
grid AS (SELECT l_linestatus AS raster, CAST(l_suppkey AS INTEGER) AS "row",
                CAST(l_quantity - 1 AS INTEGER) AS col, l_returnflag AS band,
                avg(ln(l_extendedprice)) AS value
         FROM lineitem GROUP BY 1, 2, 3, 4)
"""


@query(f"""
WITH {TWO_GRIDS_SQL},
l AS (SELECT unnest([2, 4, 8, 16, 32]) AS level)
SELECT raster, CAST(level AS INTEGER) AS level, CAST("row" // level AS INTEGER) AS "row",
       CAST(col // level AS INTEGER) AS col, band, round(avg(value), 6) AS value
FROM grid, l GROUP BY ALL
""")
def two_rasters_pyramid(spark, d):
    """Block averages of two rasters at once."""
    return rounded(raster.overviews(two_grids(spark, d), keys=["raster"]))


def grid_size(pixels) -> tuple[int, int]:
    """Height and width of a pixel table (two numbers)."""
    r = pixels.agg(F.max("row").alias("h"), F.max("col").alias("w")).first()
    return r["h"] + 1, r["w"] + 1


def map_size(spark, d):
    return grid_size(
        table(spark, d, "lineitem").select(
            F.col("l_suppkey").cast("int").alias("row"),
            (F.col("l_quantity") - 1).cast("int").alias("col"),
        )
    )


def patch_map(spark, d, pixels, keys=None):
    """Chips, default encoder, map."""
    height, width = map_size(spark, d)
    chips = raster.to_chips(pixels, CHIP, FLAGS, height, width, keys=keys)
    encoded = encode_chips(chips, patch_means(PATCH), len(FLAGS), CHIP, keys=keys)
    return raster.from_chips(encoded, PATCH, height, width, keys)


def map_sql(pixels: str, raster: str = "") -> str:
    """The full grid of cells; `raster` is the key column and a comma, or nothing."""
    names = f"SELECT DISTINCT {raster} 0 AS zero FROM grid"
    same = "AND s.raster = p.raster" if raster else ""
    return f"""
WITH {pixels},
size AS (SELECT max(l_suppkey) + 1 AS h, max(CAST(l_quantity AS BIGINT)) AS w FROM lineitem),
cells AS (SELECT {raster} "row", col FROM ({names}),
                 (SELECT unnest(range(0, (h + 7) // 8)) AS "row" FROM size),
                 (SELECT unnest(range(0, (w + 7) // 8)) AS col FROM size)),
sums AS (SELECT {raster} "row" // 8 AS "row", col // 8 AS col, band, count(*) AS n,
                sum(CAST(CAST(value AS FLOAT) AS DOUBLE)) AS s FROM grid GROUP BY ALL),
b AS (SELECT unnest(['A', 'N', 'R']) AS band, unnest([0, 1, 2]) AS pos),
pad AS (SELECT {raster} c."row", c.col, 64 - (least(h, c."row" * 8 + 8) - c."row" * 8)
                                 * (least(w, c.col * 8 + 8) - c.col * 8) AS n_pad
        FROM cells c, size)
SELECT {raster and "p.raster,"} CAST(p."row" AS INTEGER) AS "row", CAST(p.col AS INTEGER) AS col, CAST(b.pos AS INTEGER) AS pos,
       round(CAST(coalesce(s, 0) / nullif(coalesce(n, 0) + n_pad, 0) AS FLOAT)::DOUBLE, 5) AS value
FROM pad p CROSS JOIN b
LEFT JOIN sums s ON s."row" = p."row" AND s.col = p.col AND s.band = b.band {same}
"""


@query(map_sql(GRID_SQL))
def encoded_map(spark, d):
    """Chips padded with zeros at the edge, mean per patch and band, trimmed to the raster."""
    return map_values(patch_map(spark, d, grid(spark, d)), ["row", "col"])


@query(map_sql(TWO_GRIDS_SQL, "raster,"))
def two_rasters_map(spark, d):
    """Two rasters cut, encoded and mapped in one pass."""
    cells = patch_map(spark, d, two_grids(spark, d), ["raster"])
    return map_values(cells, ["raster", "row", "col"])


@query(map_sql(TWO_GRIDS_SQL, "raster,"))
def resume_two_rasters(spark, d):
    """The same in two runs: the second encodes only what the first left open."""
    return two_runs(spark, d, lambda path, done: done)


@query(map_sql(TWO_GRIDS_SQL, "raster,"))
def finished_ledger(spark, d):
    """The same, with the ledger of both runs written as few files and removed in the end."""
    return two_runs(spark, d, lambda path, done: finish(spark, path, f"{path}-done"))


def two_runs(spark, d, end):
    height, width = map_size(spark, d)
    chips = raster.to_chips(two_grids(spark, d), CHIP, FLAGS, height, width, keys=["raster"])
    path = f"{checkpoint_dir(spark)}/resume/{uuid.uuid4().hex}"

    def encode(part):
        return encode_chips(part, patch_means(PATCH), len(FLAGS), CHIP, keys=["raster"])

    encode_pending(spark, chips.where("raster = 'F'"), encode, path, ["raster"])
    done = end(path, encode_pending(spark, chips, encode, path, ["raster"]))
    return map_values(
        raster.from_chips(done, PATCH, height, width, ["raster"]), ["raster", "row", "col"]
    )


def map_values(cells, names):
    rows = vector_rows(cells, names, "vector")
    value = F.col("value").cast("double")
    return rounded(rows.withColumn("value", F.when(~F.isnan(value), value)), 5)


SEASONS = ["spring", "summer", "fall"]


@query("""
WITH o AS (
  SELECT CAST(o_custkey AS INTEGER) AS "row", CAST(day(o_orderdate) - 1 AS INTEGER) AS col,
         CASE WHEN month(o_orderdate) BETWEEN 3 AND 5 THEN 0 WHEN month(o_orderdate) BETWEEN 6 AND 8 THEN 1
              WHEN month(o_orderdate) BETWEEN 9 AND 11 THEN 2 END AS season,
         CAST(avg(ln(o_totalprice)) AS FLOAT) AS value
  FROM orders GROUP BY 1, 2, 3),
c AS (SELECT CAST("row" // 32 * 32 AS INTEGER) AS row_off, CAST(col // 32 * 32 AS INTEGER) AS col_off,
             season, count(*) AS n, sum(value::DOUBLE) AS total FROM o WHERE season IS NOT NULL GROUP BY 1, 2, 3),
every AS (SELECT CAST(row_off AS INTEGER) AS row_off, 0 AS col_off, season
          FROM (SELECT unnest(range(0, max(c_custkey) + 1, 32)) AS row_off FROM customer),
               (SELECT unnest([0, 1, 2]) AS season))
SELECT row_off, col_off, CAST(season AS INTEGER) AS place, coalesce(n, 0) AS n,
       round(coalesce(total, 0), 4) AS total
FROM every LEFT JOIN c USING (row_off, col_off, season)
""")
def season_chips(spark, d):
    """Seasonal chips of the same place, one after the other; per season its pixels and sum."""
    orders = table(spark, d, "orders").select(
        F.col("o_custkey").cast("int").alias("row"),
        (F.day("o_orderdate") - 1).cast("int").alias("col"), F.lit("price").alias("band"),
        season(F.col("o_orderdate")).alias("season"), F.ln("o_totalprice").alias("value"),
    )
    height = table(spark, d, "customer").agg(F.max("c_custkey") + 1).first()[0]
    means = orders.groupBy("row", "col", "band", "season").agg(F.avg("value").alias("value"))
    seasonal = means.where(F.col("season").isNotNull())
    chips = raster.to_chips(seasonal, CHIP, ["price"], height, 31, keys=["season"])
    size = CHIP * CHIP
    parts = F.transform(
        F.sequence(F.lit(0), F.lit(2)),
        lambda k: F.filter(
            F.slice("data", k * size + 1, F.lit(size)), lambda v: ~F.isnan(v) & (v != 0)
        ),
    )
    stacked = raster.stack_seasons(chips, SEASONS)
    return stacked.select("row_off", "col_off", F.posexplode(parts).alias("place", "seen")).select(
        "row_off", "col_off", "place", F.size("seen").cast("bigint").alias("n"),
        F.round(
            F.aggregate("seen", F.lit(0.0), lambda acc, v: acc + v.cast("double")), 4
        ).alias("total"),
    )


@query(f"""
WITH {OBS_SQL},
s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'F')
SELECT event_id, band, value, scl FROM obs JOIN s ON id = event_id WHERE band IN ('click', 'view')
""")
def scene_pixels(spark, d):
    """Pixels of the chosen scenes and bands."""
    scenes = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("scene_id")
    )
    pixels = observations(spark, d).withColumn("scene_id", F.col("event_id"))
    return read_pixels(pixels, scenes, ["click", "view"]).select("event_id", "band", "value", "scl")


@query(f"""
WITH {GRID_SQL}
SELECT CAST("row" // 32 * 32 AS INTEGER) AS row_off, CAST(col // 32 * 32 AS INTEGER) AS col_off
FROM grid GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 5
""")
def trial_chips(spark, d):
    """The first chips in reading order."""
    chips = raster.chip_index(grid(spark, d), CHIP).select("row_off", "col_off").distinct()
    return raster.first_chips(chips, 5)


@query("""
SELECT CAST(s_suppkey AS INTEGER) AS row_off, 300000.0 + (s_nationkey * 128 + 64.0) * 10 AS x,
       4600000.0 - (s_suppkey + 64.0) * 10 AS y, 10.0 * 8 AS a, -10.0 * 8 AS e
FROM supplier
""")
def chip_places(spark, d):
    """Chip centres through the raster's transform, and the coarser map's transform."""
    chips = table(spark, d, "supplier").select(
        F.col("s_suppkey").cast("int").alias("row_off"),
        (F.col("s_nationkey") * 128).alias("col_off"), F.lit(10.0).alias("a"),
        F.lit(300000.0).alias("c"), F.lit(-10.0).alias("e"), F.lit(4600000.0).alias("f"),
    )
    placed = raster.chip_center(chips, registry.ANNUAL_CHIP)
    return raster.scale_transform(placed, registry.ANNUAL_PATCH).select("row_off", "x", "y", "a", "e")


# --- polygons -----------------------------------------------------------------------------


def areas(spark, d):
    """Two areas per nation: a frame with a hole, and a triangle inside the hole."""
    k = F.col("n_nationkey")
    x0 = (k % 5 * 10).cast("double")
    y0 = (F.floor(k / 5) * 20 + 900).cast("double")

    def ring(*points):
        return F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in points])

    frame = F.array(
        ring((0, 0), (10, 0), (10, 20), (0, 20)), ring((2, 4), (8, 4), (8, 16), (2, 16))
    )
    triangle = F.array(ring((2, 4), (8, 4), (5, 16)))
    both = F.array(
        F.struct(F.concat(F.lpad(k.cast("string"), 2, "0"), F.lit("F")).alias("GEOID"),
                 frame.alias("rings")),
        F.struct(F.concat(F.lpad(k.cast("string"), 2, "0"), F.lit("T")).alias("GEOID"),
                 triangle.alias("rings")),
    )
    return table(spark, d, "nation").select(F.inline(both))


POINTS_SQL = """
n AS (SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code,
             CAST(n_nationkey % 5 * 10 AS DOUBLE) AS x0, CAST(900 + n_nationkey // 5 * 20 AS DOUBLE) AS y0
      FROM nation),
shape(kind, ax, ay, zx, zy) AS (VALUES
  ('F', 0, 0, 10, 0), ('F', 10, 0, 10, 20), ('F', 10, 20, 0, 20), ('F', 0, 20, 0, 0),
  ('F', 2, 4, 8, 4), ('F', 8, 4, 8, 16), ('F', 8, 16, 2, 16), ('F', 2, 16, 2, 4),
  ('T', 2, 4, 8, 4), ('T', 8, 4, 5, 16), ('T', 5, 16, 2, 4)),
edge AS (SELECT code || kind AS geoid, x0 + ax AS x1, y0 + ay AS y1, x0 + zx AS x2, y0 + zy AS y2
         FROM n, shape),
hit AS (
  SELECT geoid, p_partkey FROM edge, part
  GROUP BY geoid, p_partkey
  HAVING sum(CASE WHEN (y1 > p_retailprice) <> (y2 > p_retailprice)
                   AND p_size < (x2 - x1) * (p_retailprice - y1) / (y2 - y1) + x1
             THEN 1 ELSE 0 END) % 2 = 1)
"""


def located_parts(spark, d, cell: float = 4.0):
    points = table(spark, d, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y")
    )
    return pixels_in_areas(points, areas(spark, d), "GEOID", cell).select("GEOID", "p_partkey")


@query(f'WITH {POINTS_SQL} SELECT geoid AS "GEOID", p_partkey FROM hit')
def points_in_areas(spark, d):
    """Points in polygons with holes; a point on a border is in one area."""
    return located_parts(spark, d)


def area_pixels(spark, d):
    """Line items as pixel values at the place of their part, two bands."""
    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"), F.col("l_quantity").alias("0"),
        F.col("l_discount").alias("1"),
    )
    inside = li.join(located_parts(spark, d), "p_partkey")
    return stack_bands(inside, ["GEOID"], ["0", "1"])


ZONAL_SQL = f"""
{POINTS_SQL},
px AS (SELECT geoid, '0' AS band, l_quantity AS v FROM lineitem JOIN hit ON l_partkey = p_partkey
       UNION ALL SELECT geoid, '1', l_discount FROM lineitem JOIN hit ON l_partkey = p_partkey),
z AS (SELECT geoid, band, count(*) AS n, avg(v) AS "MEAN", median(v) AS "MEDIAN", min(v) AS "MINIMUM",
             max(v) AS "MAXIMUM", stddev_pop(v) AS "STD" FROM px GROUP BY 1, 2)
"""


@query(f"""
WITH {ZONAL_SQL}
SELECT geoid AS "GEOID", band, n, round("MEAN", 6) AS "MEAN", round("MEDIAN", 6) AS "MEDIAN",
       "MINIMUM", "MAXIMUM", round("STD", 6) AS "STD" FROM z
""")
def area_stats(spark, d):
    """Five statistics per area and band."""
    return rounded(zonal_stats(area_pixels(spark, d)))


@query(f"""
WITH {ZONAL_SQL}
SELECT a.geoid AS "GEOID", round(a."MEAN", 6) AS "0_MEAN", round(a."MEDIAN", 6) AS "0_MEDIAN",
       a."MINIMUM" AS "0_MINIMUM", a."MAXIMUM" AS "0_MAXIMUM", round(a."STD", 6) AS "0_STD",
       round(b."MEAN", 6) AS "1_MEAN", round(b."MEDIAN", 6) AS "1_MEDIAN",
       b."MINIMUM" AS "1_MINIMUM", b."MAXIMUM" AS "1_MAXIMUM", round(b."STD", 6) AS "1_STD"
FROM z a JOIN z b ON a.geoid = b.geoid AND a.band = '0' AND b.band = '1'
""")
def area_stats_wide(spark, d):
    """One row per area, one column per band and statistic."""
    return rounded(zonal_wide(zonal_stats(area_pixels(spark, d)), "GEOID", ["0", "1"]))


VECTOR_STATS_SQL = """
WITH e AS (SELECT label, CAST(unnest(range(len(embedding))) AS INTEGER) AS place,
                  CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT label, place, count(v) AS n, round(avg(v), 6) AS "MEAN", round(median(v), 6) AS "MEDIAN",
       round(min(v), 6) AS "MINIMUM", round(max(v), 6) AS "MAXIMUM", round(stddev_pop(v), 6) AS "STD"
FROM e WHERE NOT isnan(v) GROUP BY 1, 2
"""


@query(VECTOR_STATS_SQL)
def label_vector_stats(spark, d):
    """Five statistics per label and place of its vectors."""
    return rounded(vector_stats(table(spark, d, "embeddings"), "label", "embedding", 64))


@query(VECTOR_STATS_SQL)
def label_vector_stats_large(spark, d):
    """The same when every label outgrows a group: buckets per place."""
    return rounded(vector_stats(table(spark, d, "embeddings"), "label", "embedding", 64, 1))


@query(f"""
WITH {ZONAL_SQL}
SELECT geoid AS "GEOID", 'OE' || lpad(band, 2, '0') || '_MEAN' AS stat, round("MEAN", 6) AS value FROM z
""")
def area_stat_names(spark, d):
    """Statistic names with the model prefix."""
    z = zonal_stats(area_pixels(spark, d))
    return rounded(
        z.select(
            "GEOID", stat_name("OE", F.col("band"), F.lit("MEAN")).alias("stat"),
            F.col("MEAN").alias("value"),
        )
    )


@query("""
WITH s AS (SELECT o_orderkey AS scene_id, CAST(o_custkey % 50 AS DOUBLE) AS w,
                  CAST(900 + o_orderkey % 100 AS DOUBLE) AS s,
                  CAST(o_custkey % 50 + 3 AS DOUBLE) AS e, CAST(900 + o_orderkey % 100 + 5 AS DOUBLE) AS n
           FROM orders),
a AS (SELECT n_nationkey AS k, CAST(n_nationkey % 5 * 10 AS DOUBLE) AS w,
             CAST(900 + n_nationkey // 5 * 20 AS DOUBLE) AS s,
             CAST(n_nationkey % 5 * 10 + 10 AS DOUBLE) AS e,
             CAST(900 + n_nationkey // 5 * 20 + 20 AS DOUBLE) AS n FROM nation)
SELECT scene_id, k FROM s JOIN a ON s.w <= a.e AND a.w <= s.e AND s.s <= a.n AND a.s <= s.n
""")
def scene_areas(spark, d):
    """Scenes with the areas their boxes overlap."""
    x, y = F.col("o_custkey") % 50, F.col("o_orderkey") % 100 + 900
    scenes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scene_id"), x.cast("double").alias("west"),
        y.cast("double").alias("south"), (x + 3).cast("double").alias("east"),
        (y + 5).cast("double").alias("north"),
    )
    ax, ay = F.col("n_nationkey") % 5 * 10, F.floor(F.col("n_nationkey") / 5) * 20 + 900
    boxes = table(spark, d, "nation").select(
        F.col("n_nationkey").alias("k"), ax.cast("double").alias("west"),
        ay.cast("double").alias("south"), (ax + 10).cast("double").alias("east"),
        (ay + 20).cast("double").alias("north"),
    )
    return overlaps(scenes, boxes, "scene_id", "k", 10.0)
