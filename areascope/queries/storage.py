"""Files, tiles and polygons on the driver tables: what is written is read again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from areascope.functions.vectors import mean_direction, vector_rows
from areascope.operators import tiles
from areascope.operators.spatial import pixels_in_areas
from areascope.queries.base import query, rounded
from areascope.queries.summaries import DIMS
from areascope.session import checkpoint_dir
from areascope.sources.areas import read_areas, with_geometry
from areascope.sources.tables import (
    cached, read_csv, read_parquet, table, write_csv, write_panel, write_tiles,
)


def fresh_path(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/areascope/{name}-{uuid.uuid4().hex}"


# --- files --------------------------------------------------------------------------------


@query("""
SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS "GEOID", c_nationkey % 4 AS grp,
       CASE WHEN c_custkey % 7 NOT IN (0, 3) THEN c_acctbal END AS score
FROM customer
""")
def csv_round_trip(spark, d):
    """A table written as CSV and read by a schema that names some of its columns in another order;
    ids keep their zeros, a token and NaN are missing."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey") % 7
    out = c.select(
        F.lpad(F.col("c_custkey").cast("string"), 11, "0").alias("GEOID"), "c_name",
        F.when(k == 0, "PrivacySuppressed").when(k == 3, "NaN").otherwise(
            F.col("c_acctbal").cast("string")
        ).alias("score"),
        (F.col("c_nationkey") % 4).alias("grp"),
    )
    path = fresh_path(spark, "csv")
    write_csv(out, path)
    return read_csv(spark, path, "grp int, score double, GEOID string", "PrivacySuppressed")


@query("""
SELECT o_orderkey, year(o_orderdate) AS year, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS price
FROM orders WHERE year(o_orderdate) IN (1995, 1996)
""")
def panel_segments(spark, d):
    """A panel written by year, two of its years read by a pattern; NaN is missing."""
    o = table(spark, d, "orders").select(
        "o_orderkey", F.year("o_orderdate").alias("year"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("price"),
    )
    path = fresh_path(spark, "panel")
    write_panel(o.withColumn("part", F.col("year")), path, "part")
    return read_parquet(spark, f"{path}/part=199[56]")


@query("""
SELECT l_returnflag AS band, l_linestatus AS tile, count(*) AS n, round(sum(l_quantity), 2) AS total
FROM lineitem GROUP BY 1, 2
""")
def tile_files(spark, d):
    """Values written in a folder per band and tile; the folders' names come back as columns."""
    li = table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("band"), F.col("l_linestatus").alias("tile"), "l_quantity"
    )
    path = fresh_path(spark, "tiles")
    write_tiles(li, path, ["band", "tile"])
    found = spark.read.schema(li.schema).parquet(path).groupBy("band", "tile")
    return rounded(found.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("total")), 2)


@query("""
SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1
""")
def cached_result(spark, d):
    """A result that is built once: the second call reads it and ignores its builder."""
    path = fresh_path(spark, "cached")

    def counts(where: str):
        orders = table(spark, d, "orders").where(where)
        return orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))

    cached(spark, path, lambda: counts("true"))
    return cached(spark, path, lambda: counts("false"))


# --- projection ---------------------------------------------------------------------------

# WGS84 and the series of the projection in powers of the distance from the middle meridian: another
# form than the engine's, equal to a millimetre inside a zone.
UTM_SQL = """
SELECT *, 500000 + 0.9996 * nn * (aa + (1 - tt + cc) * aa ** 3 / 6
                + (5 - 18 * tt + tt * tt + 72 * cc - 58 * ep) * aa ** 5 / 120) AS x,
       0.9996 * (mm + nn * tan(phi) * (aa ** 2 / 2 + (5 - tt + 9 * cc + 4 * cc * cc) * aa ** 4 / 24
                + (61 - 58 * tt + tt * tt + 600 * cc - 330 * ep) * aa ** 6 / 720)) AS y
FROM (
  SELECT *, 6378137.0 / sqrt(1 - e2 * sin(phi) ** 2) AS nn, tan(phi) ** 2 AS tt, ep * cos(phi) ** 2 AS cc,
         radians(lon - (zone * 6 - 183)) * cos(phi) AS aa,
         6378137.0 * ((1 - e2 / 4 - 3 * e2 ** 2 / 64 - 5 * e2 ** 3 / 256) * phi
           - (3 * e2 / 8 + 3 * e2 ** 2 / 32 + 45 * e2 ** 3 / 1024) * sin(2 * phi)
           + (15 * e2 ** 2 / 256 + 45 * e2 ** 3 / 1024) * sin(4 * phi) - 35 * e2 ** 3 / 3072 * sin(6 * phi)) AS mm
  FROM (SELECT *, radians(lat) AS phi, 0.0066943799901413165 AS e2, 0.006739496742276434 AS ep FROM {points}))
"""


@query(f"""
WITH n AS (SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS code, -77.5 + n_nationkey % 5 AS x0,
                  30 + n_nationkey // 5 * 2.5 AS y0 FROM nation),
shape(kind, part, i, dx, dy) AS (VALUES
  ('F', 0, 0, 0.0, 0.0), ('F', 0, 1, 0.9, 0.0), ('F', 0, 2, 0.9, 2.2), ('F', 0, 3, 0.0, 2.2),
  ('F', 1, 0, 0.2, 0.5), ('F', 1, 1, 0.7, 0.5), ('F', 1, 2, 0.7, 1.5), ('F', 1, 3, 0.2, 1.5),
  ('T', 0, 0, 0.2, 0.5), ('T', 0, 1, 0.7, 0.5), ('T', 0, 2, 0.45, 1.5)),
corner AS (SELECT code || kind AS geoid, part, i, CAST(x0 + dx AS DOUBLE) AS lon, CAST(y0 + dy AS DOUBLE) AS lat,
                  18 AS zone FROM n, shape),
moved AS ({UTM_SQL.format(points="corner")}),
edge AS (SELECT geoid, x AS x1, y AS y1,
                coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2,
                coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2
         FROM moved WINDOW w AS (PARTITION BY geoid, part ORDER BY i)),
pt AS (SELECT o_orderkey, 250000.5 + o_orderkey * 7919 % 500000 AS x,
              3300000.5 + o_orderkey * 104729 % 1350000 AS y FROM orders)
SELECT geoid AS "GEOID", o_orderkey FROM edge, pt GROUP BY 1, 2
HAVING sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1
""")
def areas_from_file(spark, d):
    """Polygons in degrees, written in binary form, read, brought to a raster's system and joined."""
    k = F.col("n_nationkey")
    x0, y0 = (k % 5 - 77.5).cast("double"), (F.floor(k / 5) * 2.5 + 30).cast("double")

    def ring(*points):
        return F.array(*[F.struct((x0 + x).alias("x"), (y0 + y).alias("y")) for x, y in points])

    outer = ring((0.0, 0.0), (0.9, 0.0), (0.9, 2.2), (0.0, 2.2))
    hole = ring((0.2, 0.5), (0.7, 0.5), (0.7, 1.5), (0.2, 1.5))
    triangle = ring((0.2, 0.5), (0.7, 0.5), (0.45, 1.5))
    code = F.lpad(k.cast("string"), 2, "0")
    both = F.array(*[
        F.struct(F.concat(code, F.lit(kind)).alias("GEOID"), F.array(*rings).alias("rings"))
        for kind, rings in (("F", [outer, hole]), ("T", [triangle]))
    ])
    path = fresh_path(spark, "areas")
    with_geometry(table(spark, d, "nation").select(F.inline(both))).write.parquet(path)
    key = F.col("o_orderkey")
    points = table(spark, d, "orders").select(
        "o_orderkey", (key * 7919 % 500000 + 250000.5).alias("x"),
        (key * 104729 % 1350000 + 3300000.5).alias("y"),
    )
    met = pixels_in_areas(points, read_areas(spark, path, zone=18), "GEOID", 20_000.0)
    return met.select("GEOID", "o_orderkey")


@query(f"""
WITH scene AS (SELECT o_orderkey AS id, -125 + CAST(o_orderkey * 37 % 5500 AS DOUBLE) / 100 AS west,
                      25 + CAST(o_orderkey * 101 % 2300 AS DOUBLE) / 100 AS south FROM orders),
lons AS (SELECT id, south, unnest([west, west + 1] || [i * 0.25 FOR i IN range(
           CAST(ceil(west * 4) AS BIGINT), CAST(floor((west + 1) * 4) AS BIGINT) + 1)]) AS lon FROM scene),
points AS (SELECT id, lon, unnest([south, south + 1] || [i * 0.25 FOR i IN range(
             CAST(ceil(south * 4) AS BIGINT), CAST(floor((south + 1) * 4) AS BIGINT) + 1)]) AS lat FROM lons),
zoned AS (SELECT *, CAST(floor((lon + 180) / 6) AS INTEGER) + 1 AS zone FROM points),
moved AS ({UTM_SQL.format(points="zoned")}),
square AS (
  SELECT DISTINCT id, zone, floor(x / 100000) * 100000 AS x, floor(y / 100000) * 100000 AS y,
         lpad(CAST(zone AS VARCHAR), 2, '0')
         || substr('CDEFGHJKLMNPQRSTUVWX', CAST(floor((lat + 80) / 8) AS INTEGER) + 1, 1)
         || substr('ABCDEFGHJKLMNPQRSTUVWXYZ', (zone - 1) % 3 * 8 + CAST(floor(x / 100000) AS INTEGER), 1)
         || substr('ABCDEFGHJKLMNPQRSTUV', (CAST(floor(y / 100000) AS INTEGER) + CASE WHEN zone % 2 = 0 THEN 5 ELSE 0 END)
                   % 20 + 1, 1) AS tile
  FROM moved)
SELECT tile, 'EPSG:' || (32600 + zone) AS epsg, x, y, x + 100000 AS x2, y + 100000 AS y2, count(*) AS scenes
FROM square GROUP BY ALL
""")
def scene_tile_list(spark, d):
    """Grid tiles that orders in the role of scenes reach, with the number of scenes."""
    key = F.col("o_orderkey")
    west = (key * 37 % 5500).cast("double") / 100 - 125
    south = (key * 101 % 2300).cast("double") / 100 + 25
    scenes = table(spark, d, "orders").select(
        key.alias("id"), west.alias("west"), south.alias("south"), (west + 1).alias("east"),
        (south + 1).alias("north"),
    )
    return tiles.tile_list(scenes, "id", 0.25)


# --- vectors ------------------------------------------------------------------------------


@query("""
WITH e AS (SELECT vec_id, label, i - 1 AS pos,
                  CASE WHEN (vec_id + i) % 97 <> 0 THEN CAST(embedding[i] AS DOUBLE) END AS v
           FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
s AS (SELECT label, pos, min(v) / 2 + max(v) / 2 AS middle, max(v) / 254 - min(v) / 254 AS scale FROM e GROUP BY 1, 2),
c AS (SELECT vec_id, pos, v, middle, scale,
             CASE WHEN v IS NULL THEN -128 WHEN scale = 0 THEN 0
                  ELSE greatest(-127, least(127, CAST(floor((v - middle) / scale + 0.5) AS INTEGER))) END AS code
      FROM e JOIN s USING (label, pos))
SELECT vec_id, string_agg(lpad(to_hex((code + 256) % 256), 2, '0'), '' ORDER BY pos) AS codes,
       count(*) FILTER (code <> -128) AS n,
       count(*) FILTER (abs(middle + code * scale - v) > scale * 0.500001) AS n_far
FROM c GROUP BY vec_id
""")
def vector_bytes(spark, d):
    """Vectors as one byte per band and back, with holes; tiles are labels."""
    holes = F.transform(
        "embedding", lambda v, i: F.when((F.col("vec_id") + i + 1) % 97 != 0, v)
    )
    cells = table(spark, d, "embeddings").select("vec_id", "label", holes.alias("v"))
    scales = tiles.byte_scales(cells, ["label"], "v", DIMS)
    coded = tiles.to_bytes(cells, scales, ["label"], "v", DIMS)
    back = tiles.from_bytes(coded, scales, ["label"], "w", DIMS).select("vec_id", "w")
    both = coded.join(back, "vec_id").join(cells, ["vec_id", "label"]).join(scales, "label")
    far = F.transform(F.arrays_zip("v", "w", "scale"), lambda z: F.abs(z["v"] - z["w"]) > z["scale"] * 0.500001)
    return both.select(
        "vec_id", F.hex("codes").alias("codes"), F.size(F.array_compact("w")).cast("long").alias("n"),
        F.size(F.filter(far, lambda x: x)).cast("long").alias("n_far"),
    )


DIRECTION_SQL = """
u AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda z: CAST(z AS DOUBLE) * CAST(z AS DOUBLE)))) AS length
      FROM embeddings),
m AS (SELECT {keys}, i - 1 AS pos, avg(CAST(embedding[i] AS DOUBLE) / length) AS v
      FROM u, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT {names}, CAST(pos AS INTEGER) AS pos, round(v / sqrt(sum(v * v) OVER (PARTITION BY {names})), 6) AS value FROM m
"""


@query("WITH " + DIRECTION_SQL.format(keys="label", names="label"))
def label_directions(spark, d):
    """Mean directions of the labels' vectors, at length one."""
    found = mean_direction(table(spark, d, "embeddings"), "label", "embedding", DIMS)
    return rounded(vector_rows(found, ["label"], "embedding"))


@query(
    "WITH RECURSIVE z(level) AS (VALUES (2), (4)), "
    + DIRECTION_SQL.replace("FROM embeddings)", "FROM embeddings, z)").format(
        keys='level, CAST(vec_id // 20 // level AS INTEGER) AS "row", CAST(vec_id % 20 // level AS INTEGER) AS col',
        names='level, "row", col',
    )
)
def direction_overviews(spark, d):
    """Overviews of a vector map, each cell at length one."""
    cells = table(spark, d, "embeddings").select(
        F.floor(F.col("vec_id") / 20).cast("int").alias("row"), (F.col("vec_id") % 20).cast("int").alias("col"),
        F.col("embedding").alias("vector"),
    )
    found = tiles.vector_overviews(cells, DIMS, (2, 4))
    return rounded(vector_rows(found, ["level", "row", "col"], "vector"))
