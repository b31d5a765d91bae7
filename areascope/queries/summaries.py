"""Counts, ranks, deciles, distributions, order and samples on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from areascope.functions.ranking import exact_quantiles, grouped_stats, percentile_rank
from areascope.functions.vectors import mean_pool, vector_rows, weighted_mean
from areascope.functions.keys import map_default, pad_geoid, state_of, tract_of
from areascope.operators import stats
from areascope.operators.panel import (
    complete_panel,
    drop_incomplete,
    trajectories,
    trajectory_ends,
)
from areascope.queries.base import QUERIES, query, rounded
from areascope.sources.tables import table

DIMS = 64


def block_groups(spark, d):
    """Embedding rows as block groups: a 12-digit key whose first two digits are the state."""
    e = table(spark, d, "embeddings")
    key = F.concat(
        pad_geoid(F.col("label"), 2), pad_geoid(F.floor(F.col("vec_id") / 4), 9),
        (F.col("vec_id") % 4).cast("string"),
    )
    return e.select(
        "vec_id", key.alias("census_block_group"), F.col("embedding").alias("vector"),
        (F.col("vec_id") % 7 + 1).cast("double").alias("area_km2"),
    )


TRACT_SQL = """
bg AS (
  SELECT vec_id, lpad(CAST(label AS VARCHAR), 2, '0') || lpad(CAST(vec_id // 4 AS VARCHAR), 9, '0') AS tract,
         CAST(vec_id % 7 + 1 AS DOUBLE) AS w, embedding AS v FROM embeddings),
el AS (SELECT tract, w, i - 1 AS pos, CAST(v[i] AS DOUBLE) AS x
       FROM bg, (SELECT unnest(range(1, 65)) AS i))
"""


def tracts(spark, d):
    bg = block_groups(spark, d).withColumn("tract", tract_of(F.col("census_block_group")))
    bg = bg.withColumn("state", state_of(F.col("tract")))
    return weighted_mean(bg, "tract", "vector", "area_km2", DIMS, "total_area", ["state"])


@query(f"""
WITH {TRACT_SQL}
SELECT tract, substr(tract, 1, 2) AS state, CAST(pos AS INTEGER) AS pos,
       round(sum(x * w) / sum(w), 6) AS value, sum(w) AS total_area
FROM el GROUP BY tract, pos
""")
def weighted_tract_mean(spark, d):
    """Area-weighted mean vectors of tracts."""
    return rounded(vector_rows(tracts(spark, d), ["tract", "state", "total_area"], "vector"))


@query(f"""
WITH {TRACT_SQL},
t AS (SELECT DISTINCT tract FROM el)
SELECT coalesce(r.r_name, 'Unknown') AS division, count(*) AS n
FROM t LEFT JOIN nation n ON CAST(substr(t.tract, 1, 2) AS INTEGER) = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY 1
""")
def tracts_by_division(spark, d):
    """State of a tract looked up in a division table."""
    states = table(spark, d, "nation").join(
        table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(pad_geoid(F.col("n_nationkey"), 2).alias("code"), "r_name")
    named = map_default(tracts(spark, d), "state", states, "code", "r_name", "division")
    return stats.count_by(named, ["division"])


@query("""
SELECT label, CAST(i - 1 AS INTEGER) AS pos, round(avg(CAST(embedding[i] AS DOUBLE)), 6) AS value
FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY label, i
""")
def mean_vectors(spark, d):
    """Mean-pooled vectors per group."""
    pooled = mean_pool(table(spark, d, "embeddings"), "label", "embedding", DIMS)
    return rounded(vector_rows(pooled, ["label"], "embedding"))


@query("""
SELECT vec_id, label FROM embeddings WHERE vec_id % 17 <> 0 AND vec_id % 19 <> 0
""")
def complete_vectors(spark, d):
    """Vectors with a null or NaN element are dropped (holes are made by position first)."""
    holes = F.transform(
        "embedding",
        lambda x, i: F.when((F.col("vec_id") % 17 == 0) & (i == F.col("vec_id") % 64), None)
        .when((F.col("vec_id") % 19 == 0) & (i == F.col("vec_id") % 64), F.lit(float("nan")))
        .otherwise(x),
    )
    e = table(spark, d, "embeddings").withColumn("embedding", holes)
    return drop_incomplete(e, "embedding").select("vec_id", "label")


@query("""
SELECT p_partkey,
  round((rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0)
        / count(*) OVER () * 100, 6) AS price_nr,
  round((rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0)
        / count(*) OVER () * 100, 6) AS size_nr
FROM part
""")
def national_rank(spark, d):
    """Percentile ranks with averaged ties."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    p = percentile_rank(p, "p_retailprice", "price_nr")
    p = percentile_rank(p, "p_size", "size_nr")
    return rounded(p.select("p_partkey", "price_nr", "size_nr"))


DECILE_SQL = """
edges AS (SELECT quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e
          FROM lineitem),
dec AS (SELECT l_extendedprice AS x, l_discount AS v,
               1 + len(list_filter(e, lambda q: q < l_extendedprice)) AS decile
        FROM lineitem, edges)
"""


@query(f"""
WITH {DECILE_SQL}
SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, round(median(x), 6) AS median_x,
       round(avg(v), 6) AS mean_v FROM dec GROUP BY decile
""")
def area_deciles(spark, d):
    """Deciles by interior edges, with the median inside each."""
    li = stats.area_decile(table(spark, d, "lineitem"), "l_extendedprice")
    base = [F.count(F.lit(1)).alias("n"), F.avg("l_discount").alias("mean_v")]
    out = grouped_stats(li, ["decile"], "l_extendedprice", base, [0.5])
    return rounded(out.select("decile", "n", F.col("q")[0].alias("median_x"), "mean_v"))


@query(f"""
WITH {DECILE_SQL}
SELECT CAST(decile AS INTEGER) AS decile, round(median(v), 6) AS median_v FROM dec GROUP BY decile
""")
def decile_medians(spark, d):
    """Median of another column inside every decile."""
    li = stats.area_decile(table(spark, d, "lineitem"), "l_extendedprice")
    return rounded(stats.median_by(li, ["decile"], "l_discount", "median_v"))


@query("""
WITH q AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e
           FROM orders)
SELECT CAST(i - 1 AS INTEGER) AS pos, round(e[i], 6) AS edge
FROM q, (SELECT unnest(range(1, 12)) AS i)
""")
def decile_edges(spark, d):
    """Interpolated percentile edges."""
    edges = stats.percentile_edges(table(spark, d, "orders"), "o_totalprice")
    return rounded(edges.select(F.posexplode("edges").alias("pos", "edge")))


@query("""
WITH s AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 50.0::DOUBLE)) AS INTEGER), 49) AS bin
      FROM orders, s),
n AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(i AS INTEGER) AS bin, round(lo + i * ((hi - lo) / 50.0::DOUBLE), 4) AS low,
       round(lo + (i + 1) * ((hi - lo) / 50.0::DOUBLE), 4) AS high, coalesce(n, 0) AS n
FROM s, (SELECT unnest(range(0, 50)) AS i) LEFT JOIN n ON n.bin = i
""")
def price_histogram(spark, d):
    """Fifty equal bins."""
    return rounded(stats.histogram(table(spark, d, "orders"), "o_totalprice", 50), 4)


@query("""
SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS min,
       max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS q1,
       round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.75), 4) AS q3
FROM orders GROUP BY 1
""")
def measure_distribution(spark, d):
    """Shape of a value per measure."""
    return rounded(
        stats.distribution(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice"), 4
    )


@query("""
SELECT 'l_quantity' AS "column", count(l_quantity) AS count, count(*) - count(l_quantity) AS missing,
       round(avg(l_quantity), 4) AS mean, round(stddev_pop(l_quantity), 4) AS std,
       min(l_quantity) AS min, max(l_quantity) AS max FROM lineitem
UNION ALL
SELECT 'l_extendedprice', count(l_extendedprice), count(*) - count(l_extendedprice),
       round(avg(l_extendedprice), 4), round(stddev_pop(l_extendedprice), 4),
       min(l_extendedprice), max(l_extendedprice) FROM lineitem
""")
def describe_columns(spark, d):
    """Summary of chosen columns in one pass."""
    return rounded(stats.describe(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice"]), 4)


@query("""
SELECT min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       round(median(l_extendedprice), 4) AS median FROM lineitem
""")
def global_range(spark, d):
    """Smallest, largest and median value of a table."""
    return rounded(stats.range_and_median(table(spark, d, "lineitem"), "l_extendedprice"), 4)


@query("""
SELECT (SELECT count(*) FROM (SELECT DISTINCT o_custkey FROM orders)) AS n
""")
def distinct_customers(spark, d):
    """Exact distinct count."""
    return stats.n_distinct(table(spark, d, "orders"), "o_custkey", "n")


@query("SELECT DISTINCT p_brand, p_type FROM part")
def sorted_values(spark, d):
    """Distinct values in order."""
    return stats.distinct_sorted(table(spark, d, "part"), ["p_brand", "p_type"])


PANEL_SQL = """
panel AS (SELECT o_custkey, year(o_orderdate) AS year, avg(o_totalprice) AS value
          FROM orders GROUP BY 1, 2)
"""


def panel(spark, d):
    return table(spark, d, "orders").groupBy(
        "o_custkey", F.year("o_orderdate").cast("bigint").alias("year")
    ).agg(F.avg("o_totalprice").alias("value"))


@query(f"""
WITH {PANEL_SQL},
f AS (SELECT o_custkey FROM panel GROUP BY 1
      HAVING count(DISTINCT year) = (SELECT count(DISTINCT year) FROM panel))
SELECT o_custkey, year, round(value, 6) AS value FROM panel
WHERE o_custkey IN (SELECT o_custkey FROM f)
""")
def panel_complete(spark, d):
    """Units observed in every year."""
    return rounded(complete_panel(panel(spark, d), "o_custkey", "year"))


@query(f"""
WITH {PANEL_SQL}
SELECT o_custkey, min(year) AS first_year, max(year) AS last_year,
       round(arg_min(value, year), 6) AS first_value, round(arg_max(value, year), 6) AS last_value
FROM panel GROUP BY 1
""")
def panel_ends(spark, d):
    """First and last year of each unit with its values."""
    return rounded(trajectory_ends(panel(spark, d), "o_custkey", "year", ["value"]))


@query(f"""
WITH {PANEL_SQL}
SELECT o_custkey, year, round(value, 6) AS value,
       year = min(year) OVER (PARTITION BY o_custkey) AS is_first,
       year = max(year) OVER (PARTITION BY o_custkey) AS is_last
FROM panel
""")
def panel_trajectories(spark, d):
    """All rows by unit and year, ends marked."""
    return rounded(trajectories(panel(spark, d), "o_custkey", "year"))


SCORE_SQL = """
s AS (SELECT l_suppkey, avg(l_extendedprice) AS score FROM lineitem GROUP BY 1)
"""


def scores(spark, d):
    """Mean price of each supplier; sums of decimals, so equal means are equal in any order of rows."""
    total = F.sum(F.col("l_extendedprice").cast("decimal(28,10)")).cast("double")
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        (total / F.count("l_extendedprice")).alias("score")
    )


@query(f"""
WITH {SCORE_SQL}
(SELECT l_suppkey, round(score, 4) AS score, 'best' AS "end" FROM s ORDER BY s.score DESC, l_suppkey LIMIT 3)
UNION ALL
(SELECT l_suppkey, round(score, 4), 'worst' FROM s ORDER BY s.score, l_suppkey LIMIT 3)
""")
def best_and_worst(spark, d):
    """The three best and worst by score."""
    return rounded(stats.best_worst(scores(spark, d), "score", "l_suppkey"), 4)


@query(f"""
WITH {SCORE_SQL}
SELECT c.s_suppkey AS l_suppkey, s_acctbal,
       CAST(row_number() OVER (ORDER BY s.score, md5(CAST(s.l_suppkey AS VARCHAR))) AS INTEGER) AS position
FROM supplier c JOIN s ON s.l_suppkey = c.s_suppkey
""")
def custom_order(spark, d):
    """Rows in the order another result gives their keys."""
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    ordered = stats.order_like(sup, "l_suppkey", scores(spark, d), "score")
    return ordered.withColumn("position", F.col("position").cast("int"))


@query("""
SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20
""")
def top_orders(spark, d):
    """Top rows of a report."""
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return stats.top_k(o, [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)


@query("""
SELECT o_custkey FROM (SELECT DISTINCT o_custkey FROM orders)
ORDER BY md5(CAST(o_custkey AS VARCHAR) || '-42'), o_custkey LIMIT 20
""")
def sampled_units(spark, d):
    """Twenty groups drawn by seed."""
    return stats.sample_groups(table(spark, d, "orders"), "o_custkey", 42, k=20)


@query("""
SELECT vec_id, label FROM embeddings
QUALIFY row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id)
        <= greatest(40, CAST(floor(count(*) OVER () * 0.05) AS BIGINT))
""")
def sampled_rows(spark, d):
    """max(20·k, 5 %) rows drawn by seed."""
    e = table(spark, d, "embeddings").select("vec_id", "label")
    return stats.sample_rows(e, "vec_id", 20 * 2, 0.05, 42)


@query("""
SELECT s_suppkey, s_acctbal,
       CAST((row_number() OVER (ORDER BY s_acctbal, md5(CAST(s_suppkey AS VARCHAR))) - 1) // 10 AS INTEGER) AS page,
       CAST((row_number() OVER (ORDER BY s_acctbal, md5(CAST(s_suppkey AS VARCHAR))) - 1) % 10 AS INTEGER) AS slot
FROM supplier
""")
def pages_of_ten(spark, d):
    """A sorted list cut into pages."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    return _pages(s)


@query("""
SELECT c_nationkey, count(*) AS n_all, count(*) FILTER (c_acctbal > 0) AS n_positive
FROM customer GROUP BY 1 HAVING count(*) >= 50 AND count(*) FILTER (c_acctbal > 0) >= 45
""")
def size_gate(spark, d):
    """Groups with enough rows, and enough that meet a condition."""
    c = table(spark, d, "customer")
    return stats.gate(
        c, ["c_nationkey"], {"n_all": (F.lit(True), 50), "n_positive": (F.col("c_acctbal") > 0, 45)}
    )


@query("""
SELECT l_partkey FROM lineitem GROUP BY 1 HAVING stddev_pop(l_quantity) >= 1e-6
""")
def varying_targets(spark, d):
    """Targets that are not constant."""
    return stats.varies(table(spark, d, "lineitem"), ["l_partkey"], "l_quantity")


def _pages(s, **more):
    paged = stats.paginate(s, "s_acctbal", "s_suppkey", 10, **more)
    return paged.withColumn("page", F.col("page").cast("int"))


@query(QUERIES["pages_of_ten"].sql)
def pages_bucketed(spark, d):
    """The same pages by the way meant for large tables: buckets of few rows."""
    columns = QUERIES["pages_of_ten"].build(spark, d).columns
    s = table(spark, d, "supplier").select([c for c in columns if c not in ("page", "slot")])
    return _pages(s, rows_per_bucket=3).select(columns)


@query(QUERIES["sampled_rows"].sql)
def sampled_rows_bucketed(spark, d):
    """The same sample by hash buckets of few rows."""
    columns = QUERIES["sampled_rows"].build(spark, d).columns
    e = table(spark, d, "embeddings")
    return stats.sample_rows(e, "vec_id", 20 * 2, 0.05, 42, rows_per_bucket=7).select(columns)


@query(QUERIES["national_rank"].sql)
def national_rank_bucketed(spark, d):
    """The same ranks by counted buckets of few rows."""
    p = table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size")
    p = percentile_rank(p, "p_retailprice", "price_nr", rows_per_bucket=9)
    p = percentile_rank(p, "p_size", "size_nr", rows_per_bucket=9)
    return rounded(p.select("p_partkey", "price_nr", "size_nr"))


@query(QUERIES["custom_order"].sql)
def custom_order_bucketed(spark, d):
    """The same order by buckets of few rows."""
    sup = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_acctbal")
    ordered = stats.order_like(sup, "l_suppkey", scores(spark, d), "score", rows_per_bucket=3)
    return ordered.withColumn("position", F.col("position").cast("int"))


@query(QUERIES["sampled_units"].sql)
def sampled_units_bucketed(spark, d):
    """The same groups by ranks in hash buckets of few rows."""
    orders = table(spark, d, "orders")
    return stats.sample_groups(orders, "o_custkey", 42, k=20, top_rows=0, rows_per_bucket=25)


@query(QUERIES["decile_edges"].sql)
def decile_edges_bucketed(spark, d):
    """The same edges from the buckets that hold a wanted rank."""
    edges = stats.percentile_edges(table(spark, d, "orders"), "o_totalprice", rows_per_bucket=500)
    return rounded(edges.select(F.posexplode("edges").alias("pos", "edge")))


@query(QUERIES["decile_medians"].sql)
def decile_medians_bucketed(spark, d):
    """The same medians per group; a value (a discount) is shared by a tenth of the rows."""
    li = stats.area_decile(table(spark, d, "lineitem"), "l_extendedprice", rows_per_bucket=2000)
    found = exact_quantiles(li, ["decile"], "l_discount", [0.5], "q", 300)
    return rounded(found.select("decile", F.col("q")[0].alias("median_v")))
