"""Sources, keys and survey preparation on the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from areascope.functions.keys import (
    in_registry,
    index_labels,
    make_geoid,
    map_default,
    map_or_self,
    pad_geoid,
    state_of,
)
from areascope.functions.scalars import (
    area_label,
    complement,
    safe_ratio,
    sum_skipnull,
    sum_strict,
    utm_epsg,
)
from areascope.operators.joins import (
    available,
    cross_specs,
    keep_keys,
    keys_minus,
    outer_assemble,
    union_all,
)
from areascope.operators.survey import (
    cols_like,
    complete_cases,
    complete_cases_long,
    latest,
    null_sentinels,
    pivot_names,
    pivot_unique,
    prefer_year,
    rename_map,
    to_percent,
    to_percent_long,
)
from areascope.queries.base import query, rounded
from areascope.sources.scenes import select_scenes
from areascope.sources.survey_pages import assemble_survey, parse_api_pages, plan_requests
from areascope.sources.tables import pending, table

SUPPRESSED = -666666666.0


def survey_long(spark, d):
    """Quantity per part and return flag; cells of under five lines are suppressed by code."""
    cell = table(spark, d, "lineitem").groupBy("l_partkey", "l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q")
    )
    return cell.select(
        "l_partkey",
        F.concat(F.lit("qty_"), "l_returnflag").alias("variable"),
        F.when(F.col("n") < 5, SUPPRESSED).otherwise(F.col("q")).alias("value"),
    )


SURVEY_SQL = """
cell AS (
  SELECT l_partkey, 'qty_' || l_returnflag AS variable,
         CASE WHEN count(*) < 5 THEN NULL ELSE sum(l_quantity) END AS value
  FROM lineitem GROUP BY l_partkey, l_returnflag),
every AS (
  SELECT l_partkey, sum(l_quantity) AS value FROM lineitem GROUP BY l_partkey)
"""


def survey_wide(spark, d):
    """Survey with one column per variable, plus the universe."""
    long = survey_long(spark, d)
    wide = pivot_unique(long, ["l_partkey"], "variable", "value", pivot_names(long, "variable"))
    universe = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("qty_all")
    )
    return wide.join(universe, "l_partkey")


@query(f"""
WITH {SURVEY_SQL}
SELECT c.l_partkey, c.variable || '_pct' AS variable,
       round(c.value / e.value * 100, 6) AS value
FROM cell c JOIN every e ON c.l_partkey = e.l_partkey
""")
def share_of_universe(spark, d):
    """Long percentages of a universe, suppressed cells missing."""
    long = null_sentinels(survey_long(spark, d), ["value"])
    universe = table(spark, d, "lineitem").groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("value")
    ).withColumn("variable", F.lit("qty_all"))
    flags = table(spark, d, "lineitem").select("l_returnflag").distinct()
    specs = flags.select(
        F.concat(F.lit("qty_"), "l_returnflag").alias("numerator"),
        F.lit("qty_all").alias("denominator"),
        F.concat(F.lit("qty_"), "l_returnflag", F.lit("_pct")).alias("name"),
    )
    out = to_percent_long(union_all(long, universe), specs, ["l_partkey"], "variable", "value")
    # a part without lines of a flag has no row in the survey: keep the cells it has
    have = long.select("l_partkey", F.concat("variable", F.lit("_pct")).alias("variable"))
    return rounded(keep_keys(out, have, ["l_partkey", "variable"]))


@query("""
WITH cell AS (
  SELECT l_partkey, l_returnflag, CASE WHEN count(*) < 5 THEN NULL ELSE sum(l_quantity) END AS v
  FROM lineitem GROUP BY l_partkey, l_returnflag),
every AS (SELECT l_partkey, sum(l_quantity) AS u FROM lineitem GROUP BY l_partkey),
w AS (
  SELECT e.l_partkey, max(CASE WHEN l_returnflag = 'A' THEN v END) / u * 100 AS a,
         max(CASE WHEN l_returnflag = 'N' THEN v END) / u * 100 AS n,
         max(CASE WHEN l_returnflag = 'R' THEN v END) / u * 100 AS r
  FROM every e LEFT JOIN cell c ON e.l_partkey = c.l_partkey GROUP BY e.l_partkey, u)
SELECT l_partkey AS part, round(a, 6) AS accepted_pct, round(n, 6) AS neither_pct,
       round(r, 6) AS returned_pct,
       round(coalesce(a, 0) + coalesce(n, 0) + coalesce(r, 0), 6) AS total_any,
       round(a + n + r, 6) AS total_all, round(100 - a, 6) AS not_accepted,
       round(CASE WHEN n > 0 THEN a / n END, 6) AS ratio
FROM w
""")
def composites_wide(spark, d):
    """Sentinels to null, names, percentages and composite columns on a wide survey."""
    wide = survey_wide(spark, d)
    wide = null_sentinels(wide, cols_like(wide, "qty_"))
    wide = rename_map(
        wide, {"l_partkey": "part", "qty_A": "accepted", "qty_N": "neither", "qty_R": "returned",
               "qty_X": "absent"}
    )
    specs = [(c, "qty_all", f"{c}_pct") for c in ("accepted", "neither", "returned", "absent")]
    wide = to_percent(wide, specs, ["qty_all"])
    parts = [F.col(c) for c in cols_like(wide, suffix="_pct")]
    return rounded(
        wide.withColumns(
            {
                "total_any": sum_skipnull(parts),
                "total_all": sum_strict(parts),
                "not_accepted": complement(F.col("accepted_pct")),
                "ratio": safe_ratio(F.col("accepted_pct"), F.col("neither_pct")),
            }
        )
    )


@query("""
SELECT l_partkey, 'qty_' || l_returnflag AS variable, count(*) < 5 AS suppressed,
       CASE WHEN count(*) < 5 THEN NULL ELSE round(sum(l_quantity), 6) END AS value
FROM lineitem GROUP BY l_partkey, l_returnflag
""")
def sentinel_null(spark, d):
    """Suppression codes become missing."""
    raw = survey_long(spark, d)
    flagged = raw.withColumn("suppressed", F.col("value") == SUPPRESSED)
    return rounded(null_sentinels(flagged, ["value"]))


@query("""
SELECT e.user_id, coalesce(n.n_name, 'Unknown') AS division,
       coalesce(n.n_name, CAST(e.user_id AS VARCHAR)) AS label, count(*) AS n
FROM events e LEFT JOIN nation n ON e.user_id = n.n_nationkey
GROUP BY 1, 2, 3
""")
def map_lookup(spark, d):
    """Dictionary lookups with a default and with the key itself as fallback."""
    dim = table(spark, d, "nation").withColumn("n_nationkey", F.col("n_nationkey").cast("bigint"))
    ev = table(spark, d, "events").select("user_id")
    ev = map_default(ev, "user_id", dim, "n_nationkey", "n_name", "division")
    ev = map_or_self(ev, "user_id", dim, "n_nationkey", "n_name", "label")
    return ev.groupBy("user_id", "division", "label").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT p.p_partkey, coalesce(m.indices, '') AS indices
FROM part p LEFT JOIN (
  SELECT p_name, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS indices
  FROM part GROUP BY p_name) m ON p.p_name = m.p_name
""")
def index_names(spark, d):
    """Set membership shown as sorted text."""
    part = table(spark, d, "part")
    members = part.select(F.col("p_name").alias("variable"), F.col("p_type").alias("index"))
    return index_labels(part.select("p_partkey", "p_name"), "p_name", members).select(
        "p_partkey", "indices"
    )


@query("""
SELECT c_custkey,
       CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 11
            THEN lpad(CAST(c_custkey AS VARCHAR), 11, '0') ELSE CAST(c_custkey AS VARCHAR) END AS geoid,
       lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
         || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS tract,
       lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state
FROM customer
""")
def pad_keys(spark, d):
    """Zero-padded, concatenated and shortened keys."""
    c = table(spark, d, "customer")
    tract = make_geoid(
        pad_geoid(F.col("c_nationkey"), 2), pad_geoid(F.col("c_custkey") % 1000, 3),
        pad_geoid(F.col("c_custkey"), 6),
    )
    return c.select(
        "c_custkey", pad_geoid(F.col("c_custkey")).alias("geoid"), tract.alias("tract")
    ).withColumn("state", state_of(F.col("tract")))


@query("""
WITH a AS (SELECT o_custkey AS k, count(*) AS n_orders FROM orders
           WHERE o_orderstatus = 'F' GROUP BY 1),
b AS (SELECT o_custkey AS k, round(sum(o_totalprice), 4) AS spent FROM orders
      WHERE o_orderpriority = '1-URGENT' GROUP BY 1),
c AS (SELECT c_custkey AS k, c_acctbal AS balance FROM customer WHERE c_acctbal > 0)
SELECT coalesce(a.k, b.k, c.k) AS k, n_orders, spent, balance
FROM a FULL JOIN b ON a.k = b.k FULL JOIN c ON coalesce(a.k, b.k) = c.k
""")
def outer_join_frames(spark, d):
    """Full outer join of three frames on one key in one aggregate."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(
        F.count(F.lit(1)).alias("n_orders")
    )
    b = o.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("k")).agg(
        F.round(F.sum("o_totalprice"), 4).alias("spent")
    )
    e = c.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance")
    )
    return outer_assemble([a, b, e], "k", [["n_orders"], ["spent"], ["balance"]])


def survey_page_table(spark, d, endpoint: str = "all"):
    """Answers of a survey API made of the customer table: 50 areas to a page."""
    c = table(spark, d, "customer")
    balance = F.when(F.col("c_custkey") % 10 == 3, "N/A").otherwise(F.col("c_acctbal").cast("string"))
    row = F.array(
        F.col("c_name"), balance, F.length("c_mktsegment").cast("string"),
        pad_geoid(F.col("c_nationkey"), 2), pad_geoid(F.col("c_custkey") % 1000, 3),
        pad_geoid(F.col("c_custkey"), 6),
    )
    header = F.array(*[F.lit(h) for h in ("NAME", "BAL", "SEG", "state", "county", "tract")])
    # pages are cut by key, so none holds more than 50 areas
    return (
        c.groupBy(F.floor(F.col("c_custkey") / 50).alias("page"))
        .agg(F.collect_list(row).alias("rows"))
        .select("page", F.to_json(F.concat(F.array(header), F.col("rows"))).alias("body"))
    )


PAGES_SQL = """
areas AS (
  SELECT lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0')
         || lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS geoid, c_name AS name,
         CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE c_acctbal END AS bal,
         CAST(length(c_mktsegment) AS DOUBLE) AS seg
  FROM customer)
"""


@query(f"""
WITH {PAGES_SQL}
SELECT geoid, name, 'BAL' AS variable, bal AS value FROM areas
UNION ALL SELECT geoid, name, 'SEG', seg FROM areas
""")
def api_pages(spark, d):
    """JSON pages to long rows: header from the page, bad numbers missing."""
    return parse_api_pages(survey_page_table(spark, d))


@query(f"""
WITH {PAGES_SQL}
SELECT geoid AS "GEOID", name AS "NAME", bal AS "BAL", seg AS "SEG" FROM areas
""")
def api_survey(spark, d):
    """Pages to one wide row per area."""
    return assemble_survey(parse_api_pages(survey_page_table(spark, d)), ["BAL", "SEG"])


@query("""
WITH v AS (
  SELECT 'supplier' AS endpoint, s_name AS variable, s_suppkey AS position, true AS named FROM supplier
  UNION ALL SELECT 'part', p_brand || '-' || CAST(p_partkey AS VARCHAR), p_partkey, false FROM part),
c AS (
  SELECT endpoint, CAST(position // 49 AS INTEGER) AS chunk, bool_or(named) AS named,
         string_agg(variable, ',' ORDER BY position) AS vs
  FROM v GROUP BY 1, 2)
SELECT endpoint, chunk, n_name AS state,
       CASE WHEN named AND chunk = 0 THEN 'NAME,' || vs ELSE vs END AS "get"
FROM c CROSS JOIN nation
""")
def request_plan(spark, d):
    """Variables cut into requests of at most 49, for every state."""
    s = table(spark, d, "supplier").select(
        F.lit("supplier").alias("endpoint"), F.col("s_name").alias("variable"),
        F.col("s_suppkey").alias("position"), F.lit(True).alias("named"),
    )
    p = table(spark, d, "part").select(
        F.lit("part").alias("endpoint"),
        F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string")).alias("variable"),
        F.col("p_partkey").alias("position"), F.lit(False).alias("named"),
    )
    states = table(spark, d, "nation").select(F.col("n_name").alias("state"))
    return plan_requests(union_all(s, p), states)


@query("""
WITH x AS (SELECT o_custkey, year(o_orderdate) AS y, o_totalprice FROM orders),
k AS (SELECT DISTINCT o_custkey FROM x WHERE y = 1996)
SELECT o_custkey, y AS year, count(*) AS n, round(avg(o_totalprice), 6) AS value
FROM x WHERE y = 1996 OR (y = 1997 AND o_custkey NOT IN (SELECT o_custkey FROM k))
GROUP BY 1, 2
""")
def prefer_year_choice(spark, d):
    """Rows of 1996 for the measures it has, of 1997 for the others."""
    o = table(spark, d, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), "o_totalprice"
    )
    return rounded(
        prefer_year(o, "o_custkey", "year", 1996, 1997)
        .groupBy("o_custkey", F.col("year").cast("bigint").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg("o_totalprice").alias("value"))
    )


def measures_long(spark, d):
    """One value per customer, priority and year."""
    return table(spark, d, "orders").groupBy(
        "o_custkey", F.col("o_orderpriority").alias("measure"),
        F.year("o_orderdate").alias("year"),
    ).agg(F.avg("o_totalprice").alias("value"))


@query("""
WITH x AS (
  SELECT o_custkey, o_orderpriority AS m, avg(o_totalprice) AS v FROM orders
  WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1, 2)
SELECT o_custkey, round(max(CASE WHEN m = '1-URGENT' THEN v END), 6) AS "1-URGENT",
       round(max(CASE WHEN m = '2-HIGH' THEN v END), 6) AS "2-HIGH",
       round(max(CASE WHEN m = '3-MEDIUM' THEN v END), 6) AS "3-MEDIUM",
       round(max(CASE WHEN m = '4-NOT SPECIFIED' THEN v END), 6) AS "4-NOT SPECIFIED",
       round(max(CASE WHEN m = '5-LOW' THEN v END), 6) AS "5-LOW"
FROM x GROUP BY 1
""")
def pivot_latest(spark, d):
    """Measures of the latest year, one column each."""
    last = latest(measures_long(spark, d), "year")
    return rounded(
        pivot_unique(last, ["o_custkey"], "measure", "value", pivot_names(last, "measure"))
    )


@query("""
WITH x AS (SELECT o_custkey, year(o_orderdate) AS year, o_orderpriority AS m, avg(o_totalprice) AS v
           FROM orders GROUP BY 1, 2, 3),
w AS (SELECT o_custkey, year, round(max(CASE WHEN m = '1-URGENT' THEN v END), 6) AS urgent,
             round(max(CASE WHEN m = '2-HIGH' THEN v END), 6) AS high,
             round(max(CASE WHEN m = '3-MEDIUM' THEN v END), 6) AS medium,
             round(max(CASE WHEN m = '4-NOT SPECIFIED' THEN v END), 6) AS unstated,
             round(max(CASE WHEN m = '5-LOW' THEN v END), 6) AS low FROM x GROUP BY 1, 2)
SELECT CAST(year AS INTEGER) AS year, * EXCLUDE (year) FROM w
WHERE urgent + high + medium + unstated + low IS NOT NULL
""")
def complete_case_rows(spark, d):
    """Wide rows of customers and years with every measure there."""
    names = {
        "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium",
        "4-NOT SPECIFIED": "unstated", "5-LOW": "low",
    }
    wide = pivot_unique(
        measures_long(spark, d), ["o_custkey", "year"], "measure", "value", list(names)
    )
    wide = rename_map(wide, names)
    return rounded(complete_cases(wide, available(wide.columns, [*names.values(), "absent"])))


@query("""
WITH x AS (SELECT o_custkey, o_orderpriority AS measure, avg(o_totalprice) AS value FROM orders
           GROUP BY 1, 2),
f AS (SELECT o_custkey FROM x GROUP BY 1
      HAVING count(*) = (SELECT count(DISTINCT measure) FROM x))
SELECT o_custkey, measure, round(value, 6) AS value FROM x
WHERE o_custkey IN (SELECT o_custkey FROM f)
""")
def complete_case_long(spark, d):
    """The same without widening."""
    x = table(spark, d, "orders").groupBy(
        "o_custkey", F.col("o_orderpriority").alias("measure")
    ).agg(F.avg("o_totalprice").alias("value"))
    return rounded(complete_cases_long(x, "o_custkey", "measure", "value"))


@query("""
SELECT c_custkey AS k FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
""")
def pending_units(spark, d):
    """Units whose output is not finished."""
    units = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_custkey").alias("k")
    )
    return pending(units, done, "k")


@query("""
SELECT DISTINCT o_custkey AS k, true AS only_early FROM orders
WHERE year(o_orderdate) = 1995
  AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 2001)
""")
def key_difference(spark, d):
    """Keys one year has and another lacks."""
    o = table(spark, d, "orders").select(
        F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y")
    )
    gone = keys_minus(o.where("y = 1995"), o.where("y = 2001"), "k")
    return gone.withColumn("only_early", F.lit(True))


@query("""
SELECT o_orderkey AS scene_id, CAST(strftime(o_orderdate, '%Y-%m-%d') AS VARCHAR) AS day,
       round(o_totalprice % 100, 4) AS cloud
FROM orders
WHERE o_custkey % 360 - 180 <= -60 AND o_custkey % 360 - 179 >= -130
  AND o_orderkey % 90 <= 50 AND o_orderkey % 90 + 1 >= 24
  AND o_orderdate >= TIMESTAMP '1997-03-01' AND o_orderdate < TIMESTAMP '1997-06-01'
  AND round(o_totalprice % 100, 4) < 80
""")
def scene_search(spark, d):
    """Scenes over a box and period with cloud cover strictly below the limit."""
    west = F.col("o_custkey") % 360 - 180
    south = F.col("o_orderkey") % 90
    scenes = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("scene_id"), F.col("o_orderdate").alias("ts"),
        F.round(F.col("o_totalprice") % 100, 4).alias("cloud_cover"),
        west.alias("west"), south.alias("south"), (west + 1).alias("east"),
        (south + 1).alias("north"),
    )
    found = select_scenes(scenes, (-130.0, 24.0, -60.0, 50.0), "1997-03-01", "1997-05-31")
    return found.select(
        "scene_id", F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("cloud_cover").alias("cloud"),
    )


@query("""
SELECT c_custkey, 'EPSG:' || CAST(32601 + CAST(floor(((c_custkey % 360 - 180) * 2 + 3) / 2.0 / 6.0 + 30.0) AS BIGINT) AS VARCHAR) AS epsg,
       CASE WHEN c_custkey / 100.0 >= 1
            THEN CAST(CAST(round_even(c_custkey / 100.0, 0) AS BIGINT) AS VARCHAR) || ' km²'
            ELSE CAST(CAST(round_even(c_custkey / 100.0 * 100, 0) AS BIGINT) AS VARCHAR) || ' ha' END AS label
FROM customer
""")
def zone_and_label(spark, d):
    """Map zone from a box and readable area."""
    west = (F.col("c_custkey") % 360 - 180).cast("double")
    return table(spark, d, "customer").select(
        "c_custkey", utm_epsg(west, west + 3).alias("epsg"),
        area_label(F.col("c_custkey") / F.lit(100.0)).alias("label"),
    )


@query("""
SELECT o.p AS outcome, s.p_type AS model FROM (SELECT DISTINCT o_orderpriority AS p FROM orders) o
CROSS JOIN (SELECT DISTINCT p_type FROM part) s
""")
def sweep_list(spark, d):
    """Work list of a sweep: every outcome with every predictor set."""
    outcomes = table(spark, d, "orders").select(F.col("o_orderpriority").alias("outcome")).distinct()
    sets = table(spark, d, "part").select(F.col("p_type").alias("model")).distinct()
    return cross_specs(outcomes, sets)


@query("""
WITH o AS (SELECT o_custkey AS k, avg(o_totalprice) AS price FROM orders GROUP BY 1),
s AS (SELECT s_suppkey AS k, s_acctbal AS extra FROM supplier)
SELECT c.c_custkey AS k, round(price, 6) AS price, extra
FROM customer c JOIN o ON o.k = c_custkey LEFT JOIN s ON s.k = c_custkey
""")
def merged_areas(spark, d):
    """Areas in both tables, with a third table's columns where it has them."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(
        F.avg("o_totalprice").alias("price")
    )
    s = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("extra")
    )
    return rounded(c.join(o, "k", "inner").join(s, "k", "left"))


@query("""
SELECT l_partkey, 'qty_' || l_returnflag AS variable, round(sum(l_quantity), 4) AS value
FROM lineitem WHERE 'qty_' || l_returnflag IN (SELECT 'qty_' || o_orderstatus FROM orders)
   OR l_returnflag = 'R'
GROUP BY 1, 2
""")
def registry_variables(spark, d):
    """Variables a registry lists."""
    listed = union_all(
        table(spark, d, "orders").select(F.concat(F.lit("qty_"), "o_orderstatus").alias("variable")),
        spark.createDataFrame([("qty_R",)], "variable string"),
    )
    long = table(spark, d, "lineitem").groupBy(
        "l_partkey", F.concat(F.lit("qty_"), "l_returnflag").alias("variable")
    ).agg(F.sum("l_quantity").alias("value"))
    return rounded(in_registry(long, "variable", listed), 4)
