"""Splits, sweeps, ridge and principal components on the driver tables.

Areas are customers: state = nation, outcomes = mean order price per priority (missing where a
customer has no such order), indices = account balance, number of orders, mean order month.
The SQL of the vector models solves the ridge systems by elimination in a recursive query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from areascope.operators import sweeps
from areascope.operators.correlation import pairwise_corr
from areascope.operators.design import design
from areascope.operators.folds import group_folds, holdout, row_folds, with_group_folds
from areascope.operators.joins import lookup_join
from areascope.operators.learners import fit_predict
from areascope.operators.logistic import count_people, counted, held_out_logistic
from areascope.operators.panel import lagged_change
from areascope.operators.projection import Projection, pca_apply, pca_fit, pca_fit_sample
from areascope.operators.stats import area_decile, fold_summary, r2_score
from areascope.operators.survey import pivot_unique
from areascope.operators.sweeps import Model
from areascope.queries.base import QUERIES, query, rounded
from areascope.queries.summaries import DIMS
from areascope.session import checkpoint_dir, materialise
from areascope.sources.tables import table

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
OUTCOMES = ["urgent", "high", "medium", "unspecified", "low"]


def area_table(spark, d):
    """The area table, written once: splits, edges and sums all read it."""
    return materialise(build_areas(spark, d))


def build_areas(spark, d):
    """One row per customer with orders: key, state, outcomes and indices."""
    orders = table(spark, d, "orders")
    cells = orders.groupBy("o_custkey", "o_orderpriority").agg(F.avg("o_totalprice").alias("v"))
    wide = pivot_unique(cells, ["o_custkey"], "o_orderpriority", "v", PRIORITIES)
    wide = wide.withColumnsRenamed(dict(zip(PRIORITIES, OUTCOMES, strict=True)))
    index = orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).cast("double").alias("n_orders"),
        F.avg(F.month("o_orderdate")).alias("mean_month"),
        F.avg("o_totalprice").alias("mean_price"),
    )
    people = table(spark, d, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("state"),
        F.col("c_acctbal").alias("balance"),
    )
    return people.join(index, "o_custkey").join(wide, "o_custkey").withColumnRenamed(
        "o_custkey", "area"
    )


AREA_SQL = """
area AS (
  SELECT c_custkey AS area, c_nationkey AS state, c_acctbal AS balance,
         CAST(count(*) AS DOUBLE) AS n_orders, avg(month(o_orderdate)) AS mean_month,
         avg(o_totalprice) AS mean_price,
         avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') AS urgent,
         avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS high,
         avg(o_totalprice) FILTER (o_orderpriority = '3-MEDIUM') AS medium,
         avg(o_totalprice) FILTER (o_orderpriority = '4-NOT SPECIFIED') AS unspecified,
         avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS low
  FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3)
"""

SPLIT_SQL = f"""
{AREA_SQL},
st AS (SELECT state, row_number() OVER (ORDER BY md5(CAST(state AS VARCHAR) || '-42'), state)
              <= greatest(1, round_even(0.2 * count(*) OVER (), 0)) AS test
       FROM (SELECT DISTINCT state FROM area)),
split AS (SELECT area.*, st.test FROM area JOIN st USING (state))
"""

LONG_SQL = """
long AS (UNPIVOT (SELECT {keep}, urgent, high, medium, unspecified, low FROM {source})
         ON urgent, high, medium, unspecified, low INTO NAME outcome VALUE y)
"""


def long_sql(source: str, keep: str) -> str:
    return LONG_SQL.format(source=source, keep=keep)


# --- held-out groups ----------------------------------------------------------------------


@query(f"""
WITH {SPLIT_SQL},
fit AS (SELECT regr_slope(balance, mean_price) AS b, regr_intercept(balance, mean_price) AS a,
               count(*) AS n_train FROM split WHERE NOT test)
SELECT n_train, count(*) AS n_test,
       round(1 - sum((balance - a - b * mean_price) ** 2) / (var_pop(balance) * count(*)), 6) AS r2,
       round(avg(abs(balance - a - b * mean_price)), 4) AS mae
FROM split, fit WHERE test GROUP BY n_train
""")
def holdout_index_r2(spark, d):
    """How well one area index explains an outcome in states it was not fitted on."""
    index = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.avg("o_totalprice").alias("x")
    )
    joined = table(spark, d, "customer").join(index, "c_custkey").select(
        F.col("c_nationkey").alias("state"), F.col("c_acctbal").alias("y"), "x"
    )
    areas = holdout(materialise(joined), "state")
    line = areas.where("NOT test").agg(
        F.regr_slope("y", "x").alias("b"), F.regr_intercept("y", "x").alias("a"),
        F.count(F.lit(1)).alias("n_train"),
    )
    predicted = areas.where("test").crossJoin(F.broadcast(line)).withColumn(
        "p", F.col("a") + F.col("b") * F.col("x")
    )
    scored = r2_score(predicted, "y", "p", ["n_train"])
    return scored.select(
        "n_train", F.col("n").alias("n_test"), F.round("r2", 6).alias("r2"),
        F.round("mae", 4).alias("mae"),
    )


@query(f"""
WITH {SPLIT_SQL}
SELECT state, test, count(*) AS n FROM split GROUP BY 1, 2
""")
def holdout_states(spark, d):
    """Held-out share of states."""
    split = holdout(area_table(spark, d), "state")
    return split.groupBy("state", "test").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH RECURSIVE sizes AS (
  SELECT c_nationkey AS g, count(*) AS size,
         row_number() OVER (ORDER BY count(*) DESC, c_nationkey DESC) AS i
  FROM customer GROUP BY 1),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS g, CAST(NULL AS INTEGER) AS fold,
         [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT s.i, s.g, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
         list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads))
                                                 THEN v + s.size ELSE v END)
  FROM walk w JOIN sizes s ON s.i = w.i + 1)
SELECT g AS c_nationkey, fold FROM walk WHERE i > 0
""")
def state_folds(spark, d):
    """Groups put whole into the lightest of five folds, largest first."""
    return group_folds(table(spark, d, "customer"), "c_nationkey", 5)


@query("""
SELECT c_custkey, CAST((row_number() OVER (PARTITION BY c_nationkey
         ORDER BY md5(CAST(c_custkey AS VARCHAR) || '-42'), c_custkey) - 1) % 2 AS INTEGER) AS fold
FROM customer
""")
def shuffled_folds(spark, d):
    """Two shuffled folds inside every state."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return row_folds(c, "c_custkey", 2, 42, ["c_nationkey"]).select("c_custkey", "fold")


# --- sweeps with one feature (SQL says the same) ------------------------------------------

FOLD5_SQL = f"""
{AREA_SQL},
f AS (SELECT *, CAST((row_number() OVER (ORDER BY md5(CAST(area AS VARCHAR) || '-42'), area) - 1) % 5
                     AS INTEGER) AS fold FROM area),
{long_sql("f", "area, fold, mean_price")},
fits AS (
  SELECT t.fold, t.outcome, regr_slope(l.y, l.mean_price) AS b, regr_intercept(l.y, l.mean_price) AS a
  FROM (SELECT DISTINCT fold, outcome FROM long) t
  JOIN long l ON l.outcome = t.outcome AND l.fold <> t.fold GROUP BY 1, 2),
sc AS (
  SELECT l.outcome, l.fold, count(*) AS n,
         1 - sum((y - a - b * mean_price) ** 2) / (var_pop(y) * count(*)) AS r2
  FROM long l JOIN fits USING (fold, outcome) GROUP BY 1, 2)
"""

TRAINING = "NOT test"
LINE = Model("price", ("price",), alpha=0.0)


@query(f"""
WITH {FOLD5_SQL}
SELECT outcome, 'price' AS model, round(avg(r2), 5) AS r2_mean, round(stddev_pop(r2), 5) AS r2_std,
       CAST(sum(n) AS BIGINT) AS n
FROM sc GROUP BY 1
""")
def cv_r2_line(spark, d):
    """Five-fold R² of a line, every outcome in one pass."""
    areas = row_folds(area_table(spark, d), "area", 5, 42)
    rows, layout = design(areas, ["fold"], OUTCOMES, numeric={"price": ["mean_price"]})
    return rounded(sweeps.cv_r2(rows, layout, [LINE]), 5)


@query(f"""
WITH {FOLD5_SQL}
SELECT outcome, round(avg(r2), 5) AS r2_mean, round(stddev_pop(r2), 5) AS r2_std
FROM sc GROUP BY 1
""")
def fold_means(spark, d):
    """Mean and spread over folds."""
    areas = row_folds(area_table(spark, d), "area", 5, 42)
    rows, layout = design(areas, ["fold"], OUTCOMES, numeric={"price": ["mean_price"]})
    scores = sweeps.fold_scores(rows, layout, [LINE])
    return rounded(fold_summary(scores, ["outcome"], "r2"), 5)


@query(f"""
WITH RECURSIVE {AREA_SQL},
{long_sql("area", "area, state, mean_price")},
sizes AS (SELECT outcome, state AS g, count(*) AS size,
                 row_number() OVER (PARTITION BY outcome ORDER BY count(*) DESC, state DESC) AS i
          FROM long GROUP BY 1, 2),
walk AS (
  SELECT DISTINCT outcome, CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS g, CAST(NULL AS INTEGER) AS fold,
         [0, 0, 0, 0, 0]::BIGINT[] AS loads FROM sizes
  UNION ALL
  SELECT s.outcome, s.i, s.g, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
         list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads))
                                                 THEN v + s.size ELSE v END)
  FROM walk w JOIN sizes s ON s.i = w.i + 1 AND s.outcome = w.outcome),
f AS (SELECT long.*, fold FROM long JOIN walk ON g = state AND walk.outcome = long.outcome),
fits AS (SELECT t.fold, t.outcome, regr_slope(l.y, l.mean_price) AS b, regr_intercept(l.y, l.mean_price) AS a
         FROM (SELECT DISTINCT fold, outcome FROM f) t
         JOIN f l ON l.outcome = t.outcome AND l.fold <> t.fold GROUP BY 1, 2),
sc AS (SELECT f.outcome, fold, count(*) AS n, 1 - sum((y - a - b * mean_price) ** 2) / (var_pop(y) * count(*)) AS r2
       FROM f JOIN fits USING (fold, outcome) GROUP BY 1, 2)
SELECT outcome, 'price' AS model, round(avg(r2), 5) AS r2_mean, round(stddev_pop(r2), 5) AS r2_std,
       CAST(sum(n) AS BIGINT) AS n
FROM sc GROUP BY 1 HAVING sum(n) >= 100
""")
def cv_r2_target_folds(spark, d):
    """Five folds of whole states, laid for each outcome on its own rows."""
    rows, layout = design(area_table(spark, d), ["state"], OUTCOMES, numeric={"price": ["mean_price"]})
    return rounded(sweeps.cv_r2_per_target(rows, layout, [LINE], "state"), 5)


BINS_SQL = f"""
{SPLIT_SQL},
{long_sql("split", "area, test, mean_price, balance")},
pe AS (SELECT quantile_cont(mean_price, [0.25, 0.5, 0.75]) AS e FROM split WHERE NOT test),
be AS (SELECT quantile_cont(balance, [0.25, 0.5, 0.75]) AS e FROM split WHERE NOT test),
marked AS (
  SELECT outcome, test, y, 'price' AS model, len(list_filter(pe.e, lambda q: q < mean_price)) AS bin FROM long, pe
  UNION ALL
  SELECT outcome, test, y, 'balance', len(list_filter(be.e, lambda q: q < balance)) FROM long, be),
means AS (SELECT outcome, model, bin, avg(y) AS p FROM marked WHERE NOT test GROUP BY 1, 2, 3),
overall AS (SELECT outcome, model, avg(y) AS o, count(*) AS n_train FROM marked WHERE NOT test GROUP BY 1, 2),
pred AS (SELECT m.*, coalesce(p, o) AS p, n_train FROM marked m
         JOIN overall USING (outcome, model) LEFT JOIN means USING (outcome, model, bin) WHERE test)
"""


@query(f"""
WITH {BINS_SQL}
SELECT outcome, model, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2,
       n_train, count(*) AS n_test
FROM pred GROUP BY outcome, model, n_train HAVING n_train >= 100 AND count(*) >= 50
""")
def compare_index_bins(spark, d):
    """Two indices, each as a step function, compared on held-out states."""
    areas = holdout(area_table(spark, d), "state")
    rows, layout = design(
        areas, ["test"], OUTCOMES, binned={"price": "mean_price", "balance": "balance"}, bins=4,
        train=TRAINING,
    )
    models = [Model("price", ("price",), "bins"), Model("balance", ("balance",), "bins")]
    return rounded(sweeps.compare_sets(rows, layout, models), 5)


@query(f"""
WITH {SPLIT_SQL},
{long_sql("split", "area, test, mean_price, balance, n_orders")},
e AS (SELECT quantile_cont(mean_price, [0.25, 0.5, 0.75]) AS e FROM split WHERE NOT test),
marked AS (SELECT outcome, test, y, n_orders, len(list_filter(e.e, lambda q: q < mean_price)) AS bin
           FROM long, e),
means AS (SELECT outcome, bin, avg(y) AS p FROM marked WHERE NOT test GROUP BY 1, 2),
overall AS (SELECT outcome, avg(y) AS o, count(*) AS n_train FROM marked WHERE NOT test GROUP BY 1),
res AS (SELECT m.*, y - coalesce(p, o) AS res, n_train FROM marked m JOIN overall USING (outcome)
        LEFT JOIN means USING (outcome, bin)),
line AS (SELECT outcome, regr_slope(res, n_orders) AS b, regr_intercept(res, n_orders) AS a
         FROM res WHERE NOT test GROUP BY 1),
s AS (SELECT outcome, n_train, count(*) AS n_test,
             1 - sum(res ** 2) / (var_pop(y) * count(*)) AS r2_index,
             1 - sum((res - a - b * n_orders) ** 2) / (var_pop(res) * count(*)) AS r2_residual
      FROM res JOIN line USING (outcome) WHERE test GROUP BY 1, 2
      HAVING n_train >= 100 AND count(*) >= 50)
SELECT 'price' AS "index", outcome, round(r2_index, 5) AS r2_index, round(r2_residual, 5) AS r2_residual,
       round(greatest(0, r2_residual) * greatest(0, 1 - r2_index), 5) AS additional_var, n_train, n_test
FROM s
""")
def residual_line(spark, d):
    """Step function of an index first, a line on its residual second."""
    areas = holdout(area_table(spark, d), "state")
    rows, layout = design(
        areas, ["test"], OUTCOMES, numeric={"orders": ["n_orders"]},
        binned={"price": "mean_price"}, bins=4, train=TRAINING,
    )
    return rounded(
        sweeps.residual_r2(
            rows, layout, [Model("price", ("price",), "bins")],
            Model("orders", ("orders",), alpha=0.0),
        ),
        5,
    )


def sweep_sql(group: str, source: str, base: str) -> str:
    return f"""
WITH {base},
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY {group}
          ORDER BY md5(CAST(area AS VARCHAR) || '-42'), area) - 1) % 2 AS INTEGER) AS fold FROM {source}),
{long_sql("f", f"area, fold, {group}, mean_price, balance")},
big AS (SELECT {group}, outcome FROM long GROUP BY 1, 2 HAVING count(*) >= 50),
pairs AS (SELECT outcome, fold, {group}, y, 'price' AS model, mean_price AS x FROM long JOIN big USING ({group}, outcome)
         UNION ALL SELECT outcome, fold, {group}, y, 'balance', balance FROM long JOIN big USING ({group}, outcome)),
line AS (SELECT {group}, outcome, model, 1 - fold AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a
         FROM pairs GROUP BY 1, 2, 3, 4),
sc AS (SELECT {group}, outcome, model, fold, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2
       FROM pairs JOIN line USING ({group}, outcome, model, fold) GROUP BY 1, 2, 3, 4),
m AS (SELECT {group}, outcome, model, avg(r2) AS r2 FROM sc GROUP BY 1, 2, 3),
n AS (SELECT {group}, count(*) AS n_tracts FROM {source} GROUP BY 1 HAVING count(*) >= 50)
SELECT {group}, round(avg(r2) FILTER (model = 'price'), 5) AS r2_price,
       round(avg(r2) FILTER (model = 'balance'), 5) AS r2_balance,
       count(DISTINCT outcome) AS n_outcomes, n_tracts
FROM m JOIN n USING ({group}) GROUP BY {group}, n_tracts
"""


PAIR = [Model("price", ("price",), alpha=0.0), Model("balance", ("balance",), alpha=0.0)]


@query(sweep_sql("state", "area", AREA_SQL))
def sweep_states(spark, d):
    """Two-fold R² of two indices inside every state, averaged over outcomes."""
    areas = row_folds(area_table(spark, d), "area", 2, 42, ["state"])
    rows, layout = design(
        areas, ["state", "fold"], OUTCOMES,
        numeric={"price": ["mean_price"], "balance": ["balance"]},
    )
    return rounded(sweeps.sweep_by(rows, layout, PAIR, "state"), 5)


DEC_SQL = f"""
{AREA_SQL},
de AS (SELECT quantile_cont(n_orders, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM area),
deciled AS (SELECT area.*, CAST(1 + len(list_filter(e, lambda q: q < n_orders)) AS INTEGER) AS decile
            FROM area, de)
"""


@query(sweep_sql("decile", "deciled", DEC_SQL))
def sweep_deciles(spark, d):
    """The same inside every decile of area size."""
    areas = area_decile(area_table(spark, d), "n_orders")
    areas = row_folds(areas, "area", 2, 42, ["decile"])
    rows, layout = design(
        areas, ["decile", "fold"], OUTCOMES,
        numeric={"price": ["mean_price"], "balance": ["balance"]},
    )
    return rounded(sweeps.sweep_by(rows, layout, PAIR, "decile"), 5)


@query(f"""
WITH {SPLIT_SQL},
t AS (SELECT mean_price AS x1, n_orders AS x2, balance AS y FROM split WHERE NOT test),
m AS (SELECT avg(x1) AS m1, avg(x2) AS m2, avg(y) AS my,
             var_pop(x1) * count(*) + 1 AS s11, var_pop(x2) * count(*) + 1 AS s22,
             covar_pop(x1, x2) * count(*) AS s12, covar_pop(x1, y) * count(*) AS c1,
             covar_pop(x2, y) * count(*) AS c2 FROM t),
w AS (SELECT (c1 * s22 - c2 * s12) / (s11 * s22 - s12 * s12) AS b1,
             (c2 * s11 - c1 * s12) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM m)
SELECT area, test, round(my + b1 * (mean_price - m1) + b2 * (n_orders - m2), 4) AS prediction
FROM split, w
""")
def ridge_pair(spark, d):
    """Ridge on two predictors: closed form, intercept not penalised."""
    areas = holdout(area_table(spark, d), "state").withColumn("train", ~F.col("test"))
    out = fit_predict(areas, ["mean_price", "n_orders"], "balance", "train", "ridge")
    return rounded(out.select("area", "test", "prediction"), 4)


@query(f"""
WITH {SPLIT_SQL},
e AS (SELECT quantile_cont(mean_price, [0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]) AS e
      FROM split WHERE NOT test AND urgent IS NOT NULL),
b AS (SELECT area, test, urgent, len(list_filter(e, lambda q: q < mean_price)) AS bin FROM split, e),
p AS (SELECT bin, avg(urgent) AS p FROM b WHERE NOT test AND urgent IS NOT NULL GROUP BY 1),
o AS (SELECT avg(urgent) AS o FROM b WHERE NOT test)
SELECT area, test, round(coalesce(p, o), 4) AS prediction FROM b LEFT JOIN p USING (bin), o
""")
def bins_fit(spark, d):
    """Step function of one predictor, fitted on training states."""
    areas = holdout(area_table(spark, d), "state").withColumn("train", ~F.col("test"))
    out = fit_predict(areas, ["mean_price"], "urgent", "train", "bins", bins=8)
    return rounded(out.select("area", "test", "prediction"), 4)


# --- the same on 64-dimensional vectors ----------------------------------------------------


def vector_areas(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("area"), "embedding")
    return materialise(build_areas(spark, d).join(e, "area"))


def holed(areas):
    """Areas with holes in the vectors: null and NaN elements, and whole vectors missing."""
    a = F.col("area")

    def hole(e, i):
        place = F.when(a % 3 == 0, (a + i) % 5)
        return F.when(place == 0, F.lit(None)).when(place == 1, F.lit(float("nan"))).otherwise(
            e.cast("double")
        )

    return areas.withColumn("embedding", F.when(a % 50 != 7, F.transform("embedding", hole)))


def vector_design(areas, keep):
    return design(
        areas, keep, OUTCOMES, vector=("embedding", DIMS),
        numeric={"size": ["n_orders", "mean_month"]},
        binned={"price": "mean_price", "balance": "balance", "month": "mean_month"}, bins=8,
        train=TRAINING if "test" in keep else None,
    )


EMBEDDINGS = Model("emb", ("vector", "size"))
INDICES = [
    Model("price", ("price",), "bins"), Model("balance", ("balance",), "bins"),
    Model("month", ("month",), "bins"),
]

EIGHTHS = "[0.125, 0.25, 0.375, 0.5, 0.625, 0.75, 0.875]"

ELEMENT = "CAST(embedding[i] AS DOUBLE)"
HOLED = f"""CASE WHEN area % 50 <> 7 AND NOT (area % 3 = 0 AND (area + i - 1) % 5 < 2)
                 THEN {ELEMENT} END"""


def vector_sql(split: str = "", fitted: str = "va", element: str = ELEMENT) -> str:
    """va: areas with vectors; feat: features of each ridge model; bin: bin of each index.
    Means, stds and edges come from the rows of `fitted`, which `split` may define."""
    return f"""
{AREA_SQL},
va AS (SELECT area.*, embedding FROM area JOIN embeddings ON vec_id = area),
{split}
fitted AS (SELECT * FROM {fitted}),
el AS (SELECT area, i AS f, {element} AS x FROM va, (SELECT unnest(range(1, 65)) AS i)
       UNION ALL SELECT area, 65, n_orders FROM va UNION ALL SELECT area, 66, mean_month FROM va),
sc AS (SELECT f, avg(x) AS m, stddev_pop(x) AS s FROM el WHERE area IN (SELECT area FROM fitted) GROUP BY f),
emb AS (SELECT area, f, coalesce((x - m) / s, 0) AS x FROM el JOIN sc USING (f)
        UNION ALL SELECT area, 67, max(CASE WHEN x IS NULL THEN 1.0::DOUBLE ELSE 0.0 END) FROM el
        WHERE f <= 64 GROUP BY area),
ed AS (SELECT quantile_cont(mean_price, {EIGHTHS}) AS p, quantile_cont(balance, {EIGHTHS}) AS b,
              quantile_cont(mean_month, {EIGHTHS}) AS m FROM fitted),
bin AS (
  SELECT area, 'price' AS model, len(list_filter(p, lambda q: q < mean_price)) AS bin FROM va, ed
  UNION ALL SELECT area, 'balance', len(list_filter(b, lambda q: q < balance)) FROM va, ed
  UNION ALL SELECT area, 'month', len(list_filter(m, lambda q: q < mean_month)) FROM va, ed),
marks AS (
  SELECT area, k + 1 + CASE model WHEN 'price' THEN 0 WHEN 'balance' THEN 8 ELSE 16 END AS f,
         CASE WHEN bin = k THEN 1.0::DOUBLE ELSE 0.0 END AS x
  FROM bin, (SELECT unnest(range(0, 8)) AS k)),
feat AS (
  SELECT 'emb' AS model, area, f, x FROM emb
  UNION ALL SELECT 'all indices', area, f, x FROM marks
  UNION ALL SELECT 'all indices + emb', area, f, x FROM emb
  UNION ALL SELECT 'all indices + emb', area, f + 67, x FROM marks)
"""


VECTOR_SQL = vector_sql()

# Ridge with penalty 1 by elimination: src(model, sys, area, test, y) -> pred(..., p).
SOLVE_SQL = """
mx AS (SELECT model, sys, f, avg(x) AS m FROM src JOIN feat USING (model, area) WHERE NOT test
       GROUP BY ALL),
my AS (SELECT model, sys, avg(y) AS m FROM src WHERE NOT test GROUP BY ALL),
cx AS (SELECT model, sys, area, f, x - mx.m AS x, y - my.m AS y
       FROM src JOIN feat USING (model, area) JOIN mx USING (model, sys, f) JOIN my USING (model, sys)
       WHERE NOT test),
g AS (SELECT a.model, a.sys, a.f AS i, b.f AS j,
             sum(a.x * b.x) + max(CASE WHEN a.f = b.f THEN 1 ELSE 0 END) AS v
      FROM cx a JOIN cx b ON a.model = b.model AND a.sys = b.sys AND a.area = b.area
      GROUP BY a.model, a.sys, a.f, b.f),
rr AS (SELECT model, sys, f AS i, sum(x * y) AS v FROM cx GROUP BY ALL),
aug AS (SELECT model, sys, i, list_append(list(g.v ORDER BY j), any_value(rr.v)) AS r
        FROM g JOIN rr USING (model, sys, i) GROUP BY model, sys, i),
elim AS (
  SELECT model, sys, 0 AS k, i, r FROM aug
  UNION ALL
  SELECT e.model, e.sys, e.k + 1, e.i,
         CASE WHEN e.i = e.k + 1 THEN list_transform(e.r, lambda v: v / p.r[e.k + 1])
              ELSE list_transform(list_zip(e.r, p.r),
                                  lambda z: z[1] - z[2] * e.r[e.k + 1] / p.r[e.k + 1]) END
  FROM elim e JOIN elim p
    ON p.model = e.model AND p.sys = e.sys AND p.i = e.k + 1 AND e.k < len(e.r) - 1),
w AS (SELECT model, sys, i AS f, r[len(r)] AS b FROM elim WHERE k = len(r) - 1),
pred AS (SELECT model, sys, area, test, any_value(y) AS y, any_value(my.m) + sum((x - mx.m) * b) AS p
         FROM src JOIN feat USING (model, area) JOIN mx USING (model, sys, f)
         JOIN my USING (model, sys) JOIN w USING (model, sys, f)
         GROUP BY model, sys, area, test)
"""

VECTOR_STATES_SQL = """
st AS (SELECT state, row_number() OVER (ORDER BY md5(CAST(state AS VARCHAR) || '-42'), state)
              <= greatest(1, round_even(0.2 * count(*) OVER (), 0)) AS test
       FROM (SELECT DISTINCT state FROM va)),
split AS (SELECT va.*, st.test FROM va JOIN st USING (state)),
"""


def vector_split_sql(element: str = ELEMENT) -> str:
    return f"""
{vector_sql(VECTOR_STATES_SQL, "split WHERE NOT test", element)},
{long_sql("split", "area, test")},
size AS (SELECT outcome, count(*) FILTER (NOT test) AS n_train, count(*) FILTER (test) AS n_test
         FROM long GROUP BY 1 HAVING count(*) FILTER (NOT test) >= 100 AND count(*) FILTER (test) >= 50),
mean AS (SELECT outcome, model, bin, avg(y) AS p FROM long JOIN bin USING (area) WHERE NOT test
         GROUP BY ALL),
overall AS (SELECT outcome, avg(y) AS o FROM long WHERE NOT test GROUP BY ALL),
step AS (SELECT bin.model, outcome, area, test, y, coalesce(p, o) AS p
         FROM long JOIN bin USING (area) JOIN overall USING (outcome)
         LEFT JOIN mean USING (outcome, model, bin))
"""


VECTOR_SPLIT_SQL = vector_split_sql()


def cv_sql(vectors: str) -> str:
    return f"""
WITH RECURSIVE {vectors},
sizes AS (SELECT state AS g, count(*) AS size,
                 row_number() OVER (ORDER BY count(*) DESC, state DESC) AS i FROM va GROUP BY 1),
walk AS (
  SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS INTEGER) AS g, CAST(NULL AS INTEGER) AS fold,
         [0, 0, 0, 0, 0]::BIGINT[] AS loads
  UNION ALL
  SELECT s.i, s.g, CAST(list_position(loads, list_min(loads)) - 1 AS INTEGER),
         list_transform(loads, lambda v, j: CASE WHEN j = list_position(loads, list_min(loads))
                                                 THEN v + s.size ELSE v END)
  FROM walk w JOIN sizes s ON s.i = w.i + 1),
folded AS (SELECT va.*, fold FROM va JOIN walk ON g = state),
{long_sql("folded", "area, fold")},
src AS (SELECT 'emb' AS model, outcome || k AS sys, area, fold = k AS test, y
        FROM long, (SELECT unnest(range(0, 5)) AS k)),
{SOLVE_SQL},
one AS (SELECT sys, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2, count(*) AS n
        FROM pred WHERE test GROUP BY sys)
SELECT sys[:-2] AS outcome, 'emb' AS model, round(avg(r2), 5) AS r2_mean,
       round(stddev_pop(r2), 5) AS r2_std, CAST(sum(n) AS BIGINT) AS n
FROM one GROUP BY 1
"""


@query(cv_sql(VECTOR_SQL))
def cv_r2_vectors(spark, d):
    """Group-fold R² of the vectors for every outcome."""
    areas = with_group_folds(vector_areas(spark, d), "state", 5)
    rows, layout = vector_design(areas, ["fold"])
    return rounded(sweeps.cv_r2(rows, layout, [EMBEDDINGS]), 5)


@query(cv_sql(vector_sql(element=HOLED)))
def cv_r2_holes(spark, d):
    """The same with missing elements and missing vectors."""
    areas = with_group_folds(holed(vector_areas(spark, d)), "state", 5)
    rows, layout = vector_design(areas, ["fold"])
    return rounded(sweeps.cv_r2(rows, layout, [EMBEDDINGS]), 5)


def compare_sql(vectors: str) -> str:
    return f"""
WITH RECURSIVE {vectors},
src AS (SELECT m AS model, outcome AS sys, area, test, y
        FROM long, (SELECT unnest(['emb', 'all indices', 'all indices + emb']) AS m)),
{SOLVE_SQL},
every AS (SELECT model, sys AS outcome, test, y, p FROM pred
          UNION ALL SELECT model, outcome, test, y, p FROM step)
SELECT outcome, model, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2, n_train, n_test
FROM every JOIN size USING (outcome) WHERE test GROUP BY outcome, model, n_train, n_test
"""


@query(compare_sql(VECTOR_SPLIT_SQL))
def compare_six_sets(spark, d):
    """Each index, all indices, vectors, and both, on held-out states."""
    return six_sets(vector_areas(spark, d))


@query(compare_sql(vector_split_sql(HOLED)))
def compare_holes(spark, d):
    """The same with missing elements and missing vectors."""
    return six_sets(holed(vector_areas(spark, d)))


def six_sets(areas):
    rows, layout = vector_design(holdout(areas, "state"), ["test"])
    names = ("price", "balance", "month")
    models = [
        *INDICES, Model("all indices", names), EMBEDDINGS,
        Model("all indices + emb", (*names, "vector", "size")),
    ]
    return rounded(sweeps.compare_sets(rows, layout, models), 5)


@query(f"""
WITH RECURSIVE {VECTOR_SPLIT_SQL},
src AS (SELECT 'emb' AS model, model || '|' || outcome AS sys, area, test, y - p AS y FROM step),
{SOLVE_SQL},
one AS (SELECT model AS "index", outcome, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2_index
        FROM step WHERE test GROUP BY 1, 2),
two AS (SELECT sys, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2_residual
        FROM pred WHERE test GROUP BY 1)
SELECT "index", outcome, round(r2_index, 5) AS r2_index, round(r2_residual, 5) AS r2_residual,
       round(greatest(0, r2_residual) * greatest(0, 1 - r2_index), 5) AS additional_var,
       n_train, n_test
FROM one JOIN two ON sys = "index" || '|' || outcome JOIN size USING (outcome)
""")
def residual_vectors(spark, d):
    """What the vectors explain of the residual each index leaves."""
    rows, layout = vector_design(holdout(vector_areas(spark, d), "state"), ["test"])
    return rounded(sweeps.residual_r2(rows, layout, INDICES, EMBEDDINGS), 5)


def vector_sweep_sql(group: str, extra: str) -> str:
    return f"""
WITH RECURSIVE {VECTOR_SQL},
{extra}
f AS (SELECT *, CAST((row_number() OVER (PARTITION BY {group}
          ORDER BY md5(CAST(area AS VARCHAR) || '-42'), area) - 1) % 2 AS INTEGER) AS fold FROM grouped),
{long_sql("f", f"area, fold, {group}")},
big AS (SELECT {group}, outcome FROM long GROUP BY 1, 2 HAVING count(*) >= 10),
halves AS (SELECT {group}, outcome, area, fold = k AS test, y, k FROM long JOIN big USING ({group}, outcome),
           (SELECT unnest([0, 1]) AS k)),
src AS (SELECT 'emb' AS model, {group} || '|' || outcome || '|' || k AS sys, area, test, y FROM halves),
{SOLVE_SQL},
mean AS (SELECT {group}, outcome, k, model, bin, avg(y) AS p FROM halves JOIN bin USING (area)
         WHERE NOT test GROUP BY ALL),
overall AS (SELECT {group}, outcome, k, avg(y) AS o FROM halves WHERE NOT test GROUP BY ALL),
every AS (
  SELECT bin.model, {group} || '|' || outcome || '|' || k AS sys, y, coalesce(p, o) AS p
  FROM halves JOIN bin USING (area) JOIN overall USING ({group}, outcome, k)
  LEFT JOIN mean USING ({group}, outcome, k, model, bin) WHERE test
  UNION ALL SELECT model, sys, y, p FROM pred WHERE test),
sc1 AS (SELECT model, sys, 1 - sum((y - p) ** 2) / (var_pop(y) * count(*)) AS r2 FROM every GROUP BY 1, 2),
avg1 AS (SELECT model, CAST(split_part(sys, '|', 1) AS INTEGER) AS {group},
                split_part(sys, '|', 2) AS outcome, avg(r2) AS r2 FROM sc1 GROUP BY 1, 2, 3),
n AS (SELECT {group}, count(*) AS n_tracts FROM grouped GROUP BY 1 HAVING count(*) >= 10)
SELECT {group}, round(avg(r2) FILTER (model = 'price'), 5) AS r2_price,
       round(avg(r2) FILTER (model = 'balance'), 5) AS r2_balance,
       round(avg(r2) FILTER (model = 'month'), 5) AS r2_month,
       round(avg(r2) FILTER (model = 'emb'), 5) AS r2_emb,
       count(DISTINCT outcome) AS n_outcomes, n_tracts
FROM avg1 JOIN n USING ({group}) GROUP BY {group}, n_tracts
"""


@query(vector_sweep_sql("state", "grouped AS (SELECT * FROM va),"))
def sweep_states_vectors(spark, d):
    """Inside-state R² of three indices and the vectors."""
    areas = row_folds(vector_areas(spark, d), "area", 2, 42, ["state"])
    rows, layout = vector_design(areas, ["state", "fold"])
    return rounded(
        sweeps.sweep_by(rows, layout, [*INDICES, EMBEDDINGS], "state", min_group=10, min_rows=10),
        5,
    )


@query(vector_sweep_sql("decile", """
de AS (SELECT quantile_cont(n_orders, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS e FROM va),
grouped AS (SELECT va.*, CAST(1 + len(list_filter(e, lambda q: q < n_orders)) AS INTEGER) AS decile
            FROM va, de),"""))
def sweep_deciles_vectors(spark, d):
    """Inside-decile R² of three indices and the vectors."""
    areas = area_decile(vector_areas(spark, d), "n_orders")
    areas = row_folds(areas, "area", 2, 42, ["decile"])
    rows, layout = vector_design(areas, ["decile", "fold"])
    return rounded(
        sweeps.sweep_by(rows, layout, [*INDICES, EMBEDDINGS], "decile", min_group=10, min_rows=10),
        5,
    )


@query()
def boosted_fit(spark, d):
    """Boosted trees (300 at step 0.05) on one target, missing predictors routed by their mark."""
    areas = holdout(area_table(spark, d), "state").withColumn("train", ~F.col("test"))
    out = fit_predict(areas, ["n_orders", "high", "low"], "balance", "train", "gbt")
    return r2_score(out, "balance", "prediction", ["test"])


SIXTY_FOURTHS = "[" + ", ".join(str(i / 64) for i in range(1, 64)) + "]"


@query(f"""
WITH {SPLIT_SQL},
{long_sql("split", "area, test, n_orders, high AS other")},
ft AS (SELECT area, test, outcome, y, 1 AS f, n_orders AS x FROM long
       UNION ALL SELECT area, test, outcome, y, 2, other FROM long),
ed AS (SELECT 1 AS f, unnest(quantile_disc(n_orders, {SIXTY_FOURTHS})) AS e FROM split
       UNION SELECT 2, unnest(quantile_disc(high, {SIXTY_FOURTHS})) FROM split),
side AS (SELECT ft.*, e, ml, CASE WHEN x IS NULL THEN ml ELSE x <= e END AS low
         FROM ft JOIN ed USING (f), (SELECT unnest([false, true]) AS ml)),
mean AS (SELECT outcome, avg(y) AS m, count(*) AS n_train FROM long WHERE NOT test GROUP BY 1),
cand AS (SELECT outcome, f, e, ml, count(*) FILTER (low) AS nl, count(*) FILTER (NOT low) AS nr,
                sum(y - m) FILTER (low) AS sl, sum(y - m) FILTER (NOT low) AS sr
         FROM side JOIN mean USING (outcome) WHERE NOT test GROUP BY ALL),
best AS (SELECT * FROM cand WHERE nl >= 20 AND nr >= 20
         QUALIFY row_number() OVER (PARTITION BY outcome ORDER BY
             round(sl * sl / nl + sr * sr / nr - (sl + sr) * (sl + sr) / (nl + nr), 3) DESC, f, ml, e) = 1),
pred AS (SELECT s.outcome, y, m + CASE WHEN low THEN sl / nl ELSE sr / nr END AS p, n_train
         FROM side s JOIN best b ON s.outcome = b.outcome AND s.f = b.f AND s.e = b.e AND s.ml = b.ml
         JOIN mean ON mean.outcome = s.outcome WHERE test)
SELECT outcome, 'one split' AS model, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2,
       n_train, count(*) AS n_test
FROM pred GROUP BY outcome, n_train HAVING n_train >= 100 AND count(*) >= 50
""")
def tree_one_split(spark, d):
    """The best single split of two predictors, one with missing values, on held-out states."""
    areas = holdout(area_table(spark, d), "state").withColumn("other", F.col("high"))
    rows, layout = design(
        areas, ["test"], OUTCOMES, numeric={"two": ["n_orders", "other"]}, missing="keep"
    )
    model = Model("one split", ("two",), "gbt", trees=1, step=1.0, leaves=2)
    return rounded(sweeps.compare_sets(rows, layout, [model]), 5)


@query()
def sweep_deciles_trees(spark, d):
    """Inside-decile R2 of three indices and the vectors by boosted trees (30 at step 0.15, 16 leaves)."""
    areas = area_decile(vector_areas(spark, d), "n_orders")
    areas = row_folds(areas, "area", 2, 42, ["decile"])
    blocks = {"price": ["mean_price"], "balance": ["balance"], "month": ["mean_month"]}
    rows, layout = design(
        areas, ["decile", "fold"], OUTCOMES, vector=("embedding", DIMS), numeric=blocks, missing="keep"
    )
    small = {"learner": "gbt", "trees": 30, "step": 0.15, "leaves": 16}
    models = [*[Model(name, (name,), **small) for name in blocks], Model("emb", ("vector",), **small)]
    return rounded(sweeps.sweep_by(rows, layout, models, "decile"), 5)


# --- associations -------------------------------------------------------------------------


@query(f"""
WITH {AREA_SQL},
va AS (SELECT area.*, embedding FROM area JOIN embeddings ON vec_id = area),
el AS (SELECT area, CAST(i - 1 AS INTEGER) AS place, {HOLED} AS x FROM va, (SELECT unnest(range(1, 65)) AS i)),
{long_sql("va", "area")},
pairs AS (SELECT place, outcome AS variable, x, y FROM el JOIN long USING (area) WHERE x IS NOT NULL)
SELECT place, variable, count(*) AS n, round(corr(x, y), 6) AS corr FROM pairs GROUP BY 1, 2
""")
def vector_correlations(spark, d):
    """Every place of the vectors, with holes, against every outcome, with holes."""
    areas = holed(vector_areas(spark, d))
    return rounded(pairwise_corr(areas, "embedding", DIMS, OUTCOMES))


PANEL_SQL = """
panel AS (SELECT o_custkey AS unit, CAST(year(o_orderdate) AS INTEGER) AS year,
                 avg(o_totalprice) AS price, avg(month(o_orderdate)) AS month,
                 avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') AS high,
                 CAST(count(*) AS DOUBLE) AS n_orders
          FROM orders GROUP BY 1, 2),
change AS (SELECT a.unit, a.year, a.price - b.price AS price, a.month - b.month AS month,
                  a.high - b.high AS high, a.n_orders - b.n_orders AS n_orders
           FROM panel a JOIN panel b ON a.unit = b.unit AND a.year = b.year + 1)
"""


def order_changes(spark, d):
    """Change over a year of each customer's vector (price, month, price of high priority) and orders."""
    high = F.when(F.col("o_orderpriority") == "2-HIGH", F.col("o_totalprice"))
    panel = table(spark, d, "orders").groupBy(
        F.col("o_custkey").alias("unit"), F.year("o_orderdate").alias("year")
    ).agg(
        F.array(F.avg("o_totalprice"), F.avg(F.month("o_orderdate")), F.avg(high)).alias("v"),
        F.count(F.lit(1)).cast("double").alias("n_orders"),
    )
    return lagged_change(materialise(panel), "unit", "year", "v", ["n_orders"])


@query(f"""
WITH {PANEL_SQL}
SELECT unit, year, round(price, 4) AS price, round(month, 4) AS month, round(high, 4) AS high, n_orders FROM change
""")
def lagged_changes(spark, d):
    """Vectors and outcomes less those of the year before; years without one have no change."""
    names = ["price", "month", "high"]
    out = order_changes(spark, d)
    return rounded(
        out.select("unit", "year", *[F.col("v")[i].alias(n) for i, n in enumerate(names)], "n_orders"), 4
    )


@query(f"""
WITH {PANEL_SQL}, l AS (UNPIVOT (SELECT n_orders, price, month, high FROM change) ON price, month, high
                        INTO NAME variable VALUE x)
SELECT CAST(CASE variable WHEN 'price' THEN 0 WHEN 'month' THEN 1 ELSE 2 END AS INTEGER) AS place,
       'n_orders' AS variable, count(*) AS n, round(corr(x, n_orders), 6) AS corr FROM l GROUP BY l.variable
""")
def change_correlations(spark, d):
    """Change of the vectors against change of the outcome."""
    return rounded(pairwise_corr(order_changes(spark, d), "v", 3, ["n_orders"]))


@query(QUERIES["shuffled_folds"].sql)
def shuffled_folds_bucketed(spark, d):
    """The same folds by hash buckets of few rows in every state."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return row_folds(c, "c_custkey", 2, 42, ["c_nationkey"], 40).select("c_custkey", "fold")


# --- yes/no outcomes of people ------------------------------------------------------------


@query(f"""
WITH RECURSIVE {SPLIT_SQL},
people AS (
  SELECT o_custkey AS area, 'finished' AS outcome,
         CASE o_orderstatus WHEN 'F' THEN 1.0 WHEN 'O' THEN 0.0 END AS y FROM orders
  UNION ALL
  SELECT o_custkey, 'urgent', CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0 ELSE 0.0 END FROM orders),
scale AS (SELECT avg(balance) AS m, stddev_pop(balance) AS s FROM split WHERE NOT test),
person AS (SELECT outcome, test, CAST(y AS DOUBLE) AS y, (balance - m) / s AS x
           FROM people JOIN split USING (area), scale WHERE y IS NOT NULL),
newton(outcome, i, a, b) AS (
  SELECT DISTINCT outcome, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM person
  UNION ALL
  SELECT outcome, i + 1, a + (h11 * ga - h01 * gb) / (h00 * h11 - h01 * h01),
         b + (h00 * gb - h01 * ga) / (h00 * h11 - h01 * h01)
  FROM (
    SELECT outcome, i, a, b, sum(p * (1 - p)) AS h00, sum(p * (1 - p) * x) AS h01,
           sum(p * (1 - p) * x * x) + 1 AS h11, sum(y - p) AS ga, sum((y - p) * x) - b AS gb
    FROM (SELECT n.outcome, i, a, b, x, y, 1 / (1 + exp(-(a + b * x))) AS p
          FROM newton n JOIN person USING (outcome) WHERE i < 9 AND NOT test)
    GROUP BY outcome, i, a, b)),
scored AS (
  SELECT outcome, y, 1 / (1 + exp(-(a + b * x))) AS p,
         rank() OVER w + (count(*) OVER (PARTITION BY outcome, x) - 1) / 2.0 AS place
  FROM person JOIN newton USING (outcome) WHERE i = 9 AND test
  WINDOW w AS (PARTITION BY outcome ORDER BY a + b * x))
SELECT outcome, 'index' AS model,
       (SELECT count(*) FROM person t WHERE NOT test AND t.outcome = s.outcome) AS n_train,
       count(*) AS n_test,
       round(-avg(CASE WHEN y = 1 THEN ln(p) ELSE ln(1 - p) END), 6) AS log_loss,
       round((sum(place) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc
FROM scored s GROUP BY outcome
""")
def logistic_index(spark, d):
    """Yes/no outcomes of orders from their customer's index, judged in held-out states."""
    rows, layout = people_design(spark, d, numeric={"index": ["balance"]})
    return rounded(held_out_logistic(rows, layout, [Model("index", ("index",))], list(YES_NO)))


YES_NO = {
    "finished": "CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 0 END",
    "urgent": "o_orderpriority = '1-URGENT'",
}


def people_design(spark, d, **features):
    """Orders in the role of people, counted by customer, beside the customers' features."""
    marks = [F.expr(f"CAST({e} AS INT)").alias(name) for name, e in YES_NO.items()]
    people = table(spark, d, "orders").select(F.col("o_custkey").alias("area"), *marks)
    areas = holdout(area_table(spark, d), "state")
    lived_in = lookup_join(areas, count_people(people, "area", list(YES_NO)), "area", "inner")
    return design(lived_in, ["test"], counted(list(YES_NO)), train="NOT test", **features)


# --- principal components -----------------------------------------------------------------


def pca_sql(k: int) -> str:
    """Components from fit(area, i, x) by repeated squaring of the covariance, one at a time:
    comp(component, lam, v), mu(i, m) and total(t). Squaring 29 times leaves the leading
    direction; it is then taken off the covariance."""
    take = "list_transform(c, lambda row, i: list_transform(row, lambda e, j: e - lam2 * v2[i] * v2[j]))"
    return f"""
mu AS (SELECT i, avg(x) AS m FROM fit GROUP BY i),
cen AS (SELECT area, i, x - m AS x FROM fit JOIN mu USING (i)),
cov AS (SELECT a.i, b.i AS j, sum(a.x * b.x) / (SELECT count(DISTINCT area) - 1 FROM fit) AS v
        FROM cen a JOIN cen b USING (area) GROUP BY a.i, b.i),
total AS (SELECT sum(v) AS t FROM cov WHERE i = j),
mat AS (SELECT list(r ORDER BY i) AS c FROM (SELECT i, list(v ORDER BY j) AS r FROM cov GROUP BY i)),
power AS (
  SELECT 0 AS step, c AS c, c AS m, CAST(NULL AS DOUBLE) AS lam, CAST(NULL AS DOUBLE[]) AS v FROM mat
  UNION ALL
  SELECT step + 1, CASE WHEN step % 30 = 29 THEN {take} ELSE c END,
         CASE WHEN step % 30 = 29 THEN {take}
              ELSE list_transform(m, lambda a: list_transform(m, lambda b: list_dot_product(a, b) / (tr * tr))) END,
         lam2, v2
  FROM (SELECT *, list_dot_product(v2, list_transform(c, lambda row: list_dot_product(row, v2))) AS lam2
        FROM (SELECT *, list_transform(top, lambda e: e / sqrt(list_dot_product(top, top))) AS v2
              FROM (SELECT step, c, m, list_sum(list_transform(m, lambda row, i: row[i])) AS tr,
                           m[list_position(list_transform(m, lambda row, i: row[i]),
                                           list_max(list_transform(m, lambda row, i: row[i])))] AS top
                    FROM power WHERE step < {30 * k})))),
raw AS (SELECT step // 30 - 1 AS component, lam, v, list_transform(v, lambda e: abs(e)) AS mag
        FROM power WHERE step > 0 AND step % 30 = 0),
comp AS (SELECT component, lam,
                list_transform(v, lambda e: e * sign(v[list_position(mag, list_max(mag))])) AS v FROM raw)
"""


ALL_VECTORS_SQL = """
fit AS (SELECT vec_id AS area, i, CAST(embedding[i] AS DOUBLE) AS x
        FROM embeddings, (SELECT unnest(range(1, 65)) AS i))
"""


@query(f"""
WITH RECURSIVE {ALL_VECTORS_SQL}, {pca_sql(2)},
s AS (SELECT area, component, sum((x - m) * v[i]) AS score FROM fit JOIN mu USING (i), comp GROUP BY 1, 2)
SELECT area AS vec_id, round(max(score) FILTER (component = 0), 6) AS pc1,
       round(max(score) FILTER (component = 1), 6) AS pc2 FROM s GROUP BY 1
""")
def pca_two(spark, d):
    """Two components of every vector."""
    e = table(spark, d, "embeddings")
    scored = pca_apply(e, "embedding", pca_fit(e, "embedding", 2))
    return rounded(
        scored.select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
    )


@query(QUERIES["pca_two"].sql)
def pca_saved(spark, d):
    """The same components through a projection that was saved and loaded."""
    e = table(spark, d, "embeddings")
    path = f"{checkpoint_dir(spark)}/areascope/projection-{uuid.uuid4().hex}"
    pca_fit(e, "embedding", 2).save(path)
    scored = pca_apply(e, "embedding", Projection.load(path))
    return rounded(
        scored.select("vec_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))
    )


@query(f"""
WITH RECURSIVE {ALL_VECTORS_SQL}, {pca_sql(10)}
SELECT CAST(component AS INTEGER) AS component, round(lam / t, 6) AS ratio,
       round(sum(lam / t) OVER (ORDER BY component), 6) AS cumulative FROM comp, total
""")
def pca_explained(spark, d):
    """Variance shares of ten components."""
    e = table(spark, d, "embeddings")
    return rounded(pca_fit(e, "embedding", 10).explained(e))


@query(f"""
WITH RECURSIVE el AS (SELECT vec_id AS area, i, CAST(embedding[i] AS DOUBLE) AS x
                      FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
chosen AS (SELECT vec_id AS area FROM embeddings
           QUALIFY row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR) || '-42'), vec_id)
                   <= greatest(200, CAST(floor(count(*) OVER () * 0.05) AS BIGINT))),
fit AS (SELECT el.* FROM el JOIN chosen USING (area)), {pca_sql(10)}
SELECT area AS vec_id, CAST(component AS INTEGER) AS component,
       round(sum((x - m) * v[i]), 6) AS score
FROM el JOIN mu USING (i), comp GROUP BY 1, 2
""")
def pca_sampled(spark, d):
    """Ten components fitted on a seeded sample, applied to all rows."""
    e = table(spark, d, "embeddings")
    scored = pca_apply(e, "embedding", pca_fit_sample(e, "embedding", "vec_id", 10))
    return rounded(scored.select("vec_id", F.posexplode("pc").alias("component", "score")))


@query("""
WITH el AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS x
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i)),
m AS (SELECT i, avg(x) AS mean FROM el GROUP BY 1)
SELECT vec_id, round(sum((x - mean) ** 2), 6) AS norm FROM el JOIN m USING (i) GROUP BY 1
""")
def pca_full_norm(spark, d):
    """All 64 components keep every vector's distance from the mean."""
    e = table(spark, d, "embeddings")
    scored = pca_apply(e, "embedding", pca_fit(e, "embedding", DIMS))
    norm = F.aggregate("pc", F.lit(0.0), lambda acc, v: acc + v * v)
    return rounded(scored.select("vec_id", norm.alias("norm")))


@query(f"""
WITH RECURSIVE {VECTOR_SPLIT_SQL},
fit AS (SELECT area, i, CAST(embedding[i] AS DOUBLE) AS x FROM va, (SELECT unnest(range(1, 65)) AS i)),
{pca_sql(10)},
feat1 AS (SELECT 'components' AS model, area, component + 1 AS f, sum((x - m) * v[i]) AS x
          FROM fit JOIN mu USING (i), comp GROUP BY area, component),
src AS (SELECT 'components' AS model, outcome AS sys, area, test, y FROM long),
{SOLVE_SQL.replace("feat ", "feat1 ")}
SELECT sys AS outcome, model, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(*)), 5) AS r2,
       round(avg(abs(y - p)), 4) AS mae, n_train, count(*) AS n_test
FROM pred JOIN size ON sys = outcome WHERE test GROUP BY sys, model, n_train
""")
def ridge_on_components(spark, d):
    """Ridge of each outcome on ten components, held-out states: R² and mean error."""
    areas = vector_areas(spark, d)
    scored = pca_apply(areas, "embedding", pca_fit(areas, "embedding", 10))
    rows, layout = design(
        holdout(scored, "state"), ["test"], OUTCOMES, vector=("pc", 10), scale=False, train=TRAINING
    )
    models = [Model("components", ("vector",))]
    scores = sweeps.score_measures(rows, layout, models, min_train=100, min_test=50)
    return scores.withColumns({"r2": F.round("r2", 5), "mae": F.round("mae", 4)})
