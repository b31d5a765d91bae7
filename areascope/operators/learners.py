"""Fit one target and predict every row: ridge, percentile bins or boosted trees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.functions.ranking import value_edges, with_bucket
from areascope.functions.scalars import edges_below
from areascope.operators.design import bin_edges, bin_number
from areascope.operators.gram import Sums, fit_ridge, gram
from areascope.session import ROWS_PER_BUCKET, materialise

TREE_BINS = 32


def fit_predict(
    df: DataFrame, features: list[str], y: str, train: str, learner: str = "ridge",
    out: str = "prediction", alpha: float = 1.0, bins: int = 32, trees: int = 300,
    step: float = 0.05, depth: int = 5, min_leaf: int = 20, seed: int = 42,
) -> DataFrame:
    """Fit on the rows marked `train` that have the target, predict on all rows.

    ridge: rows with a missing feature are not fitted and get no prediction.
    bins: one feature cut at its percentiles; a bin predicts its mean, missing values too.
    gbt: boosted trees; a missing feature is replaced by its mean and marked. Features are cut into 32 bins,
    so trees are grown from the number and mean target of the rows in each combination of bins.
    """
    if learner == "ridge":
        return _ridge(df, features, y, train, out, alpha)
    if learner == "bins":
        return _bins(df, features[0], y, train, out, bins)
    if learner == "gbt":
        return _gbt(df, features, y, train, out, trees, step, depth, min_leaf, seed)
    raise ValueError(f"unknown learner {learner}")


def ridge_weights(
    df: DataFrame, features: list[str], y: str, alpha: float = 1.0
) -> tuple[float, list[float]]:
    """Constant and weights of a ridge fit; only features² sums come to the driver."""
    p = len(features)
    rows = df.dropna("any", subset=[*features, y]).select(
        F.array(*[F.col(c).cast("double") for c in features]).alias("x"),
        F.array(F.col(y).cast("double")).alias("y"),
    )
    # Centring first keeps the sums well-conditioned; the fitted line is the same.
    means = rows.agg(*[F.avg(F.get("x", F.lit(i))).alias(f"m{i}") for i in range(p)]).first()
    centred = rows.withColumn(
        "x", F.array(*[F.get("x", F.lit(i)) - F.lit(means[i] or 0.0) for i in range(p)])
    )
    xx, xy, _, _ = Sums.from_rows(gram(centred, [], p, 1).toPandas(), p, 1).outcome(0)
    w = fit_ridge(xx, xy, list(range(1, p + 1)), alpha)
    shift = float(np.dot(w[1:], [m or 0.0 for m in means]))
    return float(w[0]) - shift, [float(v) for v in w[1:]]


def _ridge(df, features, y, train, out, alpha):
    constant, weights = ridge_weights(df.where(F.col(train)), features, y, alpha)
    line = F.lit(constant)
    for c, w in zip(features, weights, strict=True):
        line = line + F.col(c) * F.lit(w)
    return df.withColumn(out, line)


def _bins(df, feature, y, train, out, bins):
    rows = df.where(F.col(train) & F.col(y).isNotNull())
    edges = bin_edges(rows, feature, bins)
    number = bin_number(F.col(feature), edges)
    # At most bins + 1 rows, and one row.
    means = rows.groupBy(number.alias("__bin")).agg(F.avg(y).alias("__mean"))
    overall = rows.agg(F.avg(y).alias("__overall"))
    return (
        df.withColumn("__bin", number)
        .join(F.broadcast(means), "__bin", "left")
        .crossJoin(F.broadcast(overall))
        .withColumn(out, F.coalesce("__mean", "__overall"))
        .drop("__bin", "__mean", "__overall")
    )


def tree_edges(df: DataFrame, c: str, bins: int = TREE_BINS, rows_per_bucket: int = ROWS_PER_BUCKET) -> list[float]:
    """Where MLlib's trees cut a feature, by the counts of all its values instead of those in a sample.

    Between all values if they are few; else after the value whose count of rows up to it is nearest
    to each of the bins' shares, and after the next value if that place is taken.
    """
    v, n, b = "__v", "__n", "__b"
    counts = df.groupBy(F.col(c).cast("double").alias(v)).agg(F.count(F.lit(1)).alias(n))
    counts = materialise(counts.where(F.col(v).isNotNull()))
    found = counts.agg(F.count(F.lit(1)).alias("values"), F.sum(n).alias("rows")).first()
    if found["values"] < 2:
        return []
    cut = with_bucket(counts, v, value_edges(counts, v, rows_per_bucket, found["values"]), b)
    sizes = cut.groupBy(b).agg(F.sum(n).alias("__rows"), F.count(F.lit(1)).alias("__values"))
    before = W.partitionBy(F.lit(0)).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select(  # one row per bucket
        b, *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in ("__rows", "__values")]
    )
    inside = W.partitionBy(b).orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = cut.join(F.broadcast(sizes), b).select(
        v, n, (F.col("__rows") + F.sum(n).over(inside)).alias("__end"),
        (F.col("__values") + F.count(F.lit(1)).over(inside) - 1).alias("__place"),
    )
    if found["values"] <= bins:
        places = [*range(1, found["values"])]
    else:
        # the count up to the value before is nearer to the share than that up to the value
        nearer = [2 * F.col("__end") - F.col(n) > F.lit(2 * found["rows"] / bins * i) for i in range(1, bins)]
        after = F.col("__place") > 0
        row = placed.agg(*[F.min(F.when(after & near, F.col("__place"))).alias(str(i)) for i, near in enumerate(nearer)])
        places = []
        for place in row.first():
            place = max([place, *[p + 1 for p in places[-1:]]]) if place is not None else None
            if place is None or place >= found["values"]:
                break
            places.append(place)
    wanted = sorted({q for p in places for q in (p - 1, p)})
    at = {r["__place"]: r[v] for r in placed.where(F.col("__place").isin(wanted)).collect()}
    return [(at[p - 1] + at[p]) / 2 for p in places]


def _gbt(df, features, y, train, out, trees, step, depth, min_leaf, seed):
    rows = df.where(F.col(train) & F.col(y).isNotNull())
    means = rows.agg(*[F.avg(c) for c in features]).first()
    filled = [
        F.coalesce(F.col(c).cast("double"), F.lit(m or 0.0))
        for c, m in zip(features, means, strict=True)
    ]
    names = [f"__x{i}" for i in range(len(features))]
    values = rows.select(*[c.alias(name) for c, name in zip(filled, names, strict=True)])
    edges = [tree_edges(values, name) for name in names]
    cells = [edges_below(c, e).cast("double") for c, e in zip(filled, edges, strict=True)]
    cells += [F.col(c).isNull().cast("double") for c in features]
    names += [f"__m{i}" for i in range(len(features))]
    # Rows of equal bins go the same way in every tree: they are one row, weighted by their number.
    # Every tree reads them again; the shared folder also cuts the lineage of many trees.
    rows = rows.select(*[c.alias(name) for c, name in zip(cells, names, strict=True)], F.col(y).cast("double").alias(y))
    rows = materialise(rows.groupBy(*names).agg(F.avg(y).alias(y), F.count(F.lit(1)).cast("double").alias("__n")))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum("__n").alias("n")).first()
    model = GBTRegressor(
        featuresCol="__x", labelCol=y, predictionCol=out, maxIter=trees, stepSize=step, weightCol="__n",
        # a leaf holds min_leaf rows of the table, whatever their bins
        maxDepth=depth if (size["n"] or 0) >= 2 * min_leaf else 0, minInstancesPerNode=1,
        minWeightFractionPerNode=max(min_leaf - 0.5, 0.0) / max(size["n"] or 0, 2 * min_leaf, 1), seed=seed,
        # with fewer bins than this MLlib would look for them in a sample
        maxBins=max(TREE_BINS, math.isqrt(size["rows"]) + 1),
    ).fit(rows.withColumn("__x", array_to_vector(F.array(*names))))
    return model.transform(df.withColumn("__x", array_to_vector(F.array(*cells)))).drop("__x")
