"""Correlations of every vector place with every variable, over the rows that have both.

Each task adds up six blocks of co-moments (places x variables) by matrix products; Spark adds the
blocks up by place. A missing value leaves out its pairs only, not its row. Values are shifted by their
overall mean first, so large values lose no digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.operators.design import known
from areascope.operators.gram import _matrix

MOMENTS = ["n", "sx", "sy", "sxx", "syy", "sxy"]


def pairwise_corr(
    df: DataFrame, vector: str, dims: int, columns: list[str], least: int = 2
) -> DataFrame:
    """(place, variable, n, corr): Pearson's coefficient of each pair of a vector's place (from 0) and a
    column, over the n rows that have both; missing if there are under `least` or one does not vary."""
    have = F.coalesce(F.col(vector).cast("array<double>"), F.array().cast("array<double>"))
    rows = df.select(
        F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: known(F.get(have, i))).alias("x"),
        F.array(*[known(F.col(c)) for c in columns]).alias("y"),
    )
    m = len(columns)
    means = [F.avg(F.get("x", F.lit(i))) for i in range(dims)] + [F.avg(F.get("y", F.lit(i))) for i in range(m)]
    middle = np.array([v or 0.0 for v in rows.agg(*means).first()])  # dims + m numbers

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((6, dims, m))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), dims) - middle[:dims]
            y = _matrix(batch.column("y"), m) - middle[dims:]
            kx, ky = ~np.isnan(x) * 1.0, ~np.isnan(y) * 1.0
            x, y = np.nan_to_num(x), np.nan_to_num(y)
            pairs = [(kx, ky), (x, ky), (kx, y), (x * x, ky), (kx, y * y), (x, y)]
            total += np.stack([a.T @ b for a, b in pairs])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array(list(total.transpose(1, 2, 0).reshape(dims, -1)))],
            names=["place", "s"],
        )

    partial = rows.mapInArrow(sums, "place int, s array<double>")
    added = vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s")
    names = F.array(*[F.lit(c) for c in columns])
    long = partial.groupBy("place").agg(added).select(
        "place", "s", F.posexplode(names).alias("j", "variable")
    )
    long = long.select(
        "place", "variable", *[F.get("s", F.col("j") * 6 + k).alias(name) for k, name in enumerate(MOMENTS)]
    )
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    tiny = lambda v, s: v > 1e-12 * n * F.col(s)
    corr = (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)
    good = (n >= least) & tiny(vx, "sxx") & tiny(vy, "syy")
    return long.select(
        "place", "variable", F.round("n").cast("long").alias("n"), F.when(good, corr).alias("corr")
    )
