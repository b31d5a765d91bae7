"""Feature layout for model sweeps: one array of features and one of outcomes per area."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areascope.functions.ranking import exact_quantiles
from areascope.functions.scalars import edges_below
from areascope.functions.vectors import complete_vector, double_array
from areascope.session import ROWS_PER_BUCKET


@dataclass
class Layout:
    """Where each block of features sits (the constant is place 0) and the outcome names."""

    outcomes: list[str]
    p: int = 0
    blocks: dict[str, list[int]] = field(default_factory=dict)

    def add(self, name: str, n: int) -> None:
        self.blocks[name] = list(range(self.p + 1, self.p + n + 1))
        self.p += n

    def cols(self, *names: str) -> list[int]:
        return [c for name in names for c in self.blocks[name]]


def design(
    df: DataFrame, keep: list[str], outcomes: list[str], vector: tuple[str, int] | None = None,
    numeric: dict[str, list[str]] | None = None, binned: dict[str, str] | None = None,
    bins: int = 32, scale: bool = True, train: str | None = None, missing: str = "fill",
) -> tuple[DataFrame, Layout]:
    """Rows (keep..., x, y) and the layout of x.

    vector: an array column of known length, block "vector"; a missing element becomes the mean
    of its place, and one 0/1 mark says that the vector is incomplete or missing. numeric: blocks
    of plain columns; a missing value becomes the mean and a 0/1 mark is added. NaN is missing.
    binned: one column each, cut at
    percentiles into 0/1 marks, missing values in a mark of their own (a tree on one feature
    is such a step function). With `scale`, vector and numeric features are centred and
    divided by their population std, so a penalty treats a 0-1 and a square-metre column alike.
    With `missing="keep"` vector and numeric features stay as they are, without marks, as trees take them.
    `train` is the condition of the rows that means, stds and edges are taken from (all by default). Only these
    few numbers per feature come to the driver.
    """
    numeric, binned = numeric or {}, binned or {}
    if missing == "keep":
        return _plain_design(df, keep, outcomes, vector, numeric)
    plain = [c for cols in numeric.values() for c in cols]
    parts: list[Column] = []
    layout = Layout(outcomes)

    dims = vector[1] if vector else 0
    aggs = [F.count(F.lit(1)).alias("rows")]
    aggs += [F.avg(known(F.col(c))).alias(f"m_{c}") for c in plain]
    aggs += [F.stddev_pop(known(F.col(c))).alias(f"s_{c}") for c in plain]
    if vector:
        raw = F.transform(F.slice(F.col(vector[0]).cast("array<double>"), 1, dims), known)
        aggs += _place_sums(raw, dims)
    fitted = df if train is None else df.where(train)
    # grouped by a constant, no rows give no row: vector statistics need one row at least
    stats = fitted.groupBy(F.lit("all")).agg(*aggs).first()
    stats = stats.asDict() if stats else defaultdict(lambda: None, rows=0)
    edges = _all_edges(fitted, list(binned.values()), bins, stats["rows"])

    def scaled(c: Column, mean: float | None, std: float | None) -> Column:
        mean = mean or 0.0
        filled = F.coalesce(known(c), F.lit(mean))
        if not scale:
            return filled
        return (filled - F.lit(mean)) / F.lit(std if std else 1.0)

    if vector:
        places = _place_stats(stats, dims)
        means = double_array([mean for mean, _ in places])
        stds = double_array([std or 1.0 for _, std in places])
        # a missing or short vector is filled up, too
        filled = F.zip_with(
            F.coalesce(raw, F.array().cast("array<double>")), means, lambda e, m: F.coalesce(e, m)
        )
        whole = F.coalesce((F.size(raw) == dims) & complete_vector(raw), F.lit(False))
        if scale:
            centred = F.zip_with(filled, means, lambda e, m: e - m)
            filled = F.zip_with(centred, stds, lambda e, s: e / s)
        parts += [filled, F.array(F.when(whole, 0.0).otherwise(1.0))]
        layout.add("vector", dims + 1)
    for name, cols in numeric.items():
        values = [scaled(F.col(c), stats[f"m_{c}"], stats[f"s_{c}"]) for c in cols]
        marks = [F.when(known(F.col(c)).isNull(), 1.0).otherwise(0.0) for c in cols]
        parts.append(F.array(*values, *marks))
        layout.add(name, 2 * len(cols))
    for name, c in binned.items():
        marks, n = bin_marks(F.col(c), edges[c])
        parts.append(marks)
        layout.add(name, n)

    x = F.concat(*parts)
    y = F.array(*[F.col(o).cast("double") for o in outcomes])
    return df.select(*keep, x.alias("x"), y.alias("y")), layout


def _plain_design(df, keep, outcomes, vector, numeric) -> tuple[DataFrame, Layout]:
    """Features as they are, missing ones null."""
    parts, layout = [], Layout(outcomes)
    if vector:
        have = F.coalesce(F.col(vector[0]).cast("array<double>"), F.array().cast("array<double>"))
        empty = F.array_repeat(F.lit(None).cast("double"), vector[1])
        parts.append(F.zip_with(F.slice(have, 1, vector[1]), empty, lambda e, _: known(e)))
        layout.add("vector", vector[1])
    for name, cols in numeric.items():
        parts.append(F.array(*[known(F.col(c)) for c in cols]))
        layout.add(name, len(cols))
    y = F.array(*[known(F.col(o)) for o in outcomes])
    return df.select(*keep, F.concat(*parts).alias("x"), y.alias("y")), layout


def known(c: Column) -> Column:
    """The value as a double, NaN as null."""
    value = c.cast("double")
    return F.when(~F.isnan(value), value)


def _place_sums(v: Column, dims: int) -> list[Column]:
    """Aggregates of every place of a vector in the pass that all other statistics share."""
    zeros = F.array_repeat(F.lit(0.0), dims)
    have = F.coalesce(v, F.array().cast("array<double>"))
    filled = F.zip_with(have, zeros, lambda e, z: F.coalesce(e, z))
    there = F.zip_with(have, zeros, lambda e, z: F.when(e.isNull(), 0.0).otherwise(1.0))
    both = Summarizer.metrics("mean", "variance").summary(array_to_vector(filled))
    return [
        both.alias("__vector"),
        Summarizer.sum(array_to_vector(there)).alias("__known"),
    ]


def _place_stats(stats: dict, dims: int) -> list[tuple[float, float]]:
    """Mean and population std of the known elements at each place.

    The sums hold a zero for every missing element; these are taken out again. A place without
    any value has mean and std 0.
    """
    n = stats["rows"]
    if n == 0:
        return [(0.0, 0.0)] * dims
    mean, spread = stats["__vector"]["mean"].toArray(), stats["__vector"]["variance"].toArray()
    k = stats["__known"].toArray()
    known_mean = mean * n / np.maximum(k, 1)
    squares = spread * (n - 1) - k * (known_mean - mean) ** 2 - (n - k) * mean**2
    std = np.sqrt(np.maximum(squares, 0.0) / np.maximum(k, 1))
    return list(zip(known_mean.tolist(), std.tolist(), strict=True))


def _all_edges(
    df: DataFrame, columns: list[str], bins: int, rows: int
) -> dict[str, list[float]]:
    """Interior percentile edges of several columns, together when the rows are few."""
    if rows > ROWS_PER_BUCKET:
        return {c: bin_edges(df, c, bins) for c in columns}
    probs = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    found = df.agg(
        F.count(F.lit(1)), *[F.percentile(F.col(c).cast("double"), probs).alias(c) for c in columns]
    ).first()
    return {c: sorted(set(found[c] or [])) for c in columns}


def bin_edges(df: DataFrame, c: str, bins: int) -> list[float]:
    """Distinct interior percentile edges of a column."""
    probs = [i / bins for i in range(1, bins)]
    row = exact_quantiles(df, [], c, probs, "q").first()
    return sorted(set(row["q"])) if row and row["q"] else []


def bin_number(c: Column, edges: list[float]) -> Column:
    """Number of edges strictly below the value; missing values get a number of their own."""
    return F.when(c.isNotNull(), edges_below(c, edges)).otherwise(F.lit(len(edges) + 1))


def bin_marks(c: Column, edges: list[float]) -> tuple[Column, int]:
    """0/1 marks of the bins, the last one for missing values, and their number."""
    n = len(edges) + 2
    number = bin_number(c, edges)
    zero = F.lit(0.0)
    marks = F.concat(
        F.array_repeat(zero, number), F.array(F.lit(1.0)), F.array_repeat(zero, F.lit(n - 1) - number)
    )
    return marks, n
