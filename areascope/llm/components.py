"""Connected components of a graph given as edges, in rounds of joins.

Large-star and small-star steps by turns: every node first hands the smallest id it knows to its
larger neighbours, then to its smaller ones, until each component is a star around its smallest
node. Each round is written to the shared folder, so lineage stays short and lost executors cost
one round. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.session import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(
        edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest of itself and its neighbours to its larger neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = both.where("b > a").join(least, "a")
    return moved.select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smallest smaller neighbour to the others and itself (a < b)."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(least, "b").select(F.col("m").alias("a"), F.col("a").alias("b"))
    own = least.select(F.col("m").alias("a"), "b")
    return moved.where("a < b").unionByName(own).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b), long ids; root is the smallest node."""
    ordered = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    now = materialise(ordered.where("a < b").distinct())
    before, state = None, _state(now)
    while state != before:
        now = materialise(_small_star(materialise(_large_star(now))))
        before, state = state, _state(now)
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
