"""Near copies among vectors by sorted projection passes.

Equal vectors become one counted vector. In each pass the vectors are ordered by their concatenated random
hashes (each the axis of a random projection that a vector is nearest to, with its sign). The order is cut
into windows of `window` vectors, and every vector is compared with all of its own and the next window, in
double precision, across partitions too: places in the order are counted, not left to a task.
What leaves a task are the edges of a spanning forest, never the pairs. Components are joined across passes;
then every two vectors of a component are compared to count links, so counts are complete
whatever the size of a group.

Vectors with the same leading hashes (a cell) lie side by side. A cell of up to `window` vectors is
compared in full by its windows. One that outgrows them is completed: it is cut into blocks, and each two
blocks meet in a group of their own, so a hash that a third of the vectors share makes more
groups, not larger ones. Components are cut likewise.

The chance that a pair has the same hash depends on its cosine alone (`same_hash`). A pair at the
threshold shares a cell in one pass with `same_hash ** depth`, however full the cells are, and the
passes together must reach `recall`. Depth is chosen per dimension by the counted sizes of the cells:
deep cells hold fewer pairs but need more passes. The
chance is of one pair over the choice of the axes; a pair that is missed is still linked and counted
if other links join its component.

Defined results: vectors that are missing, empty, zero or hold a missing or non-finite component
link with nothing, nor do vectors of different dimensions. Repeated rows are vectors like others. A
row without vec_id links with nothing and is kept; its component_id is missing. Other columns are
ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.llm.components import components
from areascope.llm.text import partitions
from areascope.session import materialise

WINDOW = 1024
HASHES = 7
ORDERED = 3  # hashes in the order at least
AXES = 64
RECALL = 0.99
PILOT_PASSES = 2
SEED = 20_240_501


def _axes(dim: int, which: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, which]).standard_normal((dim, AXES))


@lru_cache
def same_hash(least: float, samples: int = 200_000) -> float:
    """Chance that a hash is the same at a cosine of `least`: simulated, less three std errors.

    The axes see a pair as two normal numbers with that correlation, whatever the dimension.
    """
    rng, same, step = np.random.default_rng(SEED), 0, 10_000
    for _ in range(samples // step):
        u = rng.standard_normal((step, AXES))
        v = least * u + math.sqrt(max(0.0, 1 - least * least)) * rng.standard_normal(u.shape)
        i, j, at = np.abs(u).argmax(axis=1), np.abs(v).argmax(axis=1), np.arange(step)
        same += int(((i == j) & (u[at, i] * v[at, j] > 0)).sum())
    p = same / samples
    return max(p - 3 * math.sqrt(p * (1 - p) / samples), 1 / samples)


def passes_for(depth: int, same: float, recall: float = RECALL) -> int:
    """Passes in which a pair shares `depth` hashes at least once with a chance of `recall`."""
    chance = same**depth
    return 1 if chance >= recall else math.ceil(math.log(1 - recall) / math.log1p(-chance))


def _codes(plan: dict[int, tuple[int, int]]):
    """One long per pass: numbers of 7 bits, the first in the highest place."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            dims = batch["x"].map(len).to_numpy()
            for dim in np.unique(dims):
                part = batch[dims == dim]
                x = np.stack(part["x"].to_numpy()).astype(np.float64)
                depth, passes = plan[int(dim)]
                for p in range(passes):
                    code = np.zeros(len(x), dtype=np.int64)
                    for h in range(max(depth, ORDERED)):
                        seen = x @ _axes(int(dim), p * HASHES + h)
                        axis = np.abs(seen).argmax(axis=1)
                        sign = np.take_along_axis(seen, axis[:, None], 1)[:, 0] > 0
                        code = (code << 7) | (axis * 2 + sign)
                    yield pd.DataFrame(
                        {"dim": dim, "pass": p, "code": code, "node": part["node"].to_numpy()}
                    )

    return run


def _coded(nodes: DataFrame, plan: dict[int, tuple[int, int]]) -> DataFrame:
    return nodes.select("node", "x").mapInPandas(
        _codes(plan), "dim int, pass int, code long, node long"
    )


def _plan(nodes: DataFrame, least: float, window: int) -> dict[int, tuple[int, int]]:
    """(depth, passes) of each dimension, by counted cells.

    A pass costs each vector its cell, and the work of moving it, about `window` comparisons.
    """
    dims = nodes.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    sizes = {r["dim"]: r["n"] for r in dims.collect()}
    same = same_hash(least)
    codes = _coded(nodes, {dim: (HASHES, PILOT_PASSES) for dim in sizes})
    cells = materialise(
        codes.groupBy("dim", "pass", "code").agg(F.count(F.lit(1)).alias("n"))
    )
    depths = F.explode(F.array(*[F.lit(h) for h in range(1, HASHES + 1)]))
    lead = F.floor(F.col("code") / F.pow(F.lit(128), F.lit(HASHES) - F.col("depth")))
    leading = (
        cells.withColumn("depth", depths)
        .groupBy("dim", "pass", "depth", lead.alias("lead")).agg(F.sum("n").cast("double").alias("n"))
        .groupBy("dim", "depth").agg(F.sum(F.col("n") * (F.col("n") + window)).alias("cost"))
    )
    costs = {}
    for r in leading.collect():
        costs[r["dim"], r["depth"]] = r["cost"] / PILOT_PASSES * passes_for(r["depth"], same)
    best = {dim: min(range(1, HASHES + 1), key=lambda h: costs[dim, h]) for dim in sizes}
    return {dim: (depth, passes_for(depth, same)) for dim, depth in best.items()}


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest connected index of each of n."""
    root = np.arange(n)
    while True:
        new = root.copy()
        np.minimum.at(new, i, root[j])
        np.minimum.at(new, j, root[i])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(least: float, group: list[str], count: bool, within: bool = False):
    """Streams rows sorted by group and own block: links counted per node, or a forest's edges.

    With `within`, the lower block is also compared with itself.
    """

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        node, own = rows["node"].to_numpy(), rows["own"].to_numpy()
        x = np.stack(rows["x"].to_numpy()).astype(np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        low, high = rows["low"].iloc[0], rows["high"].iloc[0]
        # rows of one block meet in that block's own group
        stop = int(np.searchsorted(own, high)) if low < high else len(x)
        start = stop if low < high and not within else 0
        i, j = np.nonzero(x[:stop] @ x[start:].T >= least)
        j = j + start
        i, j = i[i < j], j[i < j]
        if count:
            copies = rows["copies"].to_numpy()
            links = np.bincount(i, copies[j], len(x)) + np.bincount(j, copies[i], len(x))
            links = np.rint(links).astype(np.int64)
            return pd.DataFrame({"node": node[links > 0], "links": links[links > 0]})
        root = _forest(len(x), i, j) if len(i) else np.arange(len(x))
        hit = root != np.arange(len(x))
        return pd.DataFrame({"node": node[hit], "root": node[root[hit]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = None
        for batch in batches:
            if left is not None:
                batch = pd.concat([left, batch], ignore_index=True)
            keys = batch[group].to_numpy()
            cut = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            starts = [0, *cut.tolist()]
            for start, stop in zip(starts, starts[1:]):
                if stop - start > 1:
                    yield meet(batch.iloc[start:stop])
            # the last group may go on in the next batch
            left = batch.iloc[starts[-1]:]
        if left is not None and len(left) > 1:
            yield meet(left)

    return run


def _meet(
    nodes: DataFrame, members: DataFrame, key: list[str], least: float, window: int, count: bool,
    over: int = 1,
) -> DataFrame:
    """All pairs of nodes with the same key compared, in groups of at most two blocks; keys of more
    than `over` nodes."""
    sizes = members.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over)
    blocks = F.ceil(F.col("n") / window).cast("int").alias("blocks")
    rows = members.join(materialise(sizes.select(*key, blocks)), key).join(nodes, "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    # a block meets every block, itself included
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", other).select(
        *key, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"),
        "own", "node", "copies", "x",
    )
    group = [*key, "low", "high"]
    out = "node long, links long" if count else "node long, root long"
    return (
        rows.repartition(partitions(nodes), *group)
        .sortWithinPartitions(*group, "own")
        .mapInPandas(_compare(least, group, count), out)
    )


def _ordered(coded: DataFrame, window: int) -> DataFrame:
    """(dim, pass, node, own): the number of each node's window in the order of its pass.

    Rows are sorted over all partitions; places follow from the counts of the partitions before, of which
    there are as many as partitions.
    """
    order = ["dim", "pass", "code", "node"]
    n = partitions(coded)
    place = F.monotonically_increasing_id()
    rows = coded.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("id", place)
    rows = materialise(rows.select("dim", "pass", "node", "id"))
    part = F.shiftright("id", 33)
    starts = rows.groupBy("dim", "pass", part.alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first")
    )
    before = W.partitionBy("dim", "pass").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = starts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    at = F.col("id") - F.col("first") + F.col("before")
    return rows.withColumn("part", part).join(starts, ["dim", "pass", "part"]).select(
        "dim", "pass", "node", F.floor(at / window).alias("own")
    )


def _windows(nodes: DataFrame, coded: DataFrame, least: float, window: int) -> DataFrame:
    """Edges between vectors of the same or neighbouring windows: each window goes to its own group and
    to that of the window before."""
    low = F.explode(F.array(F.col("own"), F.col("own") - 1)).alias("low")
    rows = _ordered(coded, window).select("dim", "pass", "node", "own", low).where("low >= 0")
    rows = rows.join(nodes, "node").select(
        "dim", "pass", "low", (F.col("low") + 1).alias("high"), "own", "node", "copies", "x"
    )
    group = ["dim", "pass", "low", "high"]
    return (
        rows.repartition(partitions(nodes), *group)
        .sortWithinPartitions(*group, "own")
        .mapInPandas(_compare(least, group, False, within=True), "node long, root long")
    )


def near_copies(vectors: DataFrame, least: float = 0.95, window: int = WINDOW) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    usable = F.col("vec_id").isNotNull() & finite & F.exists(x, lambda c: c != 0)
    rows = materialise(
        vectors.select(
            "vec_id", F.when(F.coalesce(usable, F.lit(False)), x).alias("x")
        ).withColumn("node", F.when(F.col("x").isNotNull(), F.xxhash64("x", F.size("x"))))
    )
    nodes = materialise(
        rows.where("x IS NOT NULL").groupBy("node").agg(
            F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("copies"),
            F.first("x").alias("x"),
        )
    )
    plan = _plan(nodes, least, window)
    coded = materialise(_coded(nodes, plan))
    seen = nodes.select("node", "copies", "x")
    # the leading hashes of a code, by the depth of the dimension
    lead = F.lit(None).cast("long")
    for dim, (depth, _) in plan.items():
        cut = 7 * (max(depth, ORDERED) - depth)
        lead = F.when(F.col("dim") == dim, F.shiftright("code", cut)).otherwise(lead)
    cells = coded.withColumn("lead", lead).drop("code")
    edges = _windows(seen, coded, least, window).unionByName(
        _meet(seen, cells, ["dim", "pass", "lead"], least, window, count=False, over=window)
    )
    edges = materialise(edges.select(F.col("node").alias("a"), F.col("root").alias("b")))
    roots = materialise(components(edges))
    links = materialise(_meet(seen, roots, ["root"], least, window, count=True))
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = (
        nodes.drop("x").join(roots, "node", "left").join(counts, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    known = materialise(known)
    firsts = known.groupBy("root").agg(F.min("first_id").alias("component"))
    known = known.join(firsts, "root").select(
        F.col("node").alias("__node"), "component",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
    )
    out = rows.drop("x").join(known, F.col("node") == F.col("__node"), "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
