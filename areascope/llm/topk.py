"""Exact top-k by inner product: candidates in buckets of like length, pruned per query and bucket.

Candidates are ordered by length, longest first, and read in buckets. A query knows a score that ten
candidates reach (from the longest ones). Against a bucket that score is a cosine that a candidate
must reach at least: a bucket with a cosine above 1 is skipped, a high one prunes by the query's
largest coordinates, a low one by length. What is left is verified by exact integer products.

Queries go to the tasks in blocks of bounded bytes; candidates are never shuffled per query. A task
keeps only its ten best per query, and none below the known score.

Defined results: vectors that are missing, empty or hold a missing or non-finite component take no
part, nor does a pair of different dimensions. A candidate with the query's vec_id is its own;
repeated candidates count each. A missing vec_id is a candidate and comes last among ties.
A query needs a vec_id; equal rows are one query. Vectors with
a component beyond 2**53 after scaling take no part: doubles hold no further digits there. Scores stop at
the range of a long. Other columns are ignored, whatever their names; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.llm.text import partitions
from areascope.session import materialise

SEED_ROWS = 4096
BLOCK_BYTES = 32 << 20
HIGH_COSINE = 0.5
FOCUS = 4
EXACT = float(1 << 53)
FOUND = "query long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v array<long>, length): complete vectors as floor(scale * x)."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    rows = vectors.select("vec_id", x.alias("x")).where(
        F.col("x").isNotNull() & (F.size("x") > 0)
        & F.forall("x", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    )
    # beyond that a double has no exact integer, and sums of products would overflow unseen
    rows = rows.where(F.forall("x", lambda c: F.abs(c * scale) <= EXACT))
    rows = rows.select(
        "vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v")
    )
    squares = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return rows.withColumn("length", F.sqrt(squares))


def _scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Inner products of integers: in doubles while they are exact, else in Python's integers."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * q.shape[1]
    if bound < EXACT:
        return (q.astype(np.float64) @ p.astype(np.float64).T).astype(np.int64)
    wide = q.astype(object) @ p.astype(object).T
    return np.clip(wide, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class Block:
    """Queries of one dimension with the scores that their results must reach."""

    def __init__(self, number, ids, vectors, least):
        self.number, self.ids, self.v, self.least = number, ids, vectors, least
        self.length = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        unit = vectors / np.maximum(self.length, 1e-300)[:, None]
        self.unit = unit
        self.focus = np.argsort(-np.abs(unit), axis=1)[:, :FOCUS]

    def search(self, ids, v, length, k):
        """Yields (query row, candidate rows, scores) that may be among the k best."""
        top = length.max(initial=0.0)
        reach = self.length * top
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(reach > 0, self.least / np.maximum(reach, 1e-300), -1.0)
        # a query or bucket of zeros scores 0 everywhere
        cosine = np.where((reach == 0) & (self.least > 0), 2.0, cosine)
        active = cosine <= 1 + 1e-9
        unit = None
        by_length = np.flatnonzero(active & (cosine < HIGH_COSINE))
        if len(by_length):
            need = self.least[by_length] / np.maximum(self.length[by_length], 1e-300)
            least = need.min() if (self.length[by_length] > 0).all() else -1.0
            rows = np.flatnonzero(length >= least * (1 - 1e-9) - 1e-9)
            scores = _scores(self.v[by_length], v[rows])
            for i, q in enumerate(by_length):
                yield q, rows, scores[i]
        for q in np.flatnonzero(active & (cosine >= HIGH_COSINE)):
            if unit is None:
                unit = v / np.maximum(length, 1e-300)[:, None]
            # a candidate within `angle` of the query: bounds of its angle to an axis
            angle = np.arccos(min(1.0, cosine[q] - 1e-9))
            keep = np.ones(len(v), dtype=bool)
            for f in self.focus[q]:
                own = np.arccos(np.clip(self.unit[q, f], -1, 1))
                low = np.cos(min(np.pi, own + angle)) - 1e-9
                high = np.cos(max(0.0, own - angle)) + 1e-9
                keep &= (unit[:, f] >= low) & (unit[:, f] <= high)
            rows = np.flatnonzero(keep)
            if len(rows):
                yield q, rows, _scores(self.v[q : q + 1], v[rows])[0]


def _best(found: list, k: int) -> list:
    """The k best (score, vec_id) in order; a missing vec_id is last among ties."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]


def _search(blocks: list[Block], k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[tuple[int, int], list] = {}
        for batch in batches:  # rows of like length, the longest first: a bucket
            dims = batch["v"].map(len).to_numpy()
            ids, missing = batch["id"].to_numpy(), batch["nameless"].to_numpy(dtype=bool)
            for block in blocks:
                at = np.flatnonzero(dims == block.v.shape[1])
                if not len(at):
                    continue
                v = np.stack(batch["v"].to_numpy()[at]).astype(np.int64)
                own, gone = ids[at], missing[at]
                lengths = batch["length"].to_numpy()[at]
                for q, rows, scores in block.search(own, v, lengths, k):
                    other = gone[rows] | (own[rows] != block.ids[q])
                    good = np.flatnonzero(other & (scores >= block.least[q]))
                    if not len(good):
                        continue
                    if len(good) > k:
                        # all that tie with the k-th stay for the order by vec_id
                        kth = np.partition(scores[good], len(good) - k)[len(good) - k]
                        good = good[scores[good] >= kth]
                    new = [
                        (int(scores[i]), None if gone[rows[i]] else int(own[rows[i]])) for i in good
                    ]
                    key = (block.number, int(q))
                    best[key] = _best(best.get(key, []) + new, k)
        numbers, vec_ids, scores = [], [], []
        for (b, q), found in best.items():
            for score, vec_id in found:
                numbers.append((b << 32) + q)
                vec_ids.append(vec_id)
                scores.append(score)
        yield pd.DataFrame(
            {
                "query": np.array(numbers, dtype=np.int64),
                "vec_id": pd.array(vec_ids, dtype="Int64"),
                "score": np.array(scores, dtype=np.int64),
            }
        )

    return run


def top_k(
    candidates: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024,
    seed_rows: int = SEED_ROWS, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query, ties to small vec_id."""
    spark = candidates.sparkSession
    n = partitions(candidates)
    index = integer_vectors(candidates, scale).select(
        F.coalesce("vec_id", F.lit(0)).cast("long").alias("id"),
        F.col("vec_id").isNull().alias("nameless"), "v", "length",
    )
    index = materialise(
        index.repartitionByRange(n, F.col("length").desc(), "id").sortWithinPartitions(
            F.col("length").desc()
        )
    )
    wanted = materialise(
        integer_vectors(queries.where(F.col("vec_id").isNotNull()), scale)
        .select("vec_id", "v").distinct()
        .withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 20)))
    )
    size = wanted.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim")).first()
    if not size["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pieces = -(-size["n"] * size["dim"] * 24 // block_bytes)
    seeds = index.orderBy(F.col("length").desc()).limit(seed_rows)
    results = []
    for piece in range(pieces):
        part = wanted.where(F.pmod("part", F.lit(pieces)) == piece).select("vec_id", "v")
        rows = part.collect()  # bounded by block_bytes
        by_dim: dict[int, list] = {}
        for r in rows:
            by_dim.setdefault(len(r["v"]), []).append(r)
        blocks = []
        for number, (_, group) in enumerate(sorted(by_dim.items())):
            ids = np.array([r["vec_id"] for r in group], dtype=np.int64)
            v = np.array([r["v"] for r in group], dtype=np.int64)
            blocks.append(Block(number, ids, v, np.full(len(ids), -np.inf)))
        found = seeds.mapInPandas(_search(blocks, k), FOUND)
        reached = found.groupBy("query").agg(
            F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("score"), False).alias("s")
        )
        for r in reached.collect():  # one row per query of the block
            if r["n"] >= k:
                blocks[r["query"] >> 32].least[r["query"] & 0xFFFFFFFF] = r["s"][k - 1]
        names = spark.createDataFrame(
            [((b.number << 32) + i, int(x)) for b in blocks for i, x in enumerate(b.ids)],
            "query long, query_id long",
        )
        found = index.mapInPandas(_search(blocks, k), FOUND)
        order = W.partitionBy("query").orderBy(
            F.col("score").desc(), F.col("vec_id").asc_nulls_last()
        )
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        results.append(ranked.join(names, "query").select("query_id", "rank", "vec_id", "score"))
    out = results[0] if pieces == 1 else materialise(results[0])
    for more in results[1:]:
        out = out.unionByName(materialise(more))
    return out
