"""Small summaries of large sets that tasks can carry: a filter of ids, bounded in bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTER_BYTES = 8 << 20
BITS_PER_ID = 16
HASHES = 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finisher of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _places(ids: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        salt = np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        yield mix(ids.astype(np.int64).view(np.uint64) + salt) % np.uint64(bits)


def id_filter(ids: DataFrame, n: int, max_bytes: int = FILTER_BYTES) -> np.ndarray:
    """A Bloom filter of the one column of `ids`, longs without nulls; `n` is their number.

    It never exceeds `max_bytes`: many more ids only make it let more others through.
    """
    bits = min(max_bytes * 8, max(1024, BITS_PER_ID * n + 63 & ~63))
    name = ids.columns[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.unique(np.concatenate(list(_places(batch[name].to_numpy(), bits))))
            word, first = np.unique(at >> np.uint64(6), return_index=True)
            bit = np.uint64(1) << (at & np.uint64(63))
            if len(word):
                filled = np.bitwise_or.reduceat(bit, first)
                yield pd.DataFrame({"word": word.astype(np.int64), "bits": filled.view(np.int64)})

    found = (
        ids.mapInPandas(run, "word long, bits long")
        .groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    )  # at most max_bytes / 8 rows
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def may_hold(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id may be in the filter; never wrong about one that is."""
    out = np.ones(len(ids), dtype=bool)
    for at in _places(ids, 64 * len(words)):
        bit = words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))
        out &= (bit & np.uint64(1)).astype(bool)
    return out


def prefilter(rows: DataFrame, column: str, words: np.ndarray) -> DataFrame:
    """Rows whose id may be in the filter, before a join that settles it."""
    shared = rows.sparkSession.sparkContext.broadcast(words)  # at most max_bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[may_hold(shared.value, batch[column].to_numpy())]

    return rows.where(F.col(column).isNotNull()).mapInPandas(run, rows.schema)
