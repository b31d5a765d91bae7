"""Cross-product sums: the one pass over the rows that every linear model here is solved from.

For rows with features x (array) and outcomes y (array, missing allowed) the sums
Σxxᵀ, Σxy, Σy² and n add up over any split of the rows. Each task adds up its own rows with
NumPy; Spark adds the partial sums up by (keys, outcome, matrix row). A key holding a third of
the rows is thus summed in parallel, and what is shuffled does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BASE = -1  # outcome number of the sums that hold for all outcomes
FLUSH_BYTES = 256 * 2**20  # a task hands its partial sums on when they take this much memory


def gram(df: DataFrame, keys: list[str], p: int, m: int, x: str = "x", y: str = "y") -> DataFrame:
    """Rows (keys..., o, i, v) of the summed cross products.

    o = -1: row i of [XᵀX | XᵀY] with a leading constant feature; i = p+1 and p+2 carry Σy²
    and the number of rows per outcome in their last m places.
    o >= 0: row i of XᵀX over the rows that miss outcome o, to be taken off.
    Rows whose x or y is missing, or whose x has a missing element, are in no sum.
    """
    schema = T.StructType(
        [df.schema[k] for k in keys]
        + [
            T.StructField("o", T.IntegerType()),
            T.StructField("i", T.IntegerType()),
            T.StructField("v", T.ArrayType(T.DoubleType())),
        ]
    )
    arrow_schema = to_arrow_schema(schema)
    p1, width = p + 1, p + 1 + m

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        for batch in batches:
            batch = batch.filter(pc.and_(batch.column(x).is_valid(), batch.column(y).is_valid()))
            if batch.num_rows == 0:
                continue
            xs = _matrix(batch.column(x), p)
            ys = _matrix(batch.column(y), m)
            whole = ~np.isnan(xs).any(axis=1)
            if not whole.all():
                batch, xs, ys = batch.filter(pa.array(whole)), xs[whole], ys[whole]
            for key, rows in _split(batch, keys):
                part = held.setdefault(key, {BASE: np.zeros((p1 + 2, width))})
                _add(part, xs[rows], ys[rows], p1, m)
            if sum(a.nbytes for part in held.values() for a in part.values()) > FLUSH_BYTES:
                yield _emit(held, keys, arrow_schema)
                held = {}
        if held:
            yield _emit(held, keys, arrow_schema)

    partial = df.select(*keys, x, y).mapInArrow(sums, schema)
    total = Summarizer.sum(array_to_vector("v"))
    return partial.groupBy(*keys, "o", "i").agg(vector_to_array(total).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists of one length as matrix rows, null elements as NaN."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype("float64")
    if len(flat) != len(lists) * width:
        raise ValueError(f"every row needs {width} numbers")
    return flat.reshape(-1, width)


def _split(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, np.ndarray]]:
    if not keys:
        yield (), np.arange(batch.num_rows)
        return
    frame = pd.DataFrame({k: batch.column(k).to_pandas() for k in keys})
    for key, rows in frame.groupby(keys, dropna=False, sort=False).indices.items():
        yield (key if isinstance(key, tuple) else (key,)), rows


def _add(part: dict, xs: np.ndarray, ys: np.ndarray, p1: int, m: int) -> None:
    xs = np.hstack([np.ones((len(xs), 1)), xs])
    have = ~np.isnan(ys)
    y0 = np.where(have, ys, 0.0)
    base = part[BASE]
    base[:p1, :p1] += xs.T @ xs
    base[:p1, p1:] += xs.T @ y0
    base[p1, p1:] += (y0 * y0).sum(axis=0)
    base[p1 + 1, p1:] += have.sum(axis=0)
    for o in np.flatnonzero(~have.all(axis=0)):
        gone = xs[~have[:, o]]
        part.setdefault(int(o), np.zeros((p1, p1)))
        part[int(o)] += gone.T @ gone


def _emit(held: dict, keys: list[str], schema: pa.Schema) -> pa.RecordBatch:
    columns: dict[str, list] = {name: [] for name in schema.names}
    for key, part in held.items():
        for o, matrix in part.items():
            for i, row in enumerate(matrix):
                for name, value in zip(keys, key, strict=True):
                    missing = value is None or value != value
                    columns[name].append(None if missing else value)
                columns["o"].append(o)
                columns["i"].append(i)
                columns["v"].append(row)
    return pa.RecordBatch.from_pydict(columns, schema=schema)


class Sums:
    """Cross products of one set of rows, in NumPy, for solving small systems."""

    def __init__(self, base: np.ndarray, missing: dict[int, np.ndarray], p: int):
        self.base, self.missing, self.p1 = base, missing, p + 1

    @classmethod
    def from_rows(cls, rows: pd.DataFrame, p: int, m: int) -> Sums:
        base = np.zeros((p + 3, p + 1 + m))
        missing: dict[int, np.ndarray] = {}
        for o, i, v in zip(rows["o"], rows["i"], rows["v"], strict=True):
            target = base if o == BASE else missing.setdefault(o, np.zeros((p + 1, p + 1)))
            target[i] = v
        return cls(base, missing, p)

    def __add__(self, other: Sums) -> Sums:
        missing = {
            o: self.missing.get(o, 0) + other.missing.get(o, 0)
            for o in self.missing.keys() | other.missing.keys()
        }
        return Sums(self.base + other.base, missing, self.p1 - 1)

    def outcome(self, o: int) -> tuple[np.ndarray, np.ndarray, float, int]:
        """XᵀX, Xᵀy, yᵀy and n over the rows that have outcome o."""
        xx = self.base[: self.p1, : self.p1] - self.missing.get(o, 0)
        column = self.p1 + o
        n = int(round(self.base[self.p1 + 1, column]))
        return xx, self.base[: self.p1, column], float(self.base[self.p1, column]), n


def fit_ridge(xx: np.ndarray, xy: np.ndarray, cols: list[int], alpha: float) -> np.ndarray:
    """Ridge weights on the chosen features; the constant is not penalised."""
    n = xx[0, 0]
    mean_x, mean_y = xx[0, cols] / n, xy[0] / n
    s = xx[np.ix_(cols, cols)] - n * np.outer(mean_x, mean_x) + alpha * np.eye(len(cols))
    r = xy[cols] - n * mean_x * mean_y
    try:
        beta = np.linalg.solve(s, r)
    except np.linalg.LinAlgError:
        beta = np.linalg.lstsq(s, r, rcond=None)[0]
    w = np.zeros(len(xy))
    w[cols] = beta
    w[0] = mean_y - mean_x @ beta
    return w


def fit_bins(xx: np.ndarray, xy: np.ndarray, cols: list[int]) -> np.ndarray:
    """Mean outcome per bin when the chosen features are 0/1 marks of disjoint bins; a bin
    without rows predicts the overall mean."""
    w = np.zeros(len(xy))
    size = np.diag(xx)[cols]
    overall = xy[0] / xx[0, 0]
    w[cols] = np.where(size > 0.5, xy[cols] / np.where(size > 0.5, size, 1.0), overall)
    return w


def score(xx: np.ndarray, xy: np.ndarray, yy: float, w: np.ndarray) -> float:
    """R² of the predictions x·w on the rows behind the sums."""
    n = xx[0, 0]
    if n < 0.5:
        return float("nan")
    sse = yy - 2 * w @ xy + w @ xx @ w
    sst = yy - xy[0] ** 2 / n
    tiny = 1e-12 * max(abs(yy), 1e-300)
    if sst <= tiny:
        return 1.0 if sse <= tiny else 0.0
    return 1.0 - sse / sst
