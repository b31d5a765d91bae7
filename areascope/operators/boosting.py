"""Boosted regression trees for model sweeps: every outcome, predictor set, split and group together.

Features are cut into at most `bins` bins at their percentiles; a missing value (null or NaN) has a bin
of its own. A round is one pass over the rows: each task finds the open leaves its rows lie in and adds up
counts and residuals per (group, fit, leaf, feature, bin); histograms of one leaf meet in a task, which adds
them up and picks its best split. Only these splits come to the driver. Trees grow best-first: of the leaves whose
split is known, the one with the largest gain is split next, until a leaf has to be looked at that
is not known. The leaves that the splits to come would make are looked at in the same round, for all
fits, so a tree takes about as many rounds as it is deep. Rows keep their predictions and are written once a tree, so
neither lineage nor work grows with the number of trees.

Rows are placed by group, so a task makes histograms of few groups only; a large group takes several tasks.
Rounds are for fits of more than `FIT_ROWS` training rows in a group. The rows of a smaller one meet in a task, which
grows all its trees. All rows of a bin get the same prediction from trees on one feature: such fits are
grown from one histogram of the outcome, of any number of rows.

A leaf has at least `least` training rows. Missing values go to the side with the larger gain, to
the right if there are none. Ties go to the first feature and the lowest bin.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from areascope.operators.gram import _matrix, _split
from areascope.operators.stats import r2_from_sums
from areascope.session import by_key, materialise

TINY = 1e-9
FLUSH_BYTES = 256 * 2**20
BATCH_BYTES = 16 * 2**20

# A task's histograms cost about as much as a few thousand rows; fewer rows are not spread further.
ROWS_PER_TASK = 20_000

# Fits of at most this many training rows are grown in one task (a byte per row and feature, and the outcome).
FIT_ROWS = 50_000


@dataclass(frozen=True)
class Fit:
    """One fitted model: an outcome, the features it may use (from 0) and the split it is tested on."""

    outcome: int
    cols: tuple[int, ...]
    test: object


@dataclass
class Tree:
    """Nodes in the order they were made; `split` holds (feature, bin, missing goes left, left child)."""

    split: dict[int, tuple[int, int, bool, int]] = field(default_factory=dict)
    size: int = 1
    value: dict[int, float] = field(default_factory=dict)

    def leaves(self, x: np.ndarray, missing: int) -> np.ndarray:
        """The leaf of every row of bin numbers."""
        at = np.zeros(len(x), dtype=np.int64)
        for node, (f, b, left, child) in sorted(self.split.items()):
            here = np.flatnonzero(at == node)
            v = x[here, f]
            goes_left = np.where(v == missing, left, v <= b)
            at[here] = np.where(goes_left, child, child + 1)
        return at

    def predict(self, x: np.ndarray, missing: int) -> np.ndarray:
        values = np.zeros(self.size)
        values[[*self.value]] = [*self.value.values()]
        return values[self.leaves(x, missing)]


def best_split(n: np.ndarray, s: np.ndarray, least: int) -> tuple | None:
    """(gain, feature, bin, missing goes left, (n, sum) left, (n, sum) right) of counts and sums (features x bins,
    the last bin of missing values); None if no split gains."""
    total_n, total_s = n[0].sum(), s[0].sum()
    base = total_s**2 / max(total_n, 1)
    best = None
    ln, ls = np.cumsum(n[:, :-1], axis=1), np.cumsum(s[:, :-1], axis=1)
    for left in (False, True):
        a, b = (ln + n[:, -1:], ls + s[:, -1:]) if left else (ln, ls)
        rn, rs = total_n - a, total_s - b
        good = (a >= least) & (rn >= least)
        if left:
            good &= n[:, -1:] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(good, b**2 / a + rs**2 / rn - base, -np.inf)
        f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if gain[f, cut] > TINY * max(1.0, abs(base)) and (best is None or gain[f, cut] > best[0] + TINY * abs(base)):
            best = (float(gain[f, cut]), int(f), int(cut), left,
                    (int(a[f, cut]), float(b[f, cut])), (int(rn[f, cut]), float(rs[f, cut])))
    return best


class Grower:
    """Best-first growth of one tree from splits that become known round by round."""

    def __init__(self, leaves: int, step: float):
        self.tree, self.limit, self.step = Tree(), leaves, step
        self.known: dict[int, tuple | None] = {}
        self.stats: dict[int, tuple[int, float]] = {}
        self.open, self.chosen = {0}, set()

    def wanted(self) -> list[int]:
        """Leaves to look at before growth can go on; also those that splits to come would make."""
        self._choose()
        if 0 not in self.known:
            return [0]
        unknown = [leaf for leaf in self.open if leaf not in self.known]
        spare = self.limit - len(self.open)
        if not unknown or spare <= 0:
            return []
        ahead = sorted((leaf for leaf in self.open if self.known.get(leaf)), key=self._rank)
        made = [child for leaf in ahead[:spare] for child in self._children(leaf)]
        return sorted({*unknown, *[child for child in made if child not in self.known]})

    def _rank(self, leaf: int) -> tuple[float, int]:
        return -self.known[leaf][0], leaf

    def _choose(self) -> None:
        """The leaves after all splits in the order of their gain, as far as gains are known."""
        self.open, self.chosen = {0}, set()
        while len(self.open) < self.limit and all(leaf in self.known for leaf in self.open):
            able = [leaf for leaf in self.open if self.known[leaf]]
            if not able:
                break
            leaf = min(able, key=self._rank)
            self.chosen.add(leaf)
            self.open = (self.open - {leaf}) | set(self._children(leaf))

    def _children(self, leaf: int) -> tuple[int, int]:
        if leaf not in self.tree.split:
            _, f, b, left, ln, rn = self.known[leaf]
            child = self.tree.size
            self.tree.size += 2
            self.tree.split[leaf] = (f, b, left, child)
            self.stats[child], self.stats[child + 1] = ln, rn
        child = self.tree.split[leaf][3]
        return child, child + 1

    def finish(self) -> Tree:
        """The tree of the chosen splits; what was only looked at ahead is dropped."""
        self.tree.split = {leaf: s for leaf, s in self.tree.split.items() if leaf in self.chosen}
        for leaf in self.open:
            n, s = self.stats.get(leaf, (0, 0.0))
            self.tree.value[leaf] = self.step * s / n if n else 0.0
        return self.tree


def grow(histograms, leaves: int, least: int, step: float) -> Tree:
    """One tree from `histograms(tree, leaf)`: the plain form of what `boost` does for all fits."""
    grower = Grower(leaves, step)
    while nodes := grower.wanted():
        for node in nodes:
            n, s = histograms(grower.tree, node)
            grower.stats.setdefault(node, (int(n[0].sum()), float(s[0].sum())))
            grower.known[node] = best_split(n, s, least)
    return grower.finish()


def leaf_sums(tree: Tree, nodes: list[int], x: np.ndarray, residual: np.ndarray, bins: int) -> np.ndarray:
    """Counts and sums (2 x nodes x features * (bins + 1)) of the rows in each of the tree's `nodes`."""
    width, p = bins + 1, x.shape[1]
    slot = np.full(tree.size, -1)
    slot[nodes] = np.arange(len(nodes))
    slot = slot[tree.leaves(x, bins)]
    here = np.flatnonzero(slot >= 0)
    place = x[here] + np.arange(0, p * width, width)
    place += slot[here, None] * (p * width)
    size = len(nodes) * p * width
    n = np.bincount(place.ravel(), minlength=size)
    s = np.bincount(place.ravel(), np.repeat(residual[here], p), size)
    return np.stack([n, s]).reshape(2, len(nodes), p * width)


def grow_rows(x: np.ndarray, y: np.ndarray, trees: int, leaves: int, least: int, step: float, bins: int) -> list[Tree]:
    """The trees after the mean on rows of bin numbers."""
    pred, forest = np.full(len(y), y.mean()), []
    for _ in range(trees):
        left, grower = y - pred, Grower(leaves, step)
        while nodes := grower.wanted():
            sums = leaf_sums(grower.tree, nodes, x, left, bins).reshape(2, len(nodes), -1, bins + 1)
            for i, node in enumerate(nodes):
                n, s = sums[:, i]
                grower.stats.setdefault(node, (int(n[0].sum()), float(s[0].sum())))
                grower.known[node] = best_split(n, s, least)
        forest.append(grower.finish())
        pred = pred + forest[-1].predict(x, bins)
    return forest


def feature_edges(df: DataFrame, p: int, bins: int) -> list[list[float]]:
    """Interior percentile edges of each place of x, in one pass; edges come to the driver."""
    probs = [i / bins for i in range(1, bins)]
    value = lambda i: F.get(F.col("x"), F.lit(i))
    known = [F.when(~F.isnan(value(i)), value(i)) for i in range(p)]
    row = df.agg(*[F.percentile_approx(k, probs, 10_000).alias(str(i)) for i, k in enumerate(known)]).first()
    return [sorted(set(row[str(i)] or [])) for i in range(p)]


def bin_matrix(x: np.ndarray, edges: list[list[float]], bins: int) -> np.ndarray:
    """Bin numbers: edges strictly below the value; missing values have the last number, `bins`."""
    out = np.empty(x.shape, dtype=np.uint8)
    for i, e in enumerate(edges):
        out[:, i] = np.where(np.isnan(x[:, i]), bins, np.searchsorted(e, x[:, i], side="left"))
    return out


def _rows(df: DataFrame, kept: list[str], convert) -> DataFrame:
    """Rows (kept..., x binary, y, p) by `convert(batch) -> (x, y, p)` in NumPy, written once."""
    schema = T.StructType(
        [df.schema[k] for k in kept]
        + [T.StructField("x", T.BinaryType()), T.StructField("y", T.ArrayType(T.DoubleType())),
           T.StructField("p", T.ArrayType(T.DoubleType()))]
    )
    arrow = to_arrow_schema(schema)

    def lists(values: np.ndarray) -> pa.Array:
        offsets = pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1])
        # a missing outcome stays missing
        return pa.ListArray.from_arrays(offsets, pa.array(values.ravel(), from_pandas=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, pred = convert(batch)
            cells = [None, pa.py_buffer(np.ascontiguousarray(x))]
            codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1]), len(x), cells)
            columns = [*[batch.column(k) for k in kept], codes, lists(y), lists(pred)]
            arrays = [c.cast(f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return materialise(df.mapInArrow(run, schema))


def _bins_of(batch: pa.RecordBatch, p: int) -> np.ndarray:
    codes = batch.column("x").cast(pa.binary())
    start = np.frombuffer(codes.buffers()[1], dtype=np.int32)[codes.offset]
    return np.frombuffer(codes.buffers()[2], dtype=np.uint8, count=len(codes) * p, offset=start).reshape(-1, p)


def _predicted(batch: pa.RecordBatch, n_fits: int) -> np.ndarray:
    """Predictions so far: 0 in rows that have none yet."""
    if not len(batch.column("p").flatten()):
        return np.zeros((batch.num_rows, n_fits))
    return _matrix(batch.column("p"), n_fits)


def _placed(df: DataFrame, groups: list[str]) -> DataFrame:
    """Rows in ranges of (groups, hash): a task has few groups, and a large group several tasks."""
    sizes = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"))
    found = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows")).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(found["groups"], -(-(found["rows"] or 0) // ROWS_PER_TASK), 1)
    return df.repartitionByRange(min(cores, wanted), *groups, F.xxhash64("x", "y"))


def binned(df: DataFrame, p: int, m: int, kept: list[str], groups: list[str] | None = None, bins: int = 64) -> DataFrame:
    """Rows (kept..., x, y, p), placed by group, with x as bin numbers and no predictions yet."""
    if not 2 <= bins <= 254:
        raise ValueError("2 to 254 bins")
    edges = feature_edges(df, p, bins)

    def convert(batch):
        x = bin_matrix(_matrix(batch.column("x"), p), edges, bins)
        return x, _matrix(batch.column("y"), m), np.zeros((len(x), 0))

    return _rows(_placed(df.where("x IS NOT NULL AND y IS NOT NULL"), list(groups or [])), kept, convert)


def residuals(rows: DataFrame, p: int, m: int, outcome: list[int], kept: list[str]) -> DataFrame:
    """The same rows with one outcome per prediction: what it leaves of outcome number `outcome`."""

    def convert(batch):
        left = _matrix(batch.column("y"), m)[:, outcome] - _matrix(batch.column("p"), len(outcome))
        return _bins_of(batch, p), left, np.zeros((len(left), 0))

    return _rows(rows, kept, convert)


def boost(
    rows: DataFrame, p: int, m: int, fits: list[Fit], split: str, groups: list[str] | None = None,
    trees: int = 300, step: float = 0.05, leaves: int = 31, least: int = 20, bins: int = 64,
) -> DataFrame:
    """Rows of `binned` with the prediction of each fit in p, trained on the rows whose `split` is not
    its `test` and that have its outcome."""
    groups, context = list(groups or []), rows.sparkSession.sparkContext
    single = {k: fit for k, fit in enumerate(fits) if len(fit.cols) == 1}
    wide = {k: fit for k, fit in enumerate(fits) if len(fit.cols) != 1}
    grown, few, large = [*wide.values()], {}, set()
    if wide:
        # the first tree is the mean
        found = _round(rows, p, m, grown, split, groups, least, bins, None)
        sizes = {(tuple(r[g] for g in groups), r["fit"]): (r["n"], r["s"]) for r in found}
        means = {key: s / n for key, (n, s) in sizes.items()}
        large = {key for key, (n, _) in sizes.items() if n > FIT_ROWS}
        forests = _small(rows, p, m, grown, split, groups, trees, step, leaves, least, bins, {*sizes} - large)
        few = {key: (means[key], forest) for key, forest in forests.items()}
    for number in range(trees + 1 if large else 0):
        if number == 0:
            forest = {key: Tree(value={0: means[key]}) for key in large}
        else:
            forest = _forest(rows, p, m, grown, split, groups, least, bins, leaves, step, large)
        shared = context.broadcast(forest)  # at most groups x fits x leaves nodes

        def update(batch, shared=shared):
            x, pred = _bins_of(batch, p), _predicted(batch, len(grown)).copy()
            for key, at in _split(batch, groups):
                for k, fit in enumerate(grown):
                    tree = shared.value.get((_plain(key), k))
                    if tree:
                        pred[at, k] += tree.predict(x[np.ix_(at, fit.cols)], bins)
            return x, _matrix(batch.column("y"), m), pred

        rows = _rows(rows, [*groups, split], update)
        shared.unpersist()
    values = _single(rows, p, m, single, split, groups, trees, step, leaves, least, bins) if single else {}
    shared = context.broadcast((few, values))  # groups x fits x bins numbers, and the trees of small fits

    def complete(batch):
        x, pred = _bins_of(batch, p), np.zeros((batch.num_rows, len(fits)))
        pred[:, [*wide]] = _predicted(batch, len(wide))
        few, values = shared.value
        for key, at in _split(batch, groups):
            for place, (k, fit) in enumerate(wide.items()):
                mean, forest = few.get((_plain(key), place), (0.0, []))
                xs = x[np.ix_(at, fit.cols)]
                pred[at, k] += mean + sum(tree.predict(xs, bins) for tree in forest)
            for k, fit in single.items():
                found = values.get((_plain(key), k))
                if found is not None:
                    pred[at, k] = found[x[at, fit.cols[0]]]
        return x, _matrix(batch.column("y"), m), pred

    rows = _rows(rows, [*groups, split], complete)
    shared.unpersist()
    return rows


def _own(batch: pa.RecordBatch, at: np.ndarray, y: np.ndarray, split: str, fit: Fit) -> np.ndarray:
    """The training rows of a fit among the rows `at`."""
    part = batch.column(split).to_pandas().to_numpy()
    return at[(part[at] != fit.test) & ~np.isnan(y[at, fit.outcome])]


def _small(rows, p, m, fits, split, groups, trees, step, leaves, least, bins, asked) -> dict:
    """All trees of each asked (group, fit), whose training rows meet in one task."""
    if not asked:
        return {}
    keys = [rows.schema[g] for g in groups]
    schema = T.StructType([*keys, T.StructField("fit", T.IntegerType()), T.StructField("x", T.BinaryType()),
                           T.StructField("y", T.DoubleType())])
    arrow = to_arrow_schema(schema)
    shared = rows.sparkSession.sparkContext.broadcast(asked)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = _matrix(batch.column("y"), m)
            for key, at in _split(batch, groups) if batch.num_rows else ():
                for k, fit in enumerate(fits):
                    if (_plain(key), k) not in shared.value:
                        continue
                    own = _own(batch, at, y, split, fit)
                    columns = [*[pa.array([v] * len(own), f.type) for v, f in zip(_plain(key), arrow)],
                               pa.array(np.full(len(own), k), pa.int32()),
                               batch.column("x").take(pa.array(own)).cast(pa.binary()),
                               pa.array(y[own, fit.outcome])]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    out = T.StructType([*keys, T.StructField("fit", T.IntegerType()), T.StructField("forest", T.BinaryType())])
    out_arrow = to_arrow_schema(out)

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key = [k.as_py() for k in key]
        x = _bins_of(table.to_batches()[0], p)[:, fits[key[-1]].cols]
        forest = grow_rows(x, table.column("y").to_numpy(), trees, leaves, least, step, bins)
        values = [*key, pickle.dumps(forest)]
        return pa.Table.from_arrays(
            [pa.array([v], f.type) for v, f in zip(values, out_arrow, strict=True)], schema=out_arrow
        )

    placed = by_key(rows.mapInArrow(spread, schema), [*groups, "fit"])
    found = placed.groupBy(*groups, "fit").applyInArrow(solve, out).collect()
    shared.unpersist()
    return {(tuple(r[g] for g in groups), r["fit"]): pickle.loads(r["forest"]) for r in found}


def _single(rows, p, m, fits, split, groups, trees, step, leaves, least, bins) -> dict:
    """The prediction in each bin of each (group, fit on one feature) that has training rows."""
    numbers = np.arange(bins + 1, dtype=np.uint8)[:, None]

    def solve(h: np.ndarray) -> tuple:
        n, s = h[0, 0], h[1, 0]
        pred = np.full(bins + 1, s.sum() / n.sum())
        for _ in range(trees):
            left = s - n * pred

            def histograms(tree, node, left=left):
                here = tree.leaves(numbers, bins) == node
                return (n * here)[None], (left * here)[None]

            pred = pred + grow(histograms, leaves, least, step).predict(numbers, bins)
        return (pred.tolist(),)

    # the outcome itself, whatever is predicted already by other fits
    outcomes = rows.withColumn("p", F.array().cast(rows.schema["p"].dataType))
    sums = _histograms(outcomes, p, m, [*fits.values()], split, groups, bins, None)
    sums = by_key(sums, [*groups, "fit", "node"])  # few bytes, but all trees of a fit are grown from them
    found = _per_node(sums, groups, bins, [("values", T.ArrayType(T.DoubleType()))], solve).collect()
    places = [*fits]
    return {(tuple(r[g] for g in groups), places[r["fit"]]): np.array(r["values"]) for r in found}


def _plain(key: tuple) -> tuple:
    """A group's values as plain Python values."""
    return tuple(v.item() if hasattr(v, "item") else v for v in key)


def _forest(rows, p, m, fits, split, groups, least, bins, leaves, step, keys) -> dict:
    """One tree for each (group, fit) of `keys`."""
    growers = {key: Grower(leaves, step) for key in keys}
    asked = {key: (grower.tree, [0]) for key, grower in growers.items()}
    while asked:
        for r in _round(rows, p, m, fits, split, groups, least, bins, asked):
            grower = growers[tuple(r[g] for g in groups), r["fit"]]
            grower.stats.setdefault(r["node"], (r["n"], r["s"]))
            grower.known[r["node"]] = (
                (r["gain"], r["feature"], r["bin"], r["missing_left"], (r["left_n"], r["left_s"]),
                 (r["n"] - r["left_n"], r["s"] - r["left_s"])) if r["gain"] is not None else None
            )
        asked = {key: (grower.tree, nodes) for key, grower in growers.items() if (nodes := grower.wanted())}
    return {key: grower.finish() for key, grower in growers.items()}


SPLIT = [
    ("n", T.LongType()), ("s", T.DoubleType()), ("gain", T.DoubleType()), ("feature", T.IntegerType()),
    ("bin", T.IntegerType()), ("missing_left", T.BooleanType()), ("left_n", T.LongType()),
    ("left_s", T.DoubleType()),
]


def _round(rows, p, m, fits, split, groups, least, bins, asked) -> list:
    """The best split of every asked leaf: one row per leaf comes to the driver."""

    def solve(h: np.ndarray) -> tuple:
        best = best_split(h[0], h[1], least)
        gain, f, b, left, (ln, ls), _ = best or (None, None, None, None, (None, None), None)
        return int(h[0][0].sum()), float(h[1][0].sum()), gain, f, b, left, ln, ls

    shared = rows.sparkSession.sparkContext.broadcast(asked)
    sums = _histograms(rows, p, m, fits, split, groups, bins, shared)
    found = _per_node(sums, groups, bins, SPLIT, solve).collect()
    shared.unpersist()
    return found


def _histograms(rows, p, m, fits, split, groups, bins, shared) -> DataFrame:
    """Each task's histograms (groups..., fit, node, h) of the leaves asked for; without any, of all roots."""
    width = bins + 1
    schema = T.StructType(
        [*[rows.schema[g] for g in groups], T.StructField("fit", T.IntegerType()),
         T.StructField("node", T.IntegerType()), T.StructField("h", T.BinaryType())]
    )
    arrow = to_arrow_schema(schema)

    def emit(held: dict, asked: dict | None) -> Iterator[pa.RecordBatch]:
        made = [
            [*key, k, node, h[:, i].tobytes()]
            for (key, k), h in held.items()
            for i, node in enumerate([0] if asked is None else asked[key, k][1])
            if h[0, i].any()
        ]
        size = max(1, BATCH_BYTES // (16 * p * width))
        for at in range(0, len(made), size):
            columns = zip(*made[at : at + size], strict=True)
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, held = shared and shared.value, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _bins_of(batch, p)
            y, pred = _matrix(batch.column("y"), m), _predicted(batch, len(fits))
            for key, at in _split(batch, groups):
                key = _plain(key)
                for k, fit in enumerate(fits):
                    tree, nodes = (Tree(), [0]) if asked is None else asked.get((key, k), (None, None))
                    if tree is None:
                        continue
                    own = _own(batch, at, y, split, fit)
                    residual = y[own, fit.outcome] - pred[own, k]
                    h = leaf_sums(tree, nodes, x[np.ix_(own, fit.cols)], residual, bins)
                    held[key, k] = held[key, k] + h if (key, k) in held else h
            if sum(h.nbytes for h in held.values()) > FLUSH_BYTES:
                yield from emit(held, asked)
                held = {}
        yield from emit(held, asked)

    return rows.mapInArrow(run, schema)


def _per_node(partial: DataFrame, groups: list[str], bins: int, fields: list, solve) -> DataFrame:
    """`solve(counts and sums)` of each (group, fit, node), whose histograms meet in one task."""
    keys = [*groups, "fit", "node"]
    out = T.StructType([*[partial.schema[k] for k in keys], *[T.StructField(n, t) for n, t in fields]])
    arrow = to_arrow_schema(out)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h = sum(np.frombuffer(one.as_buffer(), dtype=np.float64) for one in table.column("h"))
        values = [*[k.as_py() for k in key], *solve(h.reshape(2, -1, bins + 1))]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow, strict=True)], schema=arrow)

    return partial.groupBy(*keys).applyInArrow(run, out)


def boosted_scores(
    df: DataFrame, outcomes: list[str], p: int, models: list, cols: list[list[int]], split: str,
    tests: list, groups: list[str] | None = None, **least,
) -> DataFrame:
    """(groups..., outcome, model, split, r2, n_train, n_test) of boosted models on each tested split.

    `models` share their number of trees, step and leaves; `cols` are the places of their features.
    """
    groups, m, first = list(groups or []), len(outcomes), models[0]
    plan = [(model, o, t) for model in range(len(models)) for o in range(m) for t in tests]
    fits = [Fit(o, tuple(cols[model]), t) for model, o, t in plan]
    rows = binned(df, p, m, [*groups, split], groups)
    rows = boost(rows, p, m, fits, split, groups, first.trees, first.step, first.leaves)
    named = [(outcomes[o], models[model].name, t, o) for model, o, t in plan]
    return scores(rows, named, split, groups, **least)


def scores(
    rows: DataFrame, named: list[tuple], split: str, groups: list[str], min_train: int = 1,
    min_test: int = 1, min_rows: int = 1,
) -> DataFrame:
    """R² of each fit, named by (outcome, model, test, place in y), on its tested rows."""
    kind = rows.schema[split].dataType
    spec = F.array(*[
        F.struct(F.lit(outcome).alias("outcome"), F.lit(model).alias("model"),
                 F.lit(t).cast(kind).alias("t"), F.lit(o).alias("o"))
        for outcome, model, t, o in named
    ])
    pairs = F.arrays_zip(spec.alias("s"), F.col("p").alias("p"))
    long = rows.select(*groups, F.col(split).alias("__part"), "y", F.explode(pairs).alias("f")).select(
        *groups, "__part", F.col("f.s.outcome").alias("outcome"), F.col("f.s.model").alias("model"),
        F.col("f.s.t").alias(split), F.get("y", F.col("f.s.o")).alias("__y"), F.col("f.p").alias("__p"),
    ).where(F.col("__y").isNotNull() & ~F.isnan("__y"))
    test = F.col("__part") == F.col(split)
    y, off = F.when(test, F.col("__y")), F.when(test, F.col("__y") - F.col("__p"))
    sums = long.groupBy(*groups, "outcome", "model", split).agg(
        F.sum(off * off).alias("sse"), (F.var_pop(y) * F.count(y)).alias("sst"),
        F.count(F.when(~test, 1)).alias("n_train"), F.count(y).alias("n_test"),
    ).where(
        (F.col("n_train") >= min_train) & (F.col("n_test") >= min_test)
        & (F.col("n_train") + F.col("n_test") >= min_rows)
    )
    r2 = r2_from_sums(F.col("sse"), F.col("sst")).alias("r2")
    return sums.select(*groups, "outcome", "model", split, r2, "n_train", "n_test")
