"""Model sweeps: every outcome, predictor set, fold and group from one pass over the rows.

A model is named by its feature blocks and a learner: "ridge" on any blocks, "bins" on one
binned block. Their fits are solved from the sums of `gram`; the rows are read once however many
models there are. "gbt" is boosted trees on any blocks (`boosting`), a few passes a tree for all
models that share their settings; give it a design with `missing="keep"`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.functions.scalars import additional_var
from areascope.operators.boosting import Fit, binned, boost, boosted_scores, residuals, scores
from areascope.operators.design import Layout
from areascope.operators.gram import BASE, Sums, fit_bins, fit_ridge, gram, score
from areascope.operators.folds import place_groups
from areascope.operators.joins import lookup_join
from areascope.operators.stats import fold_summary, r2_score
from areascope.session import by_key, materialise


OUTCOMES_PER_TASK = 8


@dataclass(frozen=True)
class Model:
    name: str
    blocks: tuple[str, ...]
    learner: str = "ridge"
    alpha: float = 1.0
    trees: int = 300
    step: float = 0.05
    leaves: int = 31


def _fit(model: Model, cols: list[int], xx: np.ndarray, xy: np.ndarray) -> np.ndarray:
    if model.learner == "bins":
        return fit_bins(xx, xy, cols)
    return fit_ridge(xx, xy, cols, model.alpha)


def _per_group(
    sums: DataFrame, groups: list[str], split: str, layout: Layout, solve, fields: list
) -> DataFrame:
    """Run `solve({split value: Sums}, outcome numbers)` on each group's sums.

    A task gets one group and a few outcomes: (splits x features x features) numbers for the
    common sums and as many per outcome with missing rows, whatever the rows were.
    """
    p, m = layout.p, len(layout.outcomes)
    chunks = -(-m // OUTCOMES_PER_TASK)
    chunk = F.when(
        F.col("o") == BASE, F.sequence(F.lit(0), F.lit(chunks - 1))
    ).otherwise(F.array(F.floor(F.col("o") / OUTCOMES_PER_TASK).cast("int")))
    spread = sums.withColumn("__chunk", F.explode(chunk))
    schema = T.StructType([sums.schema[g] for g in groups] + fields)
    names = [f.name for f in fields]
    size = OUTCOMES_PER_TASK

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        parts = {s: Sums.from_rows(part, p, m) for s, part in rows.groupby(split)}
        first = int(key[-1]) * size
        out = pd.DataFrame(
            list(solve(parts, range(first, min(first + size, m)))), columns=names
        )
        for i, g in enumerate(groups):
            out.insert(i, g, key[i])
        return out

    placed = by_key(spread, [*groups, "__chunk"])
    return placed.groupBy(*groups, "__chunk").applyInPandas(run, schema)


_SCORE = [
    T.StructField("outcome", T.StringType()),
    T.StructField("model", T.StringType()),
]
_NUMBERS = [
    T.StructField("r2", T.DoubleType()),
    T.StructField("n_train", T.LongType()),
    T.StructField("n_test", T.LongType()),
]


def _boosted(
    df: DataFrame, layout: Layout, models: list[Model], split: str, tests: list,
    groups: list[str] | None = None, **least,
) -> list[DataFrame]:
    """Scores of the boosted models, those of equal settings together."""
    kinds: dict[tuple, list[Model]] = {}
    for model in models:
        if model.learner == "gbt":
            kinds.setdefault((model.trees, model.step, model.leaves), []).append(model)
    return [
        boosted_scores(
            df, layout.outcomes, layout.p, same, [_places(layout, model) for model in same], split,
            tests, groups, **least,
        )
        for same in kinds.values()
    ]


def _places(layout: Layout, model: Model) -> list[int]:
    return [c - 1 for c in layout.cols(*model.blocks)]


def _together(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def fold_scores(
    df: DataFrame, layout: Layout, models: list[Model], fold: str = "fold",
    groups: list[str] | None = None, min_rows: int = 100,
) -> DataFrame:
    """R² of each model on each fold, fitted on the other folds: (groups..., outcome, model,
    fold, r2, n_train, n_test). Outcomes with under `min_rows` rows in a group are left out."""
    groups = list(groups or [])
    solved = [model for model in models if model.learner != "gbt"]
    if len(solved) < len(models):
        folds = sorted(r[0] for r in df.select(fold).distinct().dropna().collect())
        frames = _boosted(df, layout, models, fold, folds or [0], groups, min_rows=min_rows)
        if solved:
            frames.append(fold_scores(df, layout, solved, fold, groups, min_rows))
        return _together(frames)
    p, m = layout.p, len(layout.outcomes)
    sums = gram(df, [*groups, fold], p, m)
    plan = [(model, layout.cols(*model.blocks)) for model in models]
    outcomes = layout.outcomes

    def solve(parts: dict, numbers: range):
        everything = None
        for s in parts.values():
            everything = s if everything is None else everything + s
        for o in numbers:
            outcome = outcomes[o]
            axx, axy, _, n = everything.outcome(o)
            if n < min_rows:
                continue
            for f, part in parts.items():
                txx, txy, tyy, n_test = part.outcome(o)
                if n_test == 0 or n_test == n:
                    continue
                for model, cols in plan:
                    w = _fit(model, cols, axx - txx, axy - txy)
                    r2 = score(txx, txy, tyy, w)
                    yield outcome, model.name, int(f), r2, n - n_test, n_test

    fields = [*_SCORE, T.StructField("fold", T.IntegerType()), *_NUMBERS]
    return _per_group(sums, groups, fold, layout, solve, fields)


def cv_r2(
    df: DataFrame, layout: Layout, models: list[Model], fold: str = "fold", min_rows: int = 100
) -> DataFrame:
    """Cross-validated R² per outcome and model: mean and std over folds, and rows used."""
    scores = fold_scores(df, layout, models, fold, min_rows=min_rows)
    return fold_summary(
        scores, ["outcome", "model"], "r2", [F.sum("n_test").alias("n")]
    )


def target_folds(sums: DataFrame, group: str, k: int, p: int, m: int) -> DataFrame:
    """(target, group, fold): groups placed largest first in the lightest fold, by each outcome's own rows.

    The sizes are among the sums.
    """
    counts = F.posexplode(F.slice("v", p + 2, m)).alias("target", "n")
    sizes = sums.where((F.col("o") == BASE) & (F.col("i") == p + 2)).select(group, counts)
    sizes = sizes.where("n > 0.5").select("target", group, F.round("n").cast("long").alias("size"))
    return place_groups(materialise(sizes), group, k, sums, ["target"])


def cv_r2_per_target(
    df: DataFrame, layout: Layout, models: list[Model], group: str, k: int = 5, min_rows: int = 100
) -> DataFrame:
    """Cross-validated R² as `cv_r2`, with folds of whole groups laid for each outcome on its own rows.

    The rows are read once: sums are kept per group, and each outcome adds them up by its own folds.
    Groups, not rows, are multiplied by the outcomes.
    """
    p, m = layout.p, len(layout.outcomes)
    plan = [(model, layout.cols(*model.blocks)) for model in models]
    outcomes = layout.outcomes
    sums = materialise(gram(df, [group], p, m))
    placed = sums.join(target_folds(sums, group, k, p, m), group)
    total = Summarizer.sum(array_to_vector("v"))
    folded = (
        placed.where((F.col("o") == BASE) | (F.col("o") == F.col("target")))
        .groupBy("target", "fold", "o", "i").agg(vector_to_array(total).alias("v"))
    )

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        o = int(key[0])
        parts = {f: Sums.from_rows(part, p, m).outcome(o) for f, part in rows.groupby("fold")}
        axx, axy = sum(x[0] for x in parts.values()), sum(x[1] for x in parts.values())
        n, out = sum(x[3] for x in parts.values()), []
        for f, (txx, txy, tyy, n_test) in parts.items():
            if n < min_rows or n_test in (0, n):
                continue
            for model, cols in plan:
                r2 = score(txx, txy, tyy, _fit(model, cols, axx - txx, axy - txy))
                out.append((outcomes[o], model.name, int(f), r2, n - n_test, n_test))
        return pd.DataFrame(out, columns=fields.names)

    fields = T.StructType([*_SCORE, T.StructField("fold", T.IntegerType()), *_NUMBERS])
    scored = by_key(folded, ["target"]).groupBy("target").applyInPandas(run, fields)
    return fold_summary(scored, ["outcome", "model"], "r2", [F.sum("n_test").alias("n")])


def compare_sets(
    df: DataFrame, layout: Layout, models: list[Model], test: str = "test",
    min_train: int = 100, min_test: int = 50,
) -> DataFrame:
    """R² on held-out groups per outcome and predictor set."""
    solved = [model for model in models if model.learner != "gbt"]
    if len(solved) < len(models):
        least = {"min_train": min_train, "min_test": min_test}
        frames = [f.drop(test) for f in _boosted(df, layout, models, test, [True], **least)]
        if solved:
            frames.append(compare_sets(df, layout, solved, test, min_train, min_test))
        return _together(frames)
    p, m = layout.p, len(layout.outcomes)
    sums = gram(df, [test], p, m)
    plan = [(model, layout.cols(*model.blocks)) for model in models]
    outcomes = layout.outcomes

    def solve(parts: dict, numbers: range):
        if len(parts) < 2:
            return
        for o in numbers:
            outcome = outcomes[o]
            xx, xy, _, n_train = parts[False].outcome(o)
            txx, txy, tyy, n_test = parts[True].outcome(o)
            if n_train < min_train or n_test < min_test:
                continue
            for model, cols in plan:
                r2 = score(txx, txy, tyy, _fit(model, cols, xx, xy))
                yield outcome, model.name, r2, n_train, n_test

    return _per_group(sums, [], test, layout, solve, [*_SCORE, *_NUMBERS])


def residual_r2(
    df: DataFrame, layout: Layout, indices: list[Model], second: Model, test: str = "test",
    min_train: int = 100, min_test: int = 50,
) -> DataFrame:
    """Two stages on held-out groups: outcome on an index, its residual on the vectors.

    A residual of a step function or a line is a combination of columns already summed, so
    the second stage needs no second pass. With boosted trees, both stages are.
    """
    if second.learner == "gbt":
        return _boosted_residual(df, layout, indices, second, test, min_train, min_test)
    p, m = layout.p, len(layout.outcomes)
    sums = gram(df, [test], p, m)
    first = [(model, layout.cols(*model.blocks)) for model in indices]
    cols2 = layout.cols(*second.blocks)
    outcomes = layout.outcomes

    def solve(parts: dict, numbers: range):
        if len(parts) < 2:
            return
        for o in numbers:
            outcome = outcomes[o]
            xx, xy, _, n_train = parts[False].outcome(o)
            txx, txy, tyy, n_test = parts[True].outcome(o)
            if n_train < min_train or n_test < min_test:
                continue
            for model, cols in first:
                w = _fit(model, cols, xx, xy)
                r2_index = score(txx, txy, tyy, w)
                w2 = _fit(second, cols2, xx, xy - xx @ w)
                left = tyy - 2 * w @ txy + w @ txx @ w
                r2_left = score(txx, txy - txx @ w, left, w2)
                yield model.name, outcome, r2_index, r2_left, n_train, n_test

    fields = [
        T.StructField("index", T.StringType()), T.StructField("outcome", T.StringType()),
        T.StructField("r2_index", T.DoubleType()), T.StructField("r2_residual", T.DoubleType()),
        T.StructField("n_train", T.LongType()), T.StructField("n_test", T.LongType()),
    ]
    out = _per_group(sums, [], test, layout, solve, fields)
    return out.withColumn(
        "additional_var", additional_var(F.col("r2_residual"), F.col("r2_index"))
    )


def _boosted_residual(
    df: DataFrame, layout: Layout, indices: list[Model], second: Model, test: str,
    min_train: int, min_test: int,
) -> DataFrame:
    """Trees on an index, then trees on what they leave, for all indices and outcomes together."""
    p, m, names = layout.p, len(layout.outcomes), layout.outcomes
    if any(replace(i, name="", blocks=()) != replace(indices[0], name="", blocks=()) for i in indices):
        raise ValueError("the first stages need equal settings")
    plan = [(index, o) for index in indices for o in range(m)]
    least = {"min_train": min_train, "min_test": min_test}
    stage = [Fit(o, tuple(_places(layout, index)), True) for index, o in plan]
    rows = binned(df, p, m, [test])
    rows = boost(rows, p, m, stage, test, None, indices[0].trees, indices[0].step, indices[0].leaves)
    r2_index = scores(rows, [(names[o], index.name, True, o) for index, o in plan], test, [], **least)
    left = residuals(rows, p, m, [o for _, o in plan], [test])
    stage = [Fit(k, tuple(_places(layout, second)), True) for k in range(len(plan))]
    left = boost(left, p, len(plan), stage, test, None, second.trees, second.step, second.leaves)
    named = [(names[o], index.name, True, k) for k, (index, o) in enumerate(plan)]
    r2_left = scores(left, named, test, [], **least).withColumnRenamed("r2", "r2_residual")
    both = r2_index.withColumnRenamed("r2", "r2_index").join(
        r2_left.select("outcome", "model", "r2_residual"), ["outcome", "model"]
    )
    return both.select(
        F.col("model").alias("index"), "outcome", "r2_index", "r2_residual", "n_train", "n_test",
        additional_var(F.col("r2_residual"), F.col("r2_index")).alias("additional_var"),
    )


def sweep_by(
    df: DataFrame, layout: Layout, models: list[Model], group: str, fold: str = "fold",
    min_group: int = 50, min_rows: int = 50,
) -> DataFrame:
    """Per group: R² of each model averaged over folds, then over outcomes.

    Groups with under `min_group` areas are left out; columns r2_<model>, n_outcomes, n_tracts.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n_tracts"))
    scores = fold_scores(df, layout, models, fold, [group], min_rows)
    per_outcome = fold_summary(scores, [group, "outcome", "model"], "r2")
    picks = [
        F.avg(F.when(F.col("model") == model.name, F.col("r2_mean"))).alias(f"r2_{model.name}")
        for model in models
    ]
    means = per_outcome.groupBy(group).agg(
        *picks, F.count_distinct("outcome").alias("n_outcomes")
    )
    return means.join(sizes.where(F.col("n_tracts") >= min_group), group)


def score_measures(
    df: DataFrame, layout: Layout, models: list[Model], test: str = "test",
    min_train: int = 50, min_test: int = 10, least_std: float = 1e-6,
) -> DataFrame:
    """Held-out R² and mean absolute error per outcome and model.

    The error needs predictions, so the fitted weights (one short row per outcome and model)
    are joined back to the test rows.
    """
    p, m = layout.p, len(layout.outcomes)
    sums = gram(df, [test], p, m)
    plan = [(model, layout.cols(*model.blocks)) for model in models]
    outcomes = layout.outcomes

    def solve(parts: dict, numbers: range):
        if len(parts) < 2:
            return
        for o in numbers:
            xx, xy, yy, n_train = parts[False].outcome(o)
            n_test = parts[True].outcome(o)[3]
            if n_train < min_train or n_test < min_test:
                continue
            if yy / n_train - (xy[0] / n_train) ** 2 < least_std**2:
                continue
            for model, cols in plan:
                w = _fit(model, cols, xx, xy)
                yield outcomes[o], model.name, o, list(w), n_train

    fields = [
        *_SCORE, T.StructField("o", T.IntegerType()),
        T.StructField("w", T.ArrayType(T.DoubleType())), T.StructField("n_train", T.LongType()),
    ]
    weights = _per_group(sums, [], test, layout, solve, fields)
    rows = df.where(F.col(test)).select("x", F.posexplode("y").alias("o", "y"))
    size = len(outcomes) * len(models)  # rows of the weight table
    line = F.aggregate(
        F.zip_with("x", F.slice("w", 2, p), lambda a, b: a * b), F.get("w", F.lit(0)),
        lambda acc, v: acc + v,
    )
    predicted = lookup_join(rows, weights, "o", "inner", at_most=size).withColumn("p", line)
    scored = r2_score(predicted, "y", "p", ["outcome", "model", "n_train"])
    return scored.select(
        "outcome", "model", "r2", "mae", "n_train", F.col("n").alias("n_test")
    )
