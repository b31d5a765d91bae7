"""Logistic models of yes/no outcomes of people from what is known of their areas.

People of one area share its features, so they are counted by area first: the likelihood only needs
how many there are and how many say yes. Each Newton step is one pass over the areas for all outcomes
and predictor sets at once: tasks add up weighted cross products with NumPy, Spark adds up the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from areascope.functions.ranking import value_edges, with_bucket
from areascope.operators.design import Layout, known
from areascope.operators.gram import _matrix
from areascope.operators.joins import lookup_join
from areascope.operators.sweeps import Model
from areascope.session import ROWS_PER_BUCKET, materialise

Weights = dict[tuple[str, str], np.ndarray]


def count_people(people: DataFrame, key: str, outcomes: list[str]) -> DataFrame:
    """(key, yes_<outcome>..., no_<outcome>...) per area. Outcomes are true/false or 1/0; a missing
    one counts for neither, any other number stops the job. People without an area are left out."""
    def value(c: str):
        v = known(F.col(c))
        wrong = F.raise_error(F.concat(F.lit(f"{c} is neither 0 nor 1: "), v.cast("string")))
        return F.when(v.isNull() | v.isin(0.0, 1.0), v).otherwise(wrong.cast("double"))

    aggs = [F.sum(F.coalesce(value(c), F.lit(0.0))).alias(f"yes_{c}") for c in outcomes]
    aggs += [F.sum(F.coalesce(1 - value(c), F.lit(0.0))).alias(f"no_{c}") for c in outcomes]
    return people.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def counted(outcomes: list[str]) -> list[str]:
    """The columns of count_people, as outcomes of a design."""
    return [f"yes_{c}" for c in outcomes] + [f"no_{c}" for c in outcomes]


def fit_logistic(
    rows: DataFrame, layout: Layout, models: list[Model], outcomes: list[str], steps: int = 25,
    tolerance: float = 1e-8,
) -> Weights:
    """Weights (constant first) per outcome and model of a design over counted outcomes.

    Newton's method with a penalty of alpha / 2 on the squared weights, the constant free. A step that
    makes things worse is halved. What comes to the driver is a matrix of features x features per outcome
    and model and does not grow with the rows. An outcome nobody has keeps weights of 0.
    """
    specs = _specs(layout, models, outcomes)
    rows = materialise(rows.select("x", "y"))
    weights = [np.zeros(len(cols)) for _, _, cols, _ in specs]
    best: list[tuple | None] = [None] * len(specs)
    open_ = set(range(len(specs)))
    for _ in range(steps):
        found = _pass(rows, layout, specs, weights, outcomes, sorted(open_))
        for s in sorted(open_):
            alpha = specs[s][3]
            ridge = alpha * np.r_[0.0, np.ones(len(weights[s]) - 1)]
            hessian, slope, loss = found.get(s, (None, None, None))
            if hessian is None:
                open_.discard(s)
                continue
            loss += 0.5 * (ridge * weights[s] ** 2).sum()
            if best[s] is not None and loss > best[s][0] + 1e-12 * abs(best[s][0]):
                weights[s] = (weights[s] + best[s][1]) / 2
                if np.abs(weights[s] - best[s][1]).max() < tolerance:
                    weights[s] = best[s][1]
                    open_.discard(s)
                continue
            best[s] = (loss, weights[s])
            system, right = hessian + np.diag(ridge), slope - ridge * weights[s]
            step = np.linalg.lstsq(system, right, rcond=None)[0]
            if np.abs(step).max() < tolerance:
                open_.discard(s)
                continue
            weights[s] = weights[s] + step
        if not open_:
            break
    # a last step that was not looked at any more is not taken
    final = [best[s][1] if best[s] is not None else weights[s] for s in range(len(specs))]
    return {(o, name): w for (o, name, _, _), w in zip(specs, final, strict=True)}


def _specs(layout: Layout, models: list[Model], outcomes: list[str]) -> list[tuple]:
    return [
        (o, m.name, np.array([0, *layout.cols(*m.blocks)]), m.alpha) for o in outcomes for m in models
    ]


def _read(batch: pa.RecordBatch, p: int, m: int) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Features with the constant, counts (yes | no), and the rows that have all features."""
    batch = batch.filter(pc.and_(batch.column("x").is_valid(), batch.column("y").is_valid()))
    xs, ys = _matrix(batch.column("x"), p), np.nan_to_num(_matrix(batch.column("y"), 2 * m))
    whole = ~np.isnan(xs).any(axis=1)
    xs = np.hstack([np.ones((len(xs), 1)), xs])
    return xs[whole], ys[whole], batch.filter(pa.array(whole))


def _pass(rows, layout, specs, weights, outcomes, chosen) -> dict[int, tuple]:
    p, m = layout.p, len(outcomes)
    place = {o: i for i, o in enumerate(outcomes)}
    plan = [(s, place[specs[s][0]], specs[s][2], weights[s]) for s in chosen]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys, _ = _read(batch, p, m)
            for s, o, cols, w in plan:
                yes, n = ys[:, o], ys[:, o] + ys[:, m + o]
                seen = n > 0
                if not seen.any():
                    continue
                x, yes, n = xs[np.ix_(seen, cols)], yes[seen], n[seen]
                eta = x @ w
                chance = 0.5 * (1 + np.tanh(eta / 2))
                part = held.setdefault(s, np.zeros((len(cols) + 1, len(cols) + 1)))
                part[:-1, :-1] += x.T @ (x * (n * chance * (1 - chance))[:, None])
                part[:-1, -1] += x.T @ (yes - n * chance)
                part[-1, -1] += (n * np.logaddexp(0, eta) - yes * eta).sum()
        for s, part in held.items():
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([s] * len(part), pa.int32()), pa.array(range(len(part)), pa.int32()),
                    pa.array(list(part), pa.list_(pa.float64())),
                ],
                names=["s", "i", "v"],
            )

    partial = rows.mapInArrow(sums, "s int, i int, v array<double>")
    added = partial.groupBy("s", "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("v")
    )
    out: dict[int, tuple] = {}
    for s, part in added.toPandas().groupby("s"):
        whole = np.stack(part.sort_values("i")["v"].to_list())
        out[int(s)] = (whole[:-1, :-1], whole[:-1, -1], float(whole[-1, -1]))
    return out


def predict_logistic(
    rows: DataFrame, layout: Layout, models: list[Model], outcomes: list[str], weights: Weights,
    keep: list[str] | None = None,
) -> DataFrame:
    """(keep..., outcome, model, yes, no, chance, loss): predicted chance and summed log loss of the
    people of each area who have the outcome."""
    keep, p, m = list(keep or []), layout.p, len(outcomes)
    plan = [
        (outcomes.index(o), o, name, cols, weights[o, name])
        for o, name, cols, _ in _specs(layout, models, outcomes)
    ]
    values = ["yes", "no", "chance", "loss"]
    schema = T.StructType([rows.schema[k] for k in keep])
    schema = schema.add("outcome", "string").add("model", "string")
    for name in values:
        schema = schema.add(name, "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            xs, ys, batch = _read(batch, p, m)
            for o, outcome, name, cols, w in plan:
                yes, no = ys[:, o], ys[:, m + o]
                eta = xs[:, cols] @ w
                loss = (yes + no) * np.logaddexp(0, eta) - yes * eta
                seen = yes + no > 0
                kept = batch.filter(pa.array(seen))
                n = int(seen.sum())
                columns = [kept.column(k) for k in keep] + [pa.array([outcome] * n), pa.array([name] * n)]
                numbers = (yes, no, 0.5 * (1 + np.tanh(eta / 2)), loss)
                columns += [pa.array(v[seen]) for v in numbers]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.select(*keep, "x", "y").mapInArrow(score, schema)


def auc(
    df: DataFrame, keys: list[str], score: str, yes: str, no: str,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(keys..., auc): chance that a yes scores above a no, ties half, from counts per score.

    Equal scores are counted together; scores are cut into buckets, so no key is sorted as a whole.
    Missing for a key without a yes or without a no.
    """
    v, b, up, down = "__v", "__b", "__yes", "__no"
    data = df.select(*keys, F.col(score).alias(v), F.col(yes).alias(up), F.col(no).alias(down))
    data = materialise(data.where(F.col(v).isNotNull()))
    edges = value_edges(data, v, rows_per_bucket)
    both = [F.sum(up).alias(up), F.sum(down).alias(down)]
    freq = with_bucket(data, v, edges, b).groupBy(*keys, b, v).agg(*both)
    before = W.partitionBy(*keys).orderBy(b).rowsBetween(W.unboundedPreceding, -1)
    below = freq.groupBy(*keys, b).agg(F.sum(down).alias("__n"))
    below = below.select(*keys, b, F.coalesce(F.sum("__n").over(before), F.lit(0.0)).alias("__below"))
    inside = W.partitionBy(*keys, b).orderBy(v).rowsBetween(W.unboundedPreceding, W.currentRow)
    wins = lookup_join(freq.withColumn("__run", F.sum(down).over(inside)), below, [*keys, b], "inner")
    lower = F.col("__below") + F.col("__run") - F.col(down) / 2
    total = wins.groupBy(*keys).agg(
        F.sum(F.col(up) * lower).alias("__wins"), F.sum(up).alias(up), F.sum(down).alias(down)
    )
    return total.select(*keys, F.try_divide("__wins", F.col(up) * F.col(down)).alias("auc"))


def held_out_logistic(
    rows: DataFrame, layout: Layout, models: list[Model], outcomes: list[str],
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(outcome, model, n_train, n_test, log_loss, auc) of models fitted where `test` is false and
    judged where it is true; n counts people. Outcomes without anybody on the test side have no row."""
    rows = materialise(rows.select("test", "x", "y"))
    weights = fit_logistic(rows.where("NOT test"), layout, models, outcomes)
    scored = materialise(predict_logistic(rows, layout, models, outcomes, weights, ["test"]))
    people = F.col("yes") + F.col("no")
    by = ["outcome", "model"]
    sums = scored.groupBy(*by).agg(
        F.sum(F.when(~F.col("test"), people).otherwise(0)).cast("long").alias("n_train"),
        F.sum(F.when(F.col("test"), people).otherwise(0)).cast("long").alias("n_test"),
        F.sum(F.when(F.col("test"), F.col("loss"))).alias("loss"),
    )
    ranked = auc(scored.where("test"), by, "chance", "yes", "no", rows_per_bucket)
    return sums.join(ranked, by).select(
        *by, "n_train", "n_test", (F.col("loss") / F.col("n_test")).alias("log_loss"), "auc"
    )
