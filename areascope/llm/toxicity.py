"""Toxicity by a chain of linear classifiers.

Categories are predicted one after the other. Each has a logistic model on the terms of a document
and on the probabilities of the categories before it; in training these probabilities come from
models that haven't seen the document (out of fold), so a later model learns how far to trust them.

Terms are byte n-grams within words, so that inflected forms share them. The vocabulary holds the
terms that labelled toxic documents use far more often than others; a document's features are which
of them it has, however long it is.

Categories are columns of the labels, in the order given, and last `toxic`, whose probability
decides. Labels of one flag have none before it: then two are derived from it, `dense` (toxic, and
much of the text is made of such terms) and `strong` (toxic, with several of them).

Vocabulary and models are fitted on at most SAMPLE labelled documents, chosen by hash; every
document is scored whole.

Defined results: missing or empty text has no terms and is scored by the models' constants. A
missing label is not learned from, a missing category is one that the document isn't in; of repeated
labels the largest counts. Without any toxic label nothing is toxic. Repeated rows get equal answers.
Other columns of the tables, whatever their names, are not read. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.session import materialise

SAMPLE = 20_000
VOCABULARY = 2048
GRAMS = (4, 5)
MIN_DOCS = 5
MIN_RATIO = 12.0
FOLDS = 3
CATEGORIES = ("dense", "strong", "toxic")
SEED = 23
SPACES = np.array([9, 10, 11, 12, 13, 32])


def terms(text: str | None) -> np.ndarray:
    """Codes of the byte n-grams inside words, with a space in front of a word, all occurrences."""
    raw = np.frombuffer(f" {text or ''}".lower().encode("utf-8", "replace"), dtype=np.uint8)
    space = np.isin(raw, SPACES)
    wide = np.where(space, 32, raw).astype(np.uint64)
    inner = space.astype(np.int32).cumsum()  # equal inside a word and the space before it
    out = []
    for n in GRAMS:
        if len(wide) < n:
            continue
        code = np.full(len(wide) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | wide[k : len(wide) - n + 1 + k]
        out.append(code[inner[n - 1 :] == inner[: len(wide) - n + 1]])
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, dtype=np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents per term, for the rows of a task."""
    found = []
    for batch in batches:
        seen = [np.unique(terms(t)) for t in batch["text"]]
        seen = np.concatenate(seen) if seen else np.zeros(0, dtype=np.int64)
        found.append(np.stack(np.unique(seen, return_counts=True), axis=1))
    rows = np.concatenate(found) if found else np.zeros((0, 2), dtype=np.int64)
    if len(rows):
        yield pd.DataFrame(rows, columns=["term", "n"]).groupby("term", as_index=False).sum()


def _term_counts(sample: DataFrame, name: str) -> DataFrame:
    counted = sample.mapInPandas(_count, "term long, n long")
    return counted.groupBy("term").agg(F.sum("n").alias(name))


def vocabulary(sample: DataFrame, size: int = VOCABULARY) -> np.ndarray:
    """Sorted codes of the `size` terms most tied to the toxic label, of all terms of the sample."""
    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = kinds.get(1, 0), kinds.get(0, 0)
    if not toxic:
        return np.zeros(0, dtype=np.int64)
    often = _term_counts(sample.where("toxic = 1"), "had").where(F.col("had") >= MIN_DOCS)
    others = _term_counts(sample.where("toxic = 0"), "others")
    both = often.join(others, "term", "left").fillna(0, ["others"])
    ratio = (F.col("had") / toxic) / ((F.col("others") + 0.5) / (clean + 1))
    strength = F.log(ratio) * F.sqrt("had")
    best = both.where(ratio >= MIN_RATIO).orderBy(strength.desc(), "term").limit(size).collect()
    return np.sort(np.array([r["term"] for r in best], dtype=np.int64))


class Lookup:
    """Places of terms in the vocabulary; a small table of hashes turns most others away."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.maybe = np.zeros(1 << 18, dtype=bool)
        self.maybe[self._slot(words)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)

    def __call__(self, text: str | None) -> np.ndarray:
        """Place of every occurrence."""
        codes = terms(text)
        codes = codes[self.maybe[self._slot(codes)]]
        if not len(codes) or not len(self.words):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.words, codes), len(self.words) - 1)
        return at[self.words[at] == codes]


def _logistic(lists: list[np.ndarray], more: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    """Weights of terms, of earlier probabilities and a constant; rows are lists of term places."""
    row = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    col = np.concatenate(lists) if lists else np.zeros(0, dtype=np.int64)
    w = step = np.zeros(size + more.shape[1] + 1)
    rate = 4.0 / (1 + 0.25 * max(1.0, np.mean([len(x) for x in lists] or [1])))
    decay = 1e-5
    for t in range(400):
        seen = np.bincount(row, step[col], len(lists)) + more @ step[size:-1] + step[-1]
        wrong = (1 / (1 + np.exp(-np.clip(seen, -30, 30))) - y) / max(1, len(y))
        grad = np.concatenate([np.bincount(col, wrong[row], size), wrong @ more, [wrong.sum()]])
        new = step - rate * (grad + decay * step)
        step = new + t / (t + 3) * (new - w)
        w = new
    return w


def _probability(w: np.ndarray, at: list[np.ndarray], more: np.ndarray, size: int) -> np.ndarray:
    terms_part = np.array([w[x].sum() for x in at]) if at else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(terms_part + more @ w[size:-1] + w[-1], -30, 30)))


def _fit_fold(size: int, fold: int, category: int):
    """Models of one category: from all rows (fold -1) or from all rows but one fold's."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "fold"])
        held = int(rows["held"].iloc[0])
        use = rows[rows["fold"] != held]
        more = np.array(use["earlier"].tolist(), dtype=float).reshape(len(use), category)
        y = np.array([t[category] for t in use["targets"]], dtype=float)
        w = _logistic(use["at"].tolist(), more, y, size)
        return pd.DataFrame({"held": [held], "w": [w.tolist()]})

    return run


def fit_chain(
    rows: DataFrame, size: int, folds: int = FOLDS
) -> tuple[list[np.ndarray], float]:
    """Weights per category from (doc_id, fold, at, targets), a bounded sample, and a threshold.

    The threshold separates the last category best, by F1 of its out-of-fold probabilities.

    Each category is one job with a task per fold and one for all rows; the out-of-fold
    probabilities become columns of the next category's rows.
    """
    kinds = len(rows.select("targets").first()["targets"])
    rows = rows.withColumn("earlier", F.array().cast("array<double>"))
    chain = []
    for category in range(kinds):
        rows = materialise(rows)
        held = F.explode(F.array(*[F.lit(k) for k in range(-1, folds)])).alias("held")
        fitted = (
            rows.select("*", held)
            .groupBy("held")
            .applyInPandas(_fit_fold(size, folds, category), "held int, w array<double>")
            .collect()  # folds + 1 lists of size + kinds numbers
        )
        models = {r["held"]: np.array(r["w"]) for r in fitted}
        chain.append(models[-1])

        def add(batches, models=models):
            for batch in batches:
                more = np.array(batch["earlier"].tolist(), dtype=float).reshape(len(batch), -1)
                out = np.zeros(len(batch))
                at = batch["at"].tolist()
                for fold in np.unique(batch["fold"]):
                    k = np.flatnonzero(batch["fold"] == fold)
                    w = models.get(int(fold), models[-1])
                    out[k] = _probability(w, [at[i] for i in k], more[k], size)
                yield batch.assign(earlier=[[*e, p] for e, p in zip(more.tolist(), out)])

        rows = rows.mapInPandas(add, rows.schema)
    last = F.element_at("earlier", -1).alias("p"), F.element_at("targets", -1).alias("y")
    seen = rows.select(*last).toArrow()  # the bounded sample, two numbers a row
    return chain, best_threshold(seen["p"].to_numpy(), seen["y"].to_numpy())


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The middle between the two probabilities that part the classes with the highest F1."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + max(1, y.sum()))
    cut = np.append(p[1:] < p[:-1], True)  # not between equal probabilities
    k = int(np.argmax(np.where(cut, f1, -1)))
    below = p[k + 1] if k + 1 < len(p) else 0.0
    return float((p[k] + below) / 2)


def training_rows(sample: DataFrame, words: np.ndarray, folds: int = FOLDS) -> DataFrame:
    """(doc_id, fold, at, targets): present terms and the categories, derived ones if there are none."""
    lookup = Lookup(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at, targets = [], []
            for text, toxic, marks in zip(batch["text"], batch["toxic"], batch["marks"]):
                seen = lookup(text)
                kinds = np.unique(seen)
                words_in = max(1, len((text or "").split()))
                dense = toxic and len(seen) / words_in >= 0.05
                strong = toxic and len(kinds) >= 8
                before = [int(x) for x in marks] if len(marks) else [int(dense), int(strong)]
                at.append(kinds)
                targets.append([*before, int(toxic)])
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "fold": batch["fold"], "at": at, "targets": targets}
            )

    fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(folds)).cast("int").alias("fold")
    return sample.select("doc_id", "text", "toxic", "marks", fold).mapInPandas(
        run, "doc_id long, fold int, at array<long>, targets array<int>"
    )


def labelled_sample(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, categories: Sequence[str] = ()
) -> DataFrame:
    """(doc_id, text, toxic, marks) of at most `sample` labelled documents, chosen by hash."""
    order = F.xxhash64(F.lit(SEED), "doc_id")
    marks = [F.coalesce(F.max(F.col(c).cast("int")), F.lit(0)) for c in categories]
    ids = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(
            F.max("toxic").cast("int").alias("toxic"),
            F.array(*marks).cast("array<int>").alias("marks"),
        )
        .orderBy(order, "doc_id").limit(sample)
    )
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text")
    return rows.join(F.broadcast(ids), "doc_id")  # at most `sample` ids


def score(
    docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float | None = None,
    categories: Sequence[str] = (),
) -> DataFrame:
    """(doc_id, toxic, score, one probability per category) of every document.

    `categories` are columns of `labels`, 0 or 1 (or boolean), predicted in this order before `toxic`.
    """
    names = (*categories, "toxic") if categories else CATEGORIES
    chosen = materialise(labelled_sample(docs, labels, sample, categories))
    words = vocabulary(chosen)
    chain, best = [], 1.0
    if len(words):
        chain, best = fit_chain(materialise(training_rows(chosen, words)), len(words))
    threshold = best if threshold is None else threshold
    model = docs.sparkSession.sparkContext.broadcast((Lookup(words), chain))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, chain = model.value
        size = len(lookup.words)
        for batch in batches:
            at = [np.unique(lookup(t)) for t in batch["text"]]
            found = np.zeros((len(batch), 0))
            for w in chain:
                p = _probability(w, at, found, size)
                found = np.hstack([found, p[:, None]])
            if not chain:
                found = np.zeros((len(batch), len(names)))
            out = pd.DataFrame({"doc_id": batch["doc_id"], "toxic": found[:, -1] >= threshold})
            out["score"] = found[:, -1]
            for i, name in enumerate(names):
                out[f"p_{name}"] = found[:, i]
            yield out

    kinds = ", ".join(f"`p_{c}` double" for c in names)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, toxic boolean, score double"
    return docs.select("doc_id", "text").mapInPandas(run, f"{schema}, {kinds}")
