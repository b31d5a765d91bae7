"""Language ID by error-correcting output codes.

Every language has a codeword of bits. For each bit a binary classifier on hashed byte n-grams
learns which half of the languages a text belongs to; a text goes to the language whose codeword is
nearest by a loss that weighs each bit by how well its classifier did on rows it hadn't seen. With
the distance between codewords a few wrong bits do no harm, and a text whose two nearest codewords
are close is marked ambiguous.

Classifiers are fitted on at most SAMPLE labelled documents, as many of each language, chosen by
hash; each bit is one task. Every text is then read whole in one pass.

Defined results: a text that is missing or has no letter is `und` with score 0. With one learned
language it is the answer for all other texts; with none all are `und`. Repeated rows get equal
answers. No documents give no rows. If the learned texts don't tell the languages apart, each has
the same score and every text is ambiguous. Other columns are carried on, whatever their names.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.llm.text import packed, unpacked
from areascope.session import materialise

SAMPLE = 3000
FEATURE_BITS = 12
FEATURES = 1 << FEATURE_BITS
ROUNDS = 60
RATE = 8.0
RIDGE = 1e-4
AMBIGUOUS = 0.1
SEED = 11

PREDICTED = "lang_pred string, score double, ambiguous boolean"


def has_letter(text: str | None) -> bool:
    """Whether there is a letter of any alphabet."""
    return bool(text) and any(map(str.isalpha, text))


def features(text: str) -> np.ndarray:
    """Shares of hashed byte n-grams of 1 to 4 bytes, square roots, of unit length."""
    raw = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), dtype=np.uint8)
    raw = raw.astype(np.uint32)
    counts = np.zeros(FEATURES)
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, 5):
        if len(raw) < n:
            break
        code = (code[: len(raw) - n + 1] << np.uint32(8)) | raw[n - 1 :]
        mixed = (code + np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0xC2B2AE35)
        counts += np.bincount(mixed >> np.uint32(32 - FEATURE_BITS), minlength=FEATURES)
    root = np.sqrt(counts)
    return (root / np.linalg.norm(root)).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """+1/-1 words, one row per language: all splits in two for few languages, else random ones.

    Random words are the best of many draws by their smallest distance.
    """
    if languages < 2:
        return np.ones((languages, 0))
    if languages <= 6:
        splits = [
            [1, *rest] for rest in itertools.product((1, -1), repeat=languages - 1) if -1 in rest
        ]
        return np.array(splits).T
    rng = np.random.default_rng(SEED)
    bits = int(np.ceil(12 * np.log2(languages)))
    best, apart = None, -1
    for _ in range(200):
        words = rng.choice([-1, 1], size=(languages, bits))
        split = np.abs(words.sum(axis=0)) < languages
        near = ((bits - words @ words.T) / 2 + bits * np.eye(languages)).min()
        if split.all() and near > apart:
            best, apart = words, near
    return best


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights and a bias by accelerated gradient steps; y is +1 or -1."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    w = step = np.zeros(x.shape[1] + 1, dtype=np.float32)
    for t in range(ROUNDS):
        margin = y * (x @ step[:-1] + step[-1])
        pull = -(share * y / (1 + np.exp(np.clip(margin, -30, 30)))).astype(np.float32)
        grad = np.append(x.T @ pull, pull.sum())
        new = step - np.float32(RATE) * (grad + np.float32(RIDGE) * step)
        step = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w


def _fit_bit(words: np.ndarray, languages: list[str]):
    place = {x: i for i, x in enumerate(languages)}

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        """One bit: held-out accuracy from two halves, then weights from all rows."""
        bit = int(rows["bit"].iloc[0])
        rows = rows.sort_values("rank")
        x = np.stack([features(t) for t in rows["text"]])
        y = words[rows["lang"].map(place).to_numpy(), bit].astype(np.float32)
        half = np.arange(len(y)) % 2 == 0
        right = 0.0
        for side in (half, ~half):
            w = _logistic(x[side], y[side])
            seen = x[~side] @ w[:-1] + w[-1]
            right += (np.sign(seen) == y[~side]).sum()
        right = np.clip(right / len(y), 0.5, 0.999)
        weight = float(np.log(right / (1 - right)))
        return pd.DataFrame(
            {"bit": [bit], "weight": [weight], "w": [_logistic(x, y).astype(float).tolist()]}
        )

    return fit


class Model:
    def __init__(self, languages: list[str], words: np.ndarray, w: np.ndarray, weight: np.ndarray):
        self.languages, self.words, self.w, self.weight = languages, words, w, weight

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest languages and the shares of all languages, by loss-weighted distance."""
        if len(self.languages) == 1:
            return np.zeros(len(x), dtype=int), np.ones((len(x), 1))
        seen = x @ self.w[:-1] + self.w[-1]
        loss = np.logaddexp(0, -seen[:, None, :] * self.words[None])
        # if no bit did better than chance, all count alike and no language is nearer than another
        chance = not self.weight.sum() > 0
        weight = np.ones_like(self.weight) if chance else self.weight
        distance = (loss * weight).sum(axis=2) / weight.sum() * self.words.shape[1]
        distance = np.zeros_like(distance) if chance else distance
        near = np.exp(distance.min(axis=1, keepdims=True) - distance)
        return distance.argmin(axis=1), near / near.sum(axis=1, keepdims=True)


def fit(
    docs: DataFrame, labelled: Column, sample: int = SAMPLE, seed: int = SEED
) -> Model:
    """A model from at most `sample` of the `labelled` rows."""
    rows = docs.where(labelled & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    order = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 30))
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    words = codewords(len(languages))
    if len(languages) < 2:
        return Model(languages, words, np.zeros((0, 0)), np.zeros(0))
    sample = max(1, sample // len(languages))
    # a threshold of the hash leaves about 1.2 times the sample, the rank cuts it to size
    below = F.lit(0)
    for lang in languages:
        share = min(1.0, 1.2 * sample / sizes[lang] + 20 / sizes[lang])
        below = F.when(F.col("lang") == lang, F.lit(int(share * (1 << 30)))).otherwise(below)
    rows = rows.select("lang", "text", order.alias("order")).where(F.col("order") < below)
    rank = F.row_number().over(W.partitionBy("lang").orderBy("order", "text"))
    chosen = materialise(rows.withColumn("rank", rank).where(F.col("rank") <= sample))
    bits = F.explode(F.array(*[F.lit(i) for i in range(words.shape[1])])).alias("bit")
    fitted = (
        chosen.select("lang", "text", "rank", bits)
        .groupBy("bit")
        .applyInPandas(_fit_bit(words, languages), "bit int, weight double, w array<double>")
        .orderBy("bit")
        .collect()  # bits x FEATURES numbers
    )
    w = np.array([r["w"] for r in fitted], dtype=np.float32).T
    return Model(languages, words, w, np.array([r["weight"] for r in fitted]))


def prediction(spark: SparkSession, model: Model, text: Column, ambiguous: float = AMBIGUOUS):
    """A struct of lang_pred, score (the share of the nearest language) and ambiguous."""
    shared = spark.sparkContext.broadcast(model)  # bits x FEATURES numbers

    @F.pandas_udf(PREDICTED)
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in texts:
            batch = batch.reset_index(drop=True)
            langs = np.full(len(batch), "und", dtype=object)
            scores = np.zeros(len(batch))
            unsure = np.ones(len(batch), dtype=bool)
            known = np.flatnonzero([bool(model.languages) and has_letter(t) for t in batch])
            for part in np.array_split(known, max(1, len(known) // 256)):
                if not len(part):
                    continue
                best, share = model.predict(np.stack([features(batch[i]) for i in part]))
                top = np.sort(share, axis=1)
                langs[part] = np.array(model.languages, dtype=object)[best]
                scores[part] = np.clip(top[:, -1], 0, 1)
                second = top[:, -2] if top.shape[1] > 1 else 0.0
                unsure[part] = top[:, -1] - second < ambiguous
            yield pd.DataFrame({"lang_pred": langs, "score": scores, "ambiguous": unsure})

    return predict.asNondeterministic()(text)  # so that it isn't run twice


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, ambiguous) of every document."""
    held = held_out(F.col("doc_id"))
    model = fit(docs, ~held, sample)
    found = prediction(docs.sparkSession, model, F.col("text")).alias("__found")
    return docs.select("doc_id", held.alias("held_out"), found).select(
        "doc_id", "held_out", "__found.*"
    )


def known_languages(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents in one of the learned languages; a missing lang becomes the predicted one.

    Texts without a letter and texts between two languages are rejected.
    """
    model = fit(docs, ~held_out(F.col("doc_id")), sample)
    found = prediction(docs.sparkSession, model, F.col("text"))
    rows = packed(docs, "lang", "text").withColumn("__found", found).where(
        "__found.lang_pred <> 'und' AND NOT __found.ambiguous"
    )
    return unpacked(rows, docs.columns, lang=F.coalesce("lang", "__found.lang_pred"))
