"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

The model is of bytes: n-grams of ORDER bytes, per language. Tasks count the n-grams of trusted
documents, Spark adds the counts up, and all lower orders follow by joins and groupings of these
counts: continuation counts, the three discounts of each order and language, probabilities and
backoff weights. Every trusted document is counted.

Scoring joins the counts shard by shard: a shard holds the n-grams whose two bytes before the last
one have its hash, at most `shard_rows` of them, and goes to every task as a hash table; the lowest
two orders (at most 65,792 rows of a language) are in all shards. A position of a text belongs to one
shard, so the sums of a document's shards add up. More text makes more shards, not larger ones.

A document is kept if its perplexity is at most a quantile of those of trusted documents of its
language.

Defined results: missing or empty text has no perplexity and is not kept. Documents of a language
without trusted text have none either and are not kept. A missing lang is a language of its own.
Repeated rows get equal results. Without trusted documents nothing is kept.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areascope.llm.sketch import id_filter, prefilter
from areascope.session import materialise

ORDER = 5
SHARD_ROWS = 2_000_000
QUANTILE = 0.995
MAX_LANGUAGES = 10_000  # rows of thresholds that are broadcast
COUNTS = "lang string, gram long, n long"


def _bytes(text: str) -> np.ndarray:
    """The text between line breaks as numbers of one byte each."""
    return np.frombuffer(f"\n{text}\n".encode("utf-8", "replace"), dtype=np.uint8).astype(np.int64)


def _grams(raw: np.ndarray, n: int) -> np.ndarray:
    """Codes of all runs of n bytes; code 0 to 256**n - 1."""
    size = max(0, len(raw) - n + 1)
    code = np.zeros(size, dtype=np.int64)
    for k in range(n):
        code = (code << 8) | raw[k : k + size]
    return code


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of highest-order n-grams per language, added up within the task as they come."""
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def merged(parts):
        codes = np.concatenate([c for c, _ in parts])
        counts = np.concatenate([n for _, n in parts])
        order = np.argsort(codes, kind="stable")
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
        return codes[first], np.add.reduceat(counts, first)

    for batch in batches:
        for lang, rows in batch.groupby("lang")["text"]:
            codes = np.concatenate([_grams(_bytes(t), ORDER) for t in rows])
            if not len(codes):
                continue
            parts = held.setdefault(lang, [])
            parts.append(np.unique(codes, return_counts=True))
            if len(parts) > 8:
                held[lang] = [merged(parts)]
    for lang, parts in held.items():
        codes, counts = merged(parts)
        yield pd.DataFrame({"lang": lang, "gram": codes, "n": counts})


def _tagged(docs: DataFrame) -> DataFrame:
    """Missing languages as a name that no language has."""
    lang = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    return docs.select("doc_id", lang.alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _discounted(counts: DataFrame) -> DataFrame:
    """(lang, gram, context, own, back): own part of a probability, backoff weight of its context.

    Discounts of counts of one, two and three or more come from the counts of counts of the order
    and language, as in the modified method.
    """
    context = counts.withColumn("context", F.shiftright("gram", 8))
    many = [F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in (1, 2, 3, 4)]
    kinds = counts.groupBy("lang").agg(*many)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(k: int):
        ratio = k - (k + 1) * y * F.col(f"n{k + 1}") / F.col(f"n{k}")
        usable = (F.col("n1") > 0) & (F.col(f"n{k}") > 0)
        # too few counts to tell: half a count
        good = F.when(usable, ratio)
        return F.when((good > 0) & (good < k), good).otherwise(0.5).alias(f"d{k}")

    discounts = kinds.select("lang", *[discount(k) for k in (1, 2, 3)])
    of_context = context.groupBy("lang", "context").agg(
        F.sum("n").alias("total"),
        F.count_if(F.col("n") == 1).alias("c1"), F.count_if(F.col("n") == 2).alias("c2"),
        F.count_if(F.col("n") >= 3).alias("c3"),
    )
    of_context = of_context.join(discounts, "lang")
    left = F.col("d1") * F.col("c1") + F.col("d2") * F.col("c2") + F.col("d3") * F.col("c3")
    of_context = of_context.withColumn("back", left / F.col("total"))
    taken = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2"))
    own = F.greatest(F.col("n") - taken.otherwise(F.col("d3")), F.lit(0.0)) / F.col("total")
    joined = context.join(of_context, ["lang", "context"])
    return joined.select("lang", "gram", "context", "back", own.alias("own"))


def model(trusted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, order, gram, p) and (lang, order, gram, back).

    `p` is the interpolated probability of the last byte of an n-gram given the others, `back` the
    backoff weight of an n-gram as a context. Order 0 is the uniform distribution and its weight.
    """
    full = trusted.mapInPandas(_count, COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = {ORDER: materialise(full)}
    for order in range(ORDER - 1, 0, -1):
        # continuation counts: how many bytes an n-gram has on its left
        shorter = F.col("gram").bitwiseAND(F.lit((1 << 8 * order) - 1))
        counts[order] = materialise(
            counts[order + 1].groupBy("lang", shorter.alias("gram"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
    chances, backs, lower = [], [], None
    for order in range(1, ORDER + 1):
        part = _discounted(counts[order])
        if lower is None:
            part = part.withColumn("p", F.col("own") + F.col("back") / 256)
        else:
            suffix = F.col("gram").bitwiseAND(F.lit((1 << 8 * (order - 1)) - 1))
            below = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            part = part.withColumn("suffix", suffix).join(below, ["lang", "suffix"])
            part = part.withColumn("p", F.col("own") + F.col("back") * F.col("q"))
        lower = materialise(part.select("lang", "gram", "context", "p", "back"))
        chances.append(lower.select("lang", F.lit(order).alias("order"), "gram", "p"))
        contexts = lower.groupBy("lang", F.col("context").alias("gram"))
        contexts = contexts.agg(F.first("back").alias("back"))
        backs.append(contexts.select("lang", F.lit(order - 1).alias("order"), "gram", "back"))
    for more in chances[1:]:
        chances[0] = chances[0].unionByName(more)
    for more in backs[1:]:
        backs[0] = backs[0].unionByName(more)
    return materialise(chances[0]), materialise(backs[0])


class Table:
    """An open hash table from codes to values, in arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values
        self.bits = max(4, int(math.ceil(math.log2(2 * len(keys) + 2))))
        self.rows = np.full(1 << self.bits, -1, dtype=np.int32)
        left, slot = np.arange(len(keys), dtype=np.int32), self._slot(keys)
        while len(left):
            free = self.rows[slot] < 0
            self.rows[slot[free]] = left[free]  # the last of equals wins, the others go on
            lost = self.rows[slot] != left
            left, slot = left[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        mixed = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Values of the codes, NaN where there is none."""
        out = np.full(len(codes), np.nan)
        if not len(self.keys):
            return out
        at, slot = np.arange(len(codes)), self._slot(codes)
        while len(at):
            row = self.rows[slot]
            hit = (row >= 0) & (self.keys[row] == codes[at])
            out[at[hit]] = self.values[row[hit]]
            on = (row >= 0) & ~hit
            at, slot = at[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out


class Scorer:
    """One shard of the model: sums of log probabilities of the positions that belong to it."""

    def __init__(self, chances: dict, backs: dict, shard: int, shards: int):
        self.chances = {k: Table(g, np.log(v)) for k, (g, v) in chances.items()}
        self.backs = {
            k: Table(g, np.log(np.maximum(v, 1e-300))) for k, (g, v) in backs.items()
        }
        self.shard, self.shards = shard, shards

    def score(self, lang: str, raw: np.ndarray) -> tuple[float, int]:
        """Sum over the positions of this shard, and their number."""
        if (lang, 1) not in self.chances:
            return 0.0, 0
        last = np.arange(1, len(raw))  # byte 0 is the break in front of the text
        if self.shards > 1:
            last = last[shard_of(pair_before(raw, last), self.shards) == self.shard]
        total, count, added = 0.0, len(last), np.zeros(len(last))
        for order in range(ORDER, 0, -1):
            if not len(last):
                break
            code = np.zeros(len(last), dtype=np.int64)
            for k in range(order - 1, -1, -1):
                code = (code << 8) | raw[np.maximum(last - k, 0)]
            early = last < order - 1  # too near the beginning for this order
            code[early] = -1
            p = self.chances[lang, order].find(code) if (lang, order) in self.chances else code * np.nan
            found = ~np.isnan(p)
            total += (p[found] + added[found]).sum()
            last, added, code, early = last[~found], added[~found], code[~found], early[~found]
            if (lang, order - 1) in self.backs:
                # an unseen context has no weight
                back = self.backs[lang, order - 1].find(np.where(early, -1, code >> 8))
                added = added + np.nan_to_num(back)
        total += (np.log(1 / 256) + added).sum() if len(last) else 0.0
        return float(total), count


def pair_before(raw: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The two bytes before a position; the first byte stands in for what is before it."""
    return (raw[np.maximum(last - 2, 0)] << 8) | raw[last - 1]


def shard_of(pair, shards: int):
    return ((pair * 40503) % 65536) % shards


def _by_order(rows: DataFrame, value: str) -> dict:
    """Arrays per (lang, order) of one shard's rows."""
    found = rows.select("lang", "order", "gram", value).toArrow().to_pandas()
    return {
        (lang, int(order)): (part["gram"].to_numpy(), part[value].to_numpy())
        for (lang, order), part in found.groupby(["lang", "order"])
    }


_SCORERS: dict[int, Scorer] = {}


def _scorer(shared) -> Scorer:
    """A worker builds the hash tables of a shard once."""
    if shared.value["key"] not in _SCORERS:
        _SCORERS.clear()
        parts = {k: v for k, v in shared.value.items() if k != "key"}
        _SCORERS[shared.value["key"]] = Scorer(**parts)
    return _SCORERS[shared.value["key"]]


def scores(
    docs: DataFrame, levels: tuple[DataFrame, DataFrame], shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, lang, log_p, n) of documents from _tagged: sums over the shards."""
    chances, backs = levels
    gram = F.col("gram")
    # an n-gram's shard follows from the two bytes before its last, a context's from its last two
    pair = {"p": F.shiftright(gram, 8).bitwiseAND(F.lit(65535)), "back": gram.bitwiseAND(65535)}
    large = chances.where("order >= 3").count() + backs.where("order >= 3").count()
    shards = max(1, -(-large // shard_rows))
    out = "doc_id long, lang string, text_hash long, log_p double, n long"
    hashed = docs.select("doc_id", "lang", F.xxhash64("text").alias("text_hash"), "text")
    results = []
    for shard in range(shards):
        parts = {
            name: _by_order(
                rows.where((F.col("order") < 3) | (shard_of(pair[value], shards) == shard)), value
            )
            for name, rows, value in (("chances", chances, "p"), ("backs", backs, "back"))
        }  # about shard_rows rows
        key = uuid.uuid4().hex
        shared = docs.sparkSession.sparkContext.broadcast(
            parts | {"shard": shard, "shards": shards, "key": key}
        )

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            scorer = _scorer(shared)
            for batch in batches:
                found = [
                    scorer.score(lang, _bytes(text)) if text else (0.0, 0)
                    for lang, text in zip(batch["lang"], batch["text"])
                ]
                yield batch.drop(columns="text").assign(
                    log_p=[x[0] for x in found], n=[x[1] for x in found]
                )

        part = hashed.mapInPandas(run, out)
        results.append(part if shards == 1 else materialise(part))
    if shards == 1:
        return results[0].drop("text_hash")
    for more in results[1:]:
        results[0] = results[0].unionByName(more)
    # equal rows were added up together: each gets its share back
    sums = results[0].groupBy("doc_id", "lang", "text_hash").agg(
        F.sum("log_p").alias("log_p"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")
    )
    copies = (F.col("rows") / shards).cast("int")
    return sums.select(
        "doc_id", "lang", (F.col("log_p") / copies).alias("log_p"),
        (F.col("n") / copies).cast("long").alias("n"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    ).drop("copy")


def judge(
    docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """(doc_id, lang, n_bytes, log_p, perplexity, threshold, kept) of every document.

    Trusted are documents labelled of good quality and not toxic.
    """
    tagged = _tagged(docs)
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    ids = materialise(
        labels.where(good & F.col("doc_id").isNotNull())
        .select(F.col("doc_id").alias("id")).distinct()
    )
    maybe = prefilter(tagged, "doc_id", id_filter(ids, ids.count()))
    trusted = maybe.join(ids, maybe["doc_id"] == ids["id"], "left_semi")
    levels = model(trusted.select("lang", "text"))
    found = materialise(
        scores(tagged, levels, shard_rows).withColumn(
            "perplexity", F.when(F.col("n") > 0, F.exp(-F.col("log_p") / F.col("n")))
        )
    )
    seen = found.join(ids, found["doc_id"] == ids["id"], "left_semi")
    limits = seen.groupBy("lang").agg(
        F.percentile_approx("perplexity", quantile, 10_000).alias("threshold")
    )
    limits = materialise(limits)
    if limits.count() <= MAX_LANGUAGES:
        limits = F.broadcast(limits)
    out = found.join(limits, "lang", "left")
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    lang = F.when(F.col("lang") != "", F.substr("lang", F.lit(2)))
    return out.select(
        "doc_id", lang.alias("lang"), F.col("n").alias("n_bytes"), "log_p", "perplexity",
        "threshold", kept.alias("kept"),
    )
