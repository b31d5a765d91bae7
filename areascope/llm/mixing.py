"""Mixing sources to target weights by hash thresholds.

Each document has a fixed hash. A source that must give part of its words takes the documents
below a threshold of the hash. The threshold comes from a histogram: words are summed by source and
hash bucket, the bucket in which the budget ends is cut into finer buckets, and so on until it holds
one hash. Only documents of boundary buckets are looked at again, nothing is sorted, and a larger
target of the same source always takes a superset.

Defined results: missing text has size 0. A missing source is a source of its own and the last.
Documents equal in doc_id and text share a hash and are taken together. The document in which the
budget ends is taken if at least half of it fits. No words at all give targets of 0.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.llm.text import WHOLE, packed, partitions, unpacked, word_count
from areascope.session import materialise

HASH_BITS = 60
LEVEL_BITS = 12
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, u): words and a reproducible hash of 60 bits of each document."""
    text = F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    )
    digits = F.substring(F.md5(text), 1, HASH_BITS // 4)
    return docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"),
        F.conv(digits, 16, 10).cast("long").alias("u"),
    )


def source_weights(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """(source, total, w): words per source; weights are dealt out in the order of sources."""
    n = partitions(docs)
    order = [F.col("source").isNull(), F.col("source")]
    totals = docs.groupBy("source").agg(F.sum("size").alias("total"))
    parts = materialise(
        totals.repartitionByRange(n, *order).withColumn("p", F.spark_partition_id())
    )
    sizes = parts.groupBy("p").agg(F.count(F.lit(1)).alias("n"))  # one row per partition
    earlier = W.orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("p", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("p").orderBy(*order)) - 1
    ranked = parts.withColumn("nth", rank).join(offsets, "p")
    at = F.pmod(F.col("nth") + F.col("before"), F.lit(len(weights))).cast("int")
    values = F.array(*[F.lit(w) for w in weights])
    return materialise(ranked.select("source", "total", F.get(values, at).alias("w")))


def targets(by_source: DataFrame, max_repeats: int) -> DataFrame:
    """Adds `target`: shares of all words by weight, at most `max_repeats` times the source.

    What a full source can't take is shared again by weight; each round is one aggregate, and
    sources only ever become full, so it ends when a round fills no further one.
    """
    most = F.col("total") * F.lit(max_repeats)
    first = by_source.agg(F.sum("total").alias("words"), F.sum("w").alias("w")).first()
    words, level, full = first["words"] or 0, 0.0, -1
    if words:
        level = words / first["w"]
    while words:
        is_full = most < F.lit(level) * F.col("w")
        row = by_source.agg(
            F.count_if(is_full).alias("full"),
            F.sum(F.when(is_full, most)).alias("given"),
            F.sum(F.when(~is_full, F.col("w"))).alias("w"),
        ).first()
        if row["full"] == full or not row["w"]:
            break
        full, level = row["full"], (words - (row["given"] or 0)) / row["w"]
    share = F.lit(float(level)) * F.col("w")
    return by_source.withColumn("target", F.least(most.cast("double"), share))


def thresholds(docs: DataFrame, by_source: DataFrame) -> DataFrame:
    """(source, total, target, times, below): times every document, once more if its u < below."""
    times = F.when(F.col("total") > 0, F.floor(F.col("target") / F.col("total"))).otherwise(0)
    plan = materialise(
        by_source.withColumn("times", times.cast("long")).withColumn(
            "budget", F.col("target") - F.col("times") * F.col("total")
        )
    )
    # `bucket` is the prefix of the hash that holds the end of the budget, `base` the words below
    state = plan.where("budget > 0").select(
        "source", "budget", F.lit(0).cast("long").alias("bucket"),
        F.lit(0).cast("long").alias("base"),
    )
    done = []
    shift = HASH_BITS
    while shift > 0:
        inside = F.col("s.source").eqNullSafe(F.col("d.source")) & (
            F.shiftright("d.u", shift) == F.col("s.bucket")
        )
        shift -= LEVEL_BITS
        sums = (
            docs.alias("d").join(state.alias("s"), inside)
            .groupBy("s.source", "budget", "base", F.shiftright("d.u", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.min("u").alias("u"), F.max("u").alias("u2"))
        )
        below = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
        before = F.col("base") + F.coalesce(F.sum("words").over(below), F.lit(0))
        edge = materialise(
            sums.withColumn("base", before).where(
                (F.col("base") <= F.col("budget"))
                & (F.col("base") + F.col("words") > F.col("budget"))
            )
        )
        one = edge.where("u = u2")
        fits = F.col("base") + F.col("words") / 2 <= F.col("budget")
        done.append(one.select("source", (F.col("u") + F.when(fits, 1).otherwise(0)).alias("edge")))
        state = edge.where("u < u2").select("source", "budget", "bucket", "base")
        if state.isEmpty():
            break
    edges = done[0]
    for more in done[1:]:
        edges = edges.unionByName(more)
    edges = edges.select(F.col("source").alias("__source"), "edge")
    # a budget that ends in no bucket is the whole source
    below = F.when(F.col("budget") > 0, F.coalesce("edge", F.lit(1 << HASH_BITS))).otherwise(0)
    return plan.join(edges, plan["source"].eqNullSafe(edges["__source"]), "left").select(
        "source", "total", "target", "times", below.alias("below")
    )


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """(doc_id, source, size, u, source_size, target, times): how often each document is taken."""
    rows = materialise(sized(docs))
    plan = materialise(
        thresholds(rows, targets(source_weights(rows, weights), max_repeats))
    ).withColumnRenamed("source", "__source")
    joined = rows.join(plan, rows["source"].eqNullSafe(plan["__source"]), "left")
    extra = F.when(F.col("u") < F.col("below"), 1).otherwise(0)
    return joined.select(
        "doc_id", "source", "size", "u", F.col("total").alias("source_size"), "target",
        (F.col("times") + extra).cast("long").alias("times"),
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """The documents, each as often as the mix takes it.

    The plan per source meets the documents directly: only sizes and hashes are written first.
    """
    rows = materialise(sized(docs))
    plan = materialise(
        thresholds(rows, targets(source_weights(rows, weights), max_repeats))
    ).select(F.col("source").alias("__source"), "times", "below")
    text = F.concat_ws(
        "|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))
    )
    u = F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")
    plan = plan.select("__source", F.col("times").alias("__times"), F.col("below").alias("__below"))
    taken = packed(docs, "doc_id", "text", "source").withColumn("__u", u).join(
        plan, F.col("source").eqNullSafe(F.col("__source")), "left"
    )
    n = F.col("__times") + F.when(F.col("__u") < F.col("__below"), 1).otherwise(0)
    copies = F.explode(F.array_repeat(F.lit(0), n.cast("int")))
    return unpacked(taken.select(WHOLE, copies.alias("__copy")), docs.columns)
