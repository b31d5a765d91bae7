"""Line dedup: lines that many documents hold stay in one document only.

Lines become (hash, document, position) rows; text is not shuffled to find duplicates. The rows are
range-partitioned by hash and sorted by document and position, so that each task streams past the
lines of a hash and sees its first occurrence first. A hash is cut into slices of documents that
the range partitioner may place in different tasks: a line that a third of all documents hold is no
task's burden. The answer is a keep bitmap per document, compressed to runs of dropped lines.

Defined results: missing or empty text is one empty line, which is short and stays. Rows with the
same doc_id count as one document, a missing doc_id is one document and the smallest; equal rows
get equal bitmaps. No documents give no rows. Other columns are passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from areascope.llm.text import SPACE, lower_az, packed, partitions, unpacked
from areascope.session import materialise

RUN = "array<struct<first:int,last:int>>"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _text_hash(text: Column) -> Column:
    """Tells apart rows that share a doc_id."""
    return F.xxhash64(text)


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """(__doc, __row, __pos, __h, __g) of every line whose key has at least `min_chars` characters.

    __h and __g are two hashes of the key, 128 bits together.
    """
    key = F.btrim(F.col("__line"), F.lit(SPACE))
    rows = docs.select(
        F.col("doc_id").alias("__doc"),
        _text_hash(F.col("text")).alias("__row"),
        F.posexplode(lines_of(F.col("text"))).alias("__pos", "__line"),
    ).select("__doc", "__row", "__pos", key.alias("__key"))
    rows = rows.where(F.length("__key") >= min_chars)
    rows = rows.withColumn("__key", lower_az(F.col("__key")))
    return rows.select(
        "__doc", "__row", "__pos",
        F.xxhash64("__key").alias("__h"),
        F.xxhash64(F.lit(1), "__key").alias("__g"),
    )


def repeated_lines(rows: DataFrame, min_docs: int) -> DataFrame:
    """(__h, __g, __keeper): keys in at least `min_docs` documents and the largest of these."""
    n = partitions(rows)
    key = ["__h", "__g", "__slice"]
    order = [F.col("__doc").desc_nulls_last(), F.col("__pos")]
    sliced = rows.withColumn("__slice", F.pmod(F.xxhash64("__doc"), F.lit(n)).cast("int"))
    placed = sliced.repartitionByRange(n, *key).sortWithinPartitions(*key, *order)
    stream = W.partitionBy(*key).orderBy(*order)
    before = F.lag("__doc").over(stream)
    first = placed.select(
        *key, "__doc",
        F.row_number().over(stream).alias("__nth"),
        (~F.col("__doc").eqNullSafe(before)).alias("__other"),
    ).where((F.col("__nth") == 1) | F.col("__other"))
    sliced = first.groupBy(*key).agg(
        F.count(F.lit(1)).alias("__docs"), F.max("__doc").alias("__keeper")
    )
    return (
        sliced.groupBy("__h", "__g")
        .agg(F.sum("__docs").alias("__docs"), F.max("__keeper").alias("__keeper"))
        .where(F.col("__docs") >= min_docs)
        .select("__h", "__g", "__keeper")
    )


def _runs(positions: Column) -> Column:
    """Runs of consecutive numbers in a sorted array."""
    p = positions
    first = F.filter(p, lambda x, i: (i == 0) | (F.get(p, i - 1) != x - 1))
    last = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) != x + 1))
    return F.arrays_zip(first.alias("first"), last.alias("last")).cast(RUN)


def keep_bitmaps(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, text_hash, dropped): the runs of lines that each document loses.

    Documents that lose nothing have no row. `text_hash` tells rows with one doc_id apart.
    """
    rows = materialise(line_rows(docs, min_chars))
    repeated = materialise(repeated_lines(rows, min_docs))
    lost = rows.join(repeated, ["__h", "__g"]).where(
        ~F.col("__doc").eqNullSafe(F.col("__keeper"))
    )
    return (
        lost.groupBy("__doc", "__row")
        .agg(F.array_sort(F.collect_set("__pos")).alias("__lost"))
        .select(
            F.col("__doc").alias("doc_id"),
            F.col("__row").alias("text_hash"),
            _runs(F.col("__lost")).alias("dropped"),
        )
    )


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with __lines, __dropped (numbers of lines) and __kept (the text that stays)."""
    marks = bitmaps.select(
        F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__row"),
        F.col("dropped").alias("__runs"),
    )
    hashed = docs.withColumn("__hash", _text_hash(F.col("text")))
    joined = hashed.join(
        marks,
        (hashed["__hash"] == marks["__row"]) & hashed["doc_id"].eqNullSafe(marks["__doc"]),
        "left",
    ).drop("__hash", "__row", "__doc")
    lines = lines_of(F.col("text"))
    runs = F.col("__runs")
    begin = F.concat(F.array(F.lit(-1)), F.transform(runs, lambda r: r["last"]))
    end = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    parts = F.zip_with(begin, end, lambda a, b: F.slice(lines, a + 2, b - a - 1))
    lost = F.aggregate(runs, F.lit(0), lambda n, r: n + r["last"] - r["first"] + 1)
    return joined.select(
        "*",
        F.size(lines).cast("long").alias("__lines"),
        F.coalesce(lost, F.lit(0)).cast("long").alias("__dropped"),
        F.when(runs.isNull(), F.col("text"))
        .otherwise(F.array_join(F.flatten(parts), "\n"))
        .alias("__kept"),
    ).drop("__runs")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents without the lines that another document keeps; n_chars follows the text."""
    bitmaps = keep_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs)
    out = apply_bitmaps(packed(docs, "doc_id", "text"), bitmaps)
    changed = {"text": F.col("__kept")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length("__kept").cast(docs.schema["n_chars"].dataType)
    return unpacked(out, docs.columns, **changed)
