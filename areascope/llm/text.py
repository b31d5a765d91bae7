"""Expressions on text shared by the operators."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space the contracts name: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def lower_az(c: Column) -> Column:
    """A-Z in lower case, every other character as it is.

    `lower` is fast but also changes other alphabets, so it serves pure ASCII only.
    """
    ascii_only = F.octet_length(c) == F.length(c)
    return F.when(ascii_only, F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


WHOLE = "__whole"


def packed(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns, and the whole row in a struct: no other name can clash with an operator's."""
    return df.select(*needed, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(WHOLE))


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The whole rows again, in the order of `columns`, with some columns changed."""
    return df.select(*[changed.get(c, F.col(WHOLE).getField(c)).alias(c) for c in columns])


def word_count(c: Column) -> Column:
    """Number of words; missing text has none."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
