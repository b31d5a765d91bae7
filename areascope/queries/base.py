"""Registry of queries: a Spark builder and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Build], Build]:
    """Register a builder under its function name."""

    def add(build: Build) -> Build:
        QUERIES[build.__name__] = Query(build.__name__, build, sql)
        return build

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles, so sums taken in another order compare equal."""
    names = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float")]
    return df.withColumns({n: r(F.col(n), digits) for n in names})


def r(c: Column, digits: int = 6) -> Column:
    return F.round(c.cast("double"), digits)
