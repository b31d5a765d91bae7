"""Scans with explicit schemas, sinks, cached results and pending work."""

from __future__ import annotations

import csv
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areascope.operators.joins import keys_minus

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(
    spark: SparkSession, path: str, schema: str, null_value: str | None = None
) -> DataFrame:
    """CSV with a header. Columns are matched by name, since files hold more than is asked
    for; only the asked columns are parsed. NaN in a number column becomes null."""
    wanted = T.StructType.fromDDL(schema)
    head = spark.read.text(path).where(F.length("value") > 0).first()
    header = next(csv.reader([head[0].lstrip("\ufeff")])) if head else wanted.names
    types = {f.name: f.dataType for f in wanted}
    full = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header])
    reader = spark.read.schema(full).option("header", True).option("enforceSchema", False)
    if null_value is not None:
        reader = reader.option("nullValue", null_value)
    have = [F.col(f"`{n}`") for n in wanted.names if n in header]
    return clean_nan(reader.csv(path).select(*have))


def read_parquet(spark: SparkSession, glob: str) -> DataFrame:
    """All segments a glob names, NaN to null."""
    return clean_nan(spark.read.parquet(glob))


def clean_nan(df: DataFrame) -> DataFrame:
    """NaN and null both mean missing; Spark aggregates only skip null."""
    numbers = (T.DoubleType, T.FloatType)
    return df.selectExpr(
        *[
            f"nullif(`{f.name}`, {f.dataType.simpleString()}('NaN')) AS `{f.name}`"
            if isinstance(f.dataType, numbers)
            else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_tiles(df: DataFrame, path: str, by: list[str]) -> None:
    """Raster or map as parquet, one folder per band or tile; names are column values.

    Rows of one folder are written by several tasks when there are many (`by` alone would
    send a whole band through one).
    """
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def write_panel(df: DataFrame, path: str, year: str) -> None:
    """Panel partitioned by year, so a query on one year reads one folder."""
    df.write.mode("overwrite").partitionBy(year).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """True when a finished output is there: a job marks its folder last, so files that a died
    job left behind don't count."""
    mark = spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark)


def remove(spark: SparkSession, path: str) -> bool:
    """Delete an output folder; false when there was none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cached(
    spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False
) -> DataFrame:
    """Read a result if it was finished before, else build and write it, then read it."""
    if refresh or not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def pending(units: DataFrame, done: DataFrame, key: str | list[str]) -> DataFrame:
    """Units whose output is not there yet."""
    keys = [key] if isinstance(key, str) else list(key)
    return units.join(keys_minus(units, done, keys), keys, "left_semi")
