"""Restartable chip processing.

Two forms: a ledger of finished chips (anti-join, for tables), and a file stream that runs once
over whatever chip files have arrived since the last run and then stops. In both a run that
died is simply run again.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from areascope.session import checkpoint_dir
from areascope.sources.tables import exists, pending, remove

CHIP = ["row_off", "col_off"]
CHIP_SCHEMA = "row_off int, col_off int, data array<float>"


def encode_pending(
    spark: SparkSession, chips: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str,
    keys: list[str] | None = None,
) -> DataFrame:
    """Encode the chips the output does not have yet, add them, return the whole output.

    `keys` name the raster (tile, area, year) a chip belongs to, when there are several.
    """
    todo = chips
    if exists(spark, path):
        todo = pending(chips, spark.read.parquet(path), [*(keys or []), *CHIP])
    encode(todo).write.mode("append").parquet(path)
    return spark.read.parquet(path)


def finish(spark: SparkSession, path: str, out: str, rows_per_file: int = 10_000) -> DataFrame:
    """Write the many small files of a complete ledger as few, then delete the ledger.

    The ledger goes only after the output is whole, and a whole output is not written again, so a run
    that died in between is simply run again.
    """
    if not exists(spark, out):
        done = spark.read.parquet(path)
        files = max(1, math.ceil(done.count() / rows_per_file))
        done.repartition(files).write.mode("overwrite").parquet(out)
    remove(spark, path)
    return spark.read.parquet(out)


def encode_arrivals(
    spark: SparkSession, folder: str, encode: Callable[[DataFrame], DataFrame], path: str,
    name: str, schema: str = CHIP_SCHEMA,
) -> DataFrame:
    """Encode chip files not seen by earlier runs of the job `name` with this input and output,
    each exactly once."""
    job = hashlib.md5(f"{folder}\n{path}".encode()).hexdigest()
    arrived = spark.readStream.schema(schema).parquet(folder)
    query = (
        encode(arrived)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{checkpoint_dir(spark)}/{name}-{job}")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.parquet(path)
