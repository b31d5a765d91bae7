"""Session helpers: the shared checkpoint folder and size limits used across operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# A side is broadcast only after it was counted and found to have at most this many rows.
BROADCAST_ROWS = 100_000

# Largest number of rows one sorted bucket (one task's window partition) is planned to hold.
ROWS_PER_BUCKET = 1_000_000


def local_session(app: str = "areascope", cores: str = "*", **conf: str) -> SparkSession:
    """Session for tests and benchmarks on one machine; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoints: the one the session names, or a fresh one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="areascope-checkpoint-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def by_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Place rows by key in the session's full number of partitions.

    Work done in Python per group is heavy for its bytes; without a stated number the
    partitions would be merged by size and the groups would queue in a few tasks.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def materialise(df: DataFrame) -> DataFrame:
    """Write a frame that several jobs read to the shared checkpoint folder and read it back.

    The copy is columnar and survives lost executors; later jobs prune its columns. Copies of
    one application share a folder named after it, to be dropped when it has ended.
    """
    spark = df.sparkSession
    app = spark.sparkContext.applicationId
    path = f"{checkpoint_dir(spark)}/areascope/{app}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
