"""Session factory used by tests, the bench and local runs; a cluster passes its own session."""

from __future__ import annotations

import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gazette")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. Where it is unset and the
    session runs on this machine alone (tests), one is made for it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='gazette-')}")
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parts(df: DataFrame, each: int) -> int:
    """How many tasks have about so many rows of df each (200 at most: with more, what is dealt is gathered in memory
    first). df is counted, so it should be a stored table."""
    return min(200, max(1, math.ceil(df.count() / each)))


def spread(df: DataFrame, each: int, *keys: str) -> DataFrame:
    """df dealt by keys to tasks of about so many rows each, before a step that makes or holds much for a row: few tasks read
    a file of few bytes, whatever its rows come to."""
    return df.repartition(parts(df, each), *keys)


def held(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: worked out once, and not anew where an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
