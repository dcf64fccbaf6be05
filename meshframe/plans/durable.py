"""Cutting lineage: tables that loops read again, in a folder all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own where it is unset and the session is local."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = os.path.join(tempfile.gettempdir(), f"meshframe-{os.getuid()}")
        os.makedirs(at, exist_ok=True)
    at = at.rstrip("/")
    return at if ":" in at.split("/")[0] else f"file://{at}"


def fresh(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{scratch_dir(spark)}/durable-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a table that no plan reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def durable(df: DataFrame, path: str | None = None) -> DataFrame:
    """The rows written and read again: rows and their partitions stay what they are, and a lost
    executor costs nothing that stands above."""
    spark = df.sparkSession
    path = path or fresh(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def iterate(step, state: DataFrame, rounds: int, every: int = 1) -> DataFrame:
    """state after so many steps. Each step's output is the next one's input, as two address
    spaces that swap roles; lineage is cut every few rounds."""
    for k in range(rounds):
        state = step(state, k)
        if every and (k + 1) % every == 0 and k + 1 < rounds:
            state = durable(state)
    return state
