"""Whole files as rows: what a mapped file is to a task."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable
from ..session import ship


def map_files(spark: SparkSession, paths: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, length, content) of one file or many; content is read only where a plan asks for it."""
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(paths).select("path", "length", "content")


def write_files(rows: DataFrame, folder: str) -> None:
    """A file for each row (name, content) in a folder that all executors share; each appears whole."""
    ship(rows.sparkSession)

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["name"], pdf["content"]):
                put(f"{folder}/{name}", bytes(content))
            yield pdf[["name"]]

    rows.select("name", "content").mapInPandas(run, "name string").count()


def put(uri: str, raw: bytes) -> None:
    """Write one file under another name and rename it, so that a task that is tried again does no
    harm."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    folder, name = path.rsplit("/", 1)
    system.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(temporary) as out:
        out.write(raw)
    system.move(temporary, path)


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(log, number, line) of text logs, numbered from 0 in each file; lines end at line feeds, and
    an empty file has none. A long log is read in parts by many tasks; the lines are written once
    with their part and their place, so that no later task can see them parted otherwise."""
    read = spark.read.text(paths, lineSep="\n")
    parted = durable(read.select(
        F.col("_metadata.file_path").alias("log"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line")))
    before = Window.partitionBy("log").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each part; the lines of one follow each other.
    parts = parted.groupBy("log", "part").agg(F.min("at").alias("first"), F.count("*").alias("n")).select(
        "log", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return parted.join(parts, ["log", "part"]).select("log", (F.col("at") + F.col("shift")).alias("number"), "line")
