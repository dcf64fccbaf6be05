"""Address spaces as tables: linear ones as (i, v), two-dimensional ones as (r, c, v)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arithmetic import mixed


def linear(spark: SparkSession, length: int, v=None) -> DataFrame:
    """(i, v) of a new linear space; v: an expression over i, 0 by default."""
    return spark.range(length).select(F.col("id").alias("i")).withColumn("v", F.lit(0) if v is None else v)


def plane(spark: SparkSession, rows: int, columns: int, v=None) -> DataFrame:
    """(r, c, v) of a new space in two dimensions; v: an expression over r and c."""
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).alias("r"), (F.col("id") % columns).alias("c"))
    return cells.withColumn("v", F.lit(0) if v is None else v)


def random_ints(spark: SparkSession, length: int, seed: int = 0) -> DataFrame:
    """(i, v) with values from 0 to 2**31 - 1 that the seed alone decides."""
    return linear(spark, length, F.shiftright(mixed(seed, F.col("i")), 1))


def random_plane(spark: SparkSession, rows: int, columns: int, seed: int = 0) -> DataFrame:
    return plane(spark, rows, columns, F.shiftright(mixed(seed, F.col("r"), F.col("c")), 1))


def dominant_plane(spark: SparkSession, n: int, seed: int = 0) -> DataFrame:
    """A positive square matrix whose diagonal exceeds its rows' sums, fit for LU without pivots."""
    off = (1 + mixed(seed, F.col("r"), F.col("c")) % 99).cast("double")
    return plane(spark, n, n, F.when(F.col("r") == F.col("c"), off + 100.0 * n).otherwise(off))


def fetch(df: DataFrame, limit: int):
    """All rows on the driver; refused where there are more than limit."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return rows


def fetch_range(df: DataFrame, index: str, offset: int, length: int):
    """The rows of one range of the index on the driver, at most length of them."""
    return df.where((F.col(index) >= offset) & (F.col(index) < offset + length)).orderBy(index).collect()


def release(df: DataFrame) -> None:
    df.unpersist()


def place(df: DataFrame, *keys: str, ranges: bool = False, partitions: int | None = None) -> DataFrame:
    """Lay rows out by keys, hashed (blocks at random) or in ranges (linear, by rows, by columns)."""
    deal = df.repartitionByRange if ranges else df.repartition
    return deal(partitions, *keys) if partitions else deal(*keys)


def embedding_cells(embeddings: DataFrame, scale: int = 100) -> DataFrame:
    """(r, c, v): vectors as the rows of an integer matrix."""
    cells = embeddings.select(F.col("vec_id").alias("r"), F.posexplode("embedding").alias("c", "x"))
    return cells.select("r", F.col("c").cast("long").alias("c"), F.round(F.col("x").cast("double") * scale).cast("long").alias("v"))
