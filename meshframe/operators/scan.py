"""Prefix scans over an explicit index, without a global window.

A chunk of the index is scanned in its own task; chunk totals are scanned in turn, by more levels
where they are many; offsets are added back by a join on the chunk.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CHUNK = 1_000_000
#: Totals that a single window may scan.
TOP = 100_000


def offsets(totals: DataFrame, chunk: int, top: int = TOP) -> DataFrame:
    """(c, total) to (c, offset): the sum of all totals before each chunk. Level by level, until
    one level has few enough chunks for one window."""
    size = totals.agg(F.min("c"), F.max("c")).first()
    if size[0] is None or size[1] - size[0] < top:
        w = Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
        return totals.select("c", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("offset"))
    w = Window.partitionBy("up").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumn("up", F.floor(F.col("c") / chunk)).withColumn("inner", F.coalesce(F.sum("total").over(w), F.lit(0)))
    above = offsets(totals.groupBy(F.floor(F.col("c") / chunk).alias("c")).agg(F.sum("total").alias("total")), chunk, top)
    return inner.join(above.select(F.col("c").alias("up"), "offset"), "up").select("c", (F.col("inner") + F.col("offset")).alias("offset"))


def add_offsets(df: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """value plus its chunk's offset, by a join on c."""
    return df.join(found, "c").withColumn(value, F.col(value) + F.col("offset")).drop("offset")


def prefix_scan(df: DataFrame, index: str, value: str, inclusive: bool = True, chunk: int = CHUNK, top: int = TOP, name: str = "scan") -> DataFrame:
    """index, value and the running sum of value in the order of index."""
    rows = df.select(index, value).withColumn("c", F.floor(F.col(index) / chunk))
    w = Window.partitionBy("c").orderBy(index)
    frame = w.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    own = rows.withColumn(name, F.coalesce(F.sum(value).over(frame), F.lit(0)))
    totals = rows.groupBy("c").agg(F.sum(value).alias("total"))
    return add_offsets(own, offsets(totals, max(2, chunk), top), name).drop("c")


def segment_offsets(segments: DataFrame, order: list[str], length: str, name: str = "offset") -> DataFrame:
    """Where each segment starts if all are laid out in order; for metadata of bounded size, one
    row for each order and host."""
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return segments.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)))
