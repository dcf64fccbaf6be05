"""Maps, selections and filters over (index, value) rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship


def map_elements(df: DataFrame, **columns: Column) -> DataFrame:
    """A subtask's function as expressions, which stay in generated code."""
    return df.withColumns(columns)


def map_opaque(df: DataFrame, function: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A subtask's function as opaque code over batches of a partition's rows."""
    ship(df.sparkSession)
    return df.mapInPandas(function, schema)


def identity_violations(df: DataFrame, index: str, value: str) -> DataFrame:
    """How many elements differ from their index."""
    return df.agg(F.count_if(~F.col(value).eqNullSafe(F.col(index))).alias("violations"))


def local_index(row: Column, block: int) -> Column:
    """Place of a row inside its block."""
    return F.pmod(row, F.lit(block))


def select_range(df: DataFrame, index: str, offset: int, length: int) -> DataFrame:
    """A linear subscription: the rows of one range of the index, which reaches the scan."""
    return df.where((F.col(index) >= offset) & (F.col(index) < offset + length))


def select_blocks(df: DataFrame, row: str, column: str, block_row: int, block_column: int, size: int) -> DataFrame:
    """A scattered subscription: one square block of a matrix."""
    inside = lambda c, b: (F.col(c) >= b * size) & (F.col(c) < (b + 1) * size)
    return df.where(inside(row, block_row) & inside(column, block_column))


def compress(df: DataFrame, value: str, sentinel=0) -> DataFrame:
    """Rows other than the sentinel, which keep their index."""
    return df.where(F.col(value) != sentinel)


def worth_compressing(df: DataFrame, value: str, sentinel=0, threshold: float = 0.4) -> DataFrame:
    """Whether fewer than the threshold's share of elements differ from the sentinel."""
    share = F.count_if(F.col(value) != sentinel) / F.count("*")
    return df.agg((share < threshold).alias("compress"))


def zero_fill(dense: DataFrame, sparse: DataFrame, keys: list[str], value: str) -> DataFrame:
    """All keys of dense, with 0 where sparse has none."""
    return dense.join(sparse, keys, "left").withColumn(value, F.coalesce(F.col(value), F.lit(0)))


def is_singular(df: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Whether any diagonal element is 0."""
    return df.where(F.col(row) == F.col(column)).agg(F.coalesce(F.bool_or(F.col(value) == 0), F.lit(False)).alias("singular"))
