"""Reductions: subtask outputs at equal positions combine by an operation.

Every built-in is a partial and a final aggregate, so that only one row for each key and task is
shuffled; a key that holds a third of all rows costs no more than another.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arithmetic import INTEGRAL, TYPES, truth, wrap, wrap64


def _wrapped(x: Column, kind: str) -> Column:
    return {"int": lambda: wrap(x, 32).cast("int"), "unsigned int": lambda: wrap(x, 32, False)}.get(kind, lambda: x.cast(TYPES[kind]))()


def _sum(v: Column, kind: str) -> Column:
    if kind in ("int", "unsigned int"):
        return _wrapped(F.sum(v.cast("bigint")), kind)
    if kind in INTEGRAL:
        return wrap64(F.sum(v.cast("decimal(38,0)")), kind == "long").cast(TYPES[kind])
    return F.sum(v.cast("double")).cast(TYPES[kind])


_ANY_TYPE: dict[str, Callable[[Column, str], Column]] = {
    "add": _sum,
    "min": lambda v, kind: F.min(v).cast(TYPES[kind]),
    "max": lambda v, kind: F.max(v).cast(TYPES[kind]),
    "product": lambda v, kind: F.product(v).cast(TYPES[kind]),
    "logical_and": lambda v, kind: F.bool_and(truth(v)).cast("int").cast(TYPES[kind]),
    "logical_or": lambda v, kind: F.bool_or(truth(v)).cast("int").cast(TYPES[kind]),
    "logical_xor": lambda v, kind: (F.count_if(truth(v)) % 2).cast(TYPES[kind]),
}
_INTEGRAL_ONLY: dict[str, Callable[[Column, str], Column]] = {
    "bitwise_and": lambda v, kind: F.bit_and(v.cast("bigint")).cast(TYPES[kind]),
    "bitwise_or": lambda v, kind: F.bit_or(v.cast("bigint")).cast(TYPES[kind]),
    "bitwise_xor": lambda v, kind: F.bit_xor(v.cast("bigint")).cast(TYPES[kind]),
}
OPERATIONS = (*_ANY_TYPE, *_INTEGRAL_ONLY)


def reduction(op: str, kind: str = "long") -> Callable[[str | Column], Column]:
    """The aggregate of a built-in operation for an element type; the result has that type.

    Integer sums wrap as the type does. Products are exact up to 2**53; exact_product, which
    reduce() calls for integers, has all others. Bitwise operations have no meaning on floating point and are refused.
    """
    if kind not in TYPES:
        raise ValueError(f"no such element type: {kind}")
    if op in _INTEGRAL_ONLY and kind not in INTEGRAL:
        raise TypeError(f"{op} needs an integer type, not {kind}")
    make = _ANY_TYPE.get(op) or _INTEGRAL_ONLY.get(op)
    if make is None:
        raise ValueError(f"no such operation: {op}")
    return lambda v: make(F.col(v) if isinstance(v, str) else v, kind)


def reduce(df: DataFrame, keys: list[str], value: str, op: str, kind: str = "long", name: str = "v") -> DataFrame:
    if op == "product" and kind in INTEGRAL:
        return exact_product(df.withColumn("row_", F.monotonically_increasing_id()), keys, value, "row_", kind, name)
    return df.groupBy(*keys).agg(reduction(op, kind)(value).alias(name))


def fold(df: DataFrame, keys: list[str], value: str, merge: Callable[[Column, Column], Column], zero: Column, order: str, fan_in: int = 4096, name: str = "v") -> DataFrame:
    """Any associative and commutative merge of two values, level by level.

    Each level folds groups of about fan_in values, dealt by the hash of a distinct order column,
    until one value is left for each key: no task sees more than a group, however hot its key.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
    level, salt = df.select(*keys, F.col(value).alias(name), F.xxhash64(order).alias("salt_")), 0
    while most > fan_in:
        parts = -(-most // (fan_in // 2))
        level = level.groupBy(*keys, F.pmod(F.xxhash64("salt_", F.lit(salt)), F.lit(parts)).alias("part_")).agg(F.collect_list(name).alias("all_"), F.min("salt_").alias("salt_")).select(*keys, F.aggregate("all_", zero, merge).alias(name), "salt_")
        most, salt = parts, salt + 1
    return level.groupBy(*keys).agg(F.collect_list(name).alias("all_")).select(*keys, F.aggregate("all_", zero, merge).alias(name))


def exact_product(df: DataFrame, keys: list[str], value: str, order: str, kind: str = "int", name: str = "v") -> DataFrame:
    """Product of whole numbers, exact as machine integers of their type wrap. Two factors of 64
    bits with a sign have a product that a decimal holds."""
    if kind in ("int", "unsigned int"):
        done = fold(df, keys, value, lambda a, x: wrap(a * wrap(x.cast("bigint"), 32), 32), F.lit(1).cast("bigint"), order, name=name)
        return done.withColumn(name, wrap(F.col(name), 32, kind == "int").cast(TYPES[kind]))
    whole = "decimal(20,0)"
    done = fold(df, keys, value, lambda a, x: wrap64(a * wrap64(x.cast("decimal(38,0)")).cast(whole)).cast(whole), F.lit(1).cast(whole), order, name=name)
    return done.withColumn(name, wrap64(F.col(name).cast("decimal(38,0)"), kind == "long").cast(TYPES[kind]))


def custom(df: DataFrame, keys: list[str], value: str, function, kind: str = "double", name: str = "v") -> DataFrame:
    """A user's reduction from a pandas Series to one value: run over parts of each key first and
    over their results then, so that it must be associative; keys are never whole in one task
    unless they are small."""
    from pyspark.sql.functions import PandasUDFType, pandas_udf

    agg = pandas_udf(function, TYPES[kind], PandasUDFType.GROUPED_AGG)
    return df.withColumn("part_", F.spark_partition_id()).groupBy(*keys, "part_").agg(agg(F.col(value)).alias(name)).groupBy(*keys).agg(agg(F.col(name)).alias(name))


def sparse_add(df: DataFrame, index: str, value: str, name: str = "v") -> DataFrame:
    """Addition where only values other than the sentinel 0 travel; positions without any are
    absent. Right for addition alone."""
    return df.where(F.col(value) != 0).groupBy(index).agg(F.sum(value).alias(name))


def carried(df: DataFrame, keys: list[str], value: str, state: DataFrame | None = None) -> DataFrame:
    """State kept from one reduction to the next: how many were reduced, and the last buffer.
    state: what the reduction before left, which this one goes on from."""
    new = df.groupBy(*keys).agg(F.count(value).alias("reductions"), F.sum(value).alias("buffer"))
    if state is None:
        return new
    return state.unionByName(new).groupBy(*keys).agg(F.sum("reductions").alias("reductions"), F.sum("buffer").alias("buffer"))


def histogram(df: DataFrame, chunk: Column, digit: Column) -> DataFrame:
    """Counts of each digit in each chunk."""
    return df.groupBy(chunk.alias("chunk"), digit.alias("digit")).agg(F.count("*").alias("n"))


def frobenius_norm(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(keys or [])).agg(F.sqrt(F.sum(F.col(value) * F.col(value)).cast("double")).alias("norm"))


def transfer_totals(df: DataFrame, machine: str, size: str, seconds: str) -> DataFrame:
    """Bytes, time and number of transfers of each machine."""
    return df.groupBy(machine).agg(F.sum(size).alias("bytes"), F.sum(seconds).alias("time"), F.count("*").alias("transfers"))


def execution_rate(df: DataFrame, device: str, subtasks: str, seconds: str) -> DataFrame:
    """Subtasks for each unit of time; null where no time has passed."""
    return df.groupBy(device).agg(F.try_divide(F.sum(subtasks).cast("double"), F.sum(seconds).cast("double")).alias("rate"))


def execution_profile(df: DataFrame, device: str, machine: str) -> DataFrame:
    """Subtasks of each device, and of its machine."""
    by_device = df.groupBy(machine, device).agg(F.count("*").alias("device_subtasks"))
    by_machine = by_device.groupBy(machine).agg(F.sum("device_subtasks").alias("machine_subtasks"))
    return by_device.join(by_machine, machine)
