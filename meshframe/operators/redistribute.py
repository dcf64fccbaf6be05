"""Redistribution: rows change places by an order key; sorting by digits; rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.durable import durable


def positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with each row's place, from 0, in the given total order.

    Rows are range-partitioned and numbered inside each partition, and partitions start where the
    counts of those before them end: no window sees more than a partition. The last columns of
    order must tell rows apart for a place to be the same in every run.
    """
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    keyed = df.select("*", *(c.alias(f"o{i}_") for i, c in enumerate(cols)))
    keys = [f"o{i}_" for i in range(len(cols))]
    dealt = durable(keyed.repartitionByRange(*keys).withColumn("part_", F.spark_partition_id()))
    # One count for each partition.
    counts = sorted((r["part_"], r["count"]) for r in dealt.groupBy("part_").count().collect())
    starts, at = [], 0
    for part, n in counts:
        starts.append((part, at))
        at += n
    first = df.sparkSession.createDataFrame(starts, "part_ int, first_ long")
    w = Window.partitionBy("part_").orderBy(*keys)
    return dealt.join(F.broadcast(first), "part_").withColumn(name, F.row_number().over(w) - 1 + F.col("first_")).drop("part_", "first_", *keys)


def redistribute(df: DataFrame, order: Column, source: list[str], name: str = "pos") -> DataFrame:
    """Concatenate by ascending order key; equal keys stay in the order of their source."""
    return positions(df, [order, *source], name)


def metadata(df: DataFrame, order: Column, length: Column) -> DataFrame:
    """Total length of each order key."""
    return df.groupBy(order.alias("order")).agg(F.sum(length).alias("length"))


def counting_round(df: DataFrame, digit: Column, index: str, name: str = "pos") -> DataFrame:
    """One stable round of a counting sort."""
    return positions(df, [digit, index], name)


def radix_sort(df: DataFrame, value: str, index: str, name: str = "pos") -> DataFrame:
    """What all rounds of a stable least-significant-digit sort end in: ascending values, equal
    ones in the order of index. One range exchange instead of a round for each digit."""
    return positions(df, [value, index], name)


def radix_rounds(df: DataFrame, value: str, index: str, bits: int = 4, rounds: int = 8, name: str = "pos") -> DataFrame:
    """The same by its rounds, each a stable pass over one digit of unsigned values."""
    out = df.withColumn(name, F.col(index))
    for k in range(rounds):
        digit = F.shiftrightunsigned(value, k * bits).bitwiseAND((1 << bits) - 1)
        out = positions(out.withColumnRenamed(name, "at_"), [digit, "at_"], name).drop("at_")
    return out


def msd_round(df: DataFrame, value: str, index: str, bits: int = 4, width: int = 32, name: str = "pos") -> DataFrame:
    """A round by the most significant digit."""
    return positions(df, [F.shiftrightunsigned(value, width - bits).bitwiseAND((1 << bits) - 1), index], name)


def device_ranking(counts: DataFrame, n: str, device: str) -> DataFrame:
    """Devices by subtasks finished, most first; for the bounded list of devices."""
    return counts.withColumn("place", F.row_number().over(Window.orderBy(F.col(n).desc(), device)))


def steal_victim(stubs: DataFrame, queued: str, running: str, stub: str, ignore: int | None = None, multi: str | None = None, kind: str | None = None, seed: int = 0) -> DataFrame:
    """The stub with most queued subtasks; where none has any, the one with most in its pipeline;
    where multi names a flag, else one drawn by the seed from those that carry it, of another kind
    than the asking stub's if there are such. The asking stub, ignore, is never its own victim."""
    asks = F.lit(True) if ignore is None else F.col(stub) != ignore
    most = lambda c: F.max_by(stub, F.when(asks & (F.col(c) > 0), F.struct(F.col(c), -F.col(stub))))
    choices = [most(queued), most(running)]
    rows = stubs
    if multi:
        if ignore is not None and kind:
            rows = rows.join(F.broadcast(stubs.where(F.col(stub) == ignore).select(F.col(kind).alias("own_kind_")).limit(1)), how="left")
        drawn = lambda ok: F.min_by(stub, F.when(asks & F.col(multi) & ok, F.xxhash64(F.lit(seed), stub)))
        if "own_kind_" in rows.columns:
            choices.append(drawn(F.col(kind) != F.col("own_kind_")))
        choices.append(drawn(F.lit(True)))
    return rows.agg(F.coalesce(*choices).alias("victim"))


def affinity_pick(costs: DataFrame, machine: str, subtask: str, cost: str, k: int) -> DataFrame:
    """The k best subtasks of each machine."""
    w = Window.partitionBy(machine).orderBy(cost, subtask)
    return costs.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def affinity_difference(costs: DataFrame, machine: str, subtask: str, cost: str, one: int, other: int, k: int) -> DataFrame:
    """The k subtasks that one machine is better for than the other by most: (subtask, gain)."""
    at = lambda m: F.max(F.when(F.col(machine) == m, F.col(cost)))
    both = costs.where(F.col(machine).isin(one, other)).groupBy(subtask).agg((at(other) - at(one)).alias("gain"))
    return both.where("gain is not null").orderBy(F.col("gain").desc(), subtask).limit(k)


def better(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Whether a beats b by two costs, neither below zero: less in both, or less in one with the
    other alike and above zero. Where each is less in one cost, neither beats the other: the rule
    "within a tenth on the other" then holds both ways round and is taken back.
    Not a total order: filter by it, never sort."""
    return ((a1 < b1) & (a2 < b2)) | ((a1 < b1) & (a2 == b2) & (b2 > 0)) | ((a1 == b1) & (a2 < b2) & (b1 > 0))
