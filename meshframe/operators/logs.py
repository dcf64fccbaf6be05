"""Execution logs: parsing lines, statistics of runs, profiles and timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arithmetic import two_decimals
from .redistribute import positions
from .scan import CHUNK

# The lines' forms and the modes' names.
RUN_TIME = r"(Serial Task|Parallel Task ([1-6])) Execution Time = ([0-9.]+)"
MACHINE = r"Machine ([0-9]+) Subtasks ([0-9]+)"
MACHINE_CPU = r"Machine ([0-9]+) Subtasks ([0-9]+) CPU-Subtasks ([0-9]+)"
DEVICE = r"Device ([0-9]+) Subtasks ([0-9]+)"
HEADER = r"Task \[([0-9]+), ([0-9]+)\]"
SUBTASK = r"Subtask ([0-9]+)(_Cancelled)? ([0-9.]+) ([0-9.]+)"
PROFILE = r"([A-Z_]+) => Accumulated Time: ([0-9.]+)s; Actual Time = ([0-9.]+)s; Overlapped Time = ([0-9.]+)s"
MODES = ("Serial", "Local CPU", "Local GPU", "Local CPU+GPU", "Global CPU", "Global GPU", "Global CPU+GPU")


def _found(pattern: str, group: int, kind: str, column: str = "line") -> Column:
    return F.nullif(F.regexp_extract(column, pattern, group), F.lit("")).cast(kind)


def run_times(lines: DataFrame) -> DataFrame:
    """mode (0 serial, 1 to 6 parallel) and seconds of each line that tells one; other columns stay."""
    return lines.where(F.col("line").rlike(RUN_TIME)).select(
        *[c for c in lines.columns if c != "line"], F.coalesce(_found(RUN_TIME, 2, "int"), F.lit(0)).alias("mode"), _found(RUN_TIME, 3, "double").alias("seconds"))


def run_statistics(times: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, median and deviation of seconds, to two decimals. The deviation is the population's,
    about the mean as rounded. Groups without samples have no row, which a report shows as null.

    Medians are picked by position, so that no group has to fit in one task."""
    mean, off = F.avg("seconds"), F.avg("seconds") - two_decimals(F.avg("seconds"))
    first = times.groupBy(*keys).agg(
        two_decimals(mean).alias("mean"), F.count("*").alias("samples"), two_decimals(F.sqrt(F.var_pop("seconds") + off * off)).alias("sd"))
    # Equal times go to any place among themselves, and so to any task.
    placed = _in_groups(times.where("seconds IS NOT NULL").select(*keys, "seconds"), keys, ["seconds", F.rand(7)])
    middle = placed.where("place_ IN ((n_ - 1) div 2, n_ div 2)").groupBy(*keys).agg(two_decimals(F.avg("seconds")).alias("median"))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return first.alias("a").join(middle.alias("b"), same, "left").select("a.*", "b.median").select(*keys, "mean", "median", "samples", "sd")


def _in_groups(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """df with place_, a row's place in its group from 0, and n_, the rows of its group. One range
    exchange sorts all groups; a group may take any number of tasks."""
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    placed = positions(df.withColumn("group_", group), ["group_", *order], "place_")
    # A row for each group.
    groups = placed.groupBy("group_").agg(F.min("place_").alias("from_"), F.count("*").alias("n_"))
    return placed.join(groups, "group_").withColumn("place_", F.col("place_") - F.col("from_")).drop("group_", "from_")


def report(statistics: DataFrame, row: str, value: str = "mean") -> DataFrame:
    """A row for each varying, a column for each mode; null where a mode has no run."""
    wide = statistics.groupBy(row).pivot("mode", list(range(len(MODES)))).agg(F.first(value))
    return wide.select(row, *(F.col(str(k)).alias(f"mode_{k}") for k in range(len(MODES))))


def machine_counts(lines: DataFrame) -> DataFrame:
    """machine, subtasks and, where told, CPU subtasks."""
    return lines.where(F.col("line").rlike(MACHINE)).select(
        *[c for c in lines.columns if c != "line"], _found(MACHINE, 1, "int").alias("machine"), _found(MACHINE, 2, "long").alias("subtasks"), _found(MACHINE_CPU, 3, "long").alias("cpu_subtasks"))


def device_counts(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("line").rlike(DEVICE)).select(
        *[c for c in lines.columns if c != "line"], _found(DEVICE, 1, "int").alias("device"), _found(DEVICE, 2, "long").alias("subtasks"))


def distribution(counts: DataFrame, run: str) -> DataFrame:
    """Each machine's share of its run's subtasks in per cent, and its CPU's and GPU's."""
    total = F.sum("subtasks").over(Window.partitionBy(run))
    share = lambda n: 100.0 * n / total
    return counts.select(run, "machine", share(F.col("subtasks")).alias("share"), share(F.col("cpu_subtasks")).alias("cpu_share"), share(F.col("subtasks") - F.col("cpu_subtasks")).alias("gpu_share"))


def load_profile(counts: DataFrame, model: str, models: list) -> DataFrame:
    """Subtasks of each machine, a column for each scheduling model."""
    wide = counts.groupBy("machine").pivot(model, models).agg(F.sum("subtasks"))
    return wide.select("machine", *(F.col(str(m)).alias(f"model_{m}") for m in models))


def steal_overhead(dynamic: DataFrame, static: DataFrame, keys: list[str]) -> DataFrame:
    """How much longer a run takes when it balances itself than when it is given the same balance."""
    return dynamic.select(*keys, F.col("seconds").alias("dynamic")).join(static.select(*keys, F.col("seconds").alias("static")), keys).withColumn("overhead", F.col("dynamic") - F.col("static"))


def timeline(lines: DataFrame, log: str, number: str) -> DataFrame:
    """host, task, subtask, cancelled, begin, end of each subtask line; host and task come from the
    last header above it in the same log. CHUNK lines are read in a task; the last header of each
    chunk is carried to those after it."""
    head = F.when(F.col("line").rlike(HEADER), F.struct(_found(HEADER, 1, "int").alias("host"), _found(HEADER, 2, "int").alias("task")))
    told = lines.select(log, number, "line").where(F.col("line").rlike(f"{HEADER}|{SUBTASK}")).withColumn("head_", head).withColumn("c_", F.floor(F.col(number) / CHUNK))
    own = Window.partitionBy(log, "c_").orderBy(number).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(log).orderBy("c_").rowsBetween(Window.unboundedPreceding, -1)
    # A row for each chunk.
    chunks = told.groupBy(log, "c_").agg(F.max_by("head_", F.when(F.col("head_").isNotNull(), F.col(number))).alias("last_")).select(
        log, "c_", F.last("last_", ignorenulls=True).over(before).alias("above_"))
    at = F.coalesce(F.last("head_", ignorenulls=True).over(own), F.col("above_"))
    return told.join(chunks, [log, "c_"]).withColumn("head_", at).where(F.col("line").rlike(SUBTASK)).select(log, number, "line", "head_.host", "head_.task").select(
        log, number, "host", "task", _found(SUBTASK, 1, "long").alias("subtask"), F.col("line").contains("_Cancelled").alias("cancelled"), _found(SUBTASK, 3, "double").alias("begin"), _found(SUBTASK, 4, "double").alias("end"))


def extents(times: DataFrame, keys: list[str]) -> DataFrame:
    return times.groupBy(*keys).agg(F.min("begin").alias("begin"), F.max("end").alias("end"))


def number_in(label: Column | str) -> Column:
    """The first number in a label, to sort labels by."""
    return F.nullif(F.regexp_extract(label, "([0-9]+)", 1), F.lit("")).cast("long")


def numeric_sort(df: DataFrame, label: str, name: str = "pos") -> DataFrame:
    """Rows with their place when labels are sorted by their first number, those without one first,
    and then by the label itself."""
    return positions(df, [F.coalesce(number_in(label), F.lit(-1)), F.col(label)], name)


def profiles(lines: DataFrame) -> DataFrame:
    """event, accumulated, actual, overlapped of each profiler line."""
    return lines.where(F.col("line").rlike(PROFILE)).select(
        *[c for c in lines.columns if c != "line"], _found(PROFILE, 1, "string").alias("event"), *(_found(PROFILE, k + 2, "double").alias(n) for k, n in enumerate(("accumulated", "actual", "overlapped"))))


def overlapped(spans: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """accumulated: the sum over time of how many spans run; actual: time with any; overlapped: the
    difference. A sweep over the ends of the spans, those at one time as one row, in chunks of
    their order: a chunk starts with the sum of those before it and ends where the next begins."""
    edges = spans.select(*keys, F.explode(F.array(F.struct(F.col(begin).alias("t"), F.lit(1).alias("d")), F.struct(F.col(end).alias("t"), F.lit(-1).alias("d")))).alias("e")).groupBy(*keys, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"))
    chunked = _in_groups(edges, keys, ["t"]).select(*keys, "t", "d", F.expr(f"place_ div {CHUNK}").alias("c_"))
    above = Window.partitionBy(*keys).orderBy("c_")
    # A row for each chunk.
    chunks = chunked.groupBy(*keys, "c_").agg(F.sum("d").alias("d_"), F.min("t").alias("t_")).select(
        *keys, "c_", F.coalesce(F.sum("d_").over(above.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"), F.lead("t_").over(above).alias("next_"))
    w = Window.partitionBy(*keys, "c_").orderBy("t")
    steps = (
        chunked.join(chunks, [*keys, "c_"])
        .withColumn("n", F.col("before_") + F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("dt", F.coalesce(F.lead("t").over(w), F.col("next_")) - F.col("t"))
    )
    sums = steps.groupBy(*keys).agg(F.sum(F.col("n") * F.col("dt")).alias("accumulated"), F.sum(F.when(F.col("n") > 0, F.col("dt")).otherwise(0)).alias("actual"))
    return sums.withColumn("overlapped", F.col("accumulated") - F.col("actual"))


def chart_table(df: DataFrame, select: list[int] | None = None, skip: list[int] = ()) -> DataFrame:
    """Columns chosen or left out by their place."""
    places = range(len(df.columns)) if select is None else select
    return df.select(*(df.columns[i] for i in places if i not in set(skip)))


def median_sample(samples: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """The sample in the middle of each group, the lower one of two."""
    return _in_groups(samples, keys, [value, tie]).where("place_ = (n_ - 1) div 2").drop("place_", "n_")


def result_cube(results: DataFrame, varyings: list[str], settings: list[str], value: str) -> DataFrame:
    """One row for each setting of a benchmark, with its best and mean time."""
    return results.groupBy(*varyings, *settings).agg(F.min(value).alias("best"), F.avg(value).alias("mean"), F.count("*").alias("samples"))


def load_balance(profile: DataFrame, machine: str, subtasks: str) -> DataFrame:
    """A report panel: the fewest and the most subtasks of a machine's devices, and their mean."""
    return profile.groupBy(machine).agg(F.min(subtasks).alias("fewest"), F.max(subtasks).alias("most"), F.avg(subtasks).alias("mean"))


def overlap_share(sums: DataFrame, keys: list[str]) -> DataFrame:
    """A report panel: the per cent of accumulated time that ran beside other work."""
    return sums.select(*keys, F.try_divide(F.col("overlapped") * 100.0, F.col("accumulated")).alias("percent"))


def panel(cube: DataFrame, by: list[str], value: str = "best") -> DataFrame:
    """A report panel: the cube summed up by some of its keys."""
    return cube.groupBy(*by).agg(F.min(value).alias("best"), F.max(value).alias("worst"), F.count("*").alias("settings"))
