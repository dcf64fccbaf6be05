"""Mixing sources to target weights by a low-discrepancy schedule.

Golden-ratio points run through the cumulative target weights and give each slot of the mix a
source; a slot's rank among the slots of its source names the block of equally many words that
it takes from the source's shuffled stream of documents, which starts anew when it ends. A source
has as many slots as its target has blocks: ranks beyond are left out, and the few slots that the
points still owe a source come last. Blocks are of BLOCK words, or a FEWth of a small source.

The schedule decides the order: first_slot, where in the mix a document begins. How many words
are taken of it follows from the number of its source's slots by interval arithmetic, since ranks
take the blocks one after another.

A document's place in its source's stream is by a hash of its id and text; ranks, places and
their sums are two-level scans.

Nulls and odd cases: a null source is a source of its own, after all others; a null text has no
words; a document without words is kept with taken = 0 and no first_slot; equal doc_ids are
separate rows; an empty table gives an empty result; further columns are ignored, whatever their
names. A corpus of more than max_sources sources is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: The golden ratio's fraction, and that of its multiple by 2**20, for exact points far out.
STEP = 0.6180339887498949
STEP_20 = float((11400714819323198485 * 2**20 % 2**64) / 2**64)
#: Slots that one schedule row generates.
CHUNK = 1 << 16
#: Words of a block, and blocks that a smaller source has at least, where it has the words.
BLOCK, FEW = 64, 16
#: Documents that one window places, about.
WINDOW_ROWS = 200


def targets(sizes: list[int], weights: list[float], share: float, cap: float) -> list[float]:
    """share of all words, dealt by weight; no source above cap times its own size, the excess
    dealt again among the others."""
    out = [0.0] * len(sizes)
    left, open_ = share * sum(sizes), list(range(len(sizes)))
    while open_:
        each = left / sum(weights[i] for i in open_)
        full = [i for i in open_ if each * weights[i] > cap * sizes[i]]
        if not full:
            for i in open_:
                out[i] = each * weights[i]
            break
        for i in full:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        open_ = [i for i in open_ if i not in set(full)]
        left = max(left, 0.0)
    return out


def points(first: int, n: int) -> np.ndarray:
    """Golden-ratio points number first to first + n - 1, in [0, 1)."""
    i = np.arange(first, first + n, dtype=np.int64)
    return np.modf((i >> 20) * STEP_20 % 1.0 + (i & 0xFFFFF) * STEP + 0.5 * STEP)[0]


def grain(size: int) -> int:
    """Words in a block of a source of this size."""
    return max(1, min(BLOCK, size // FEW))


def quota(size: int, target: float) -> int:
    """Slots of a source: whole passes through its blocks and the blocks of what is left."""
    if not size:
        return 0
    passes = int(target // size)
    return passes * -(-size // grain(size)) + round((target - passes * size) / grain(size))


def _slot_sources(chunk: int, n_slots: int, edges: np.ndarray) -> np.ndarray:
    first = chunk * CHUNK
    at = points(first, min(CHUNK, n_slots - first))
    return np.minimum(np.searchsorted(edges, at, side="right"), len(edges) - 1)


def schedule(spark, quotas: list[int]) -> DataFrame:
    """(src, rank, slot) for every slot of the mix; a source's ranks count from 0 to its quota.

    Two passes over chunks of slots: counts by chunk and source, their running sums, then ranks.
    No source's slots meet in one task.
    """
    want = np.asarray(quotas, np.int64)
    n_slots, live = int(want.sum()), np.flatnonzero(want > 0).astype(np.int32)
    edges = np.cumsum(want[live]) / max(n_slots, 1)
    n_chunks = -(-n_slots // CHUNK)
    chunks = spark.range(0, n_chunks, 1, max(1, min(n_chunks, 4096)))

    def counted(batches):
        for pdf in batches:
            for c in pdf["id"]:
                n = np.bincount(_slot_sources(c, n_slots, edges), minlength=len(live))
                yield pd.DataFrame({"chunk": c, "src": live[n > 0], "n": n[n > 0]})

    def ranked(batches):
        for pdf in batches:
            for c, ks, offs in zip(pdf["id"], pdf["src"], pdf["first"]):
                src = live[_slot_sources(c, n_slots, edges)]
                order = np.argsort(src, kind="stable")
                own, begin, n = np.unique(src[order], return_index=True, return_counts=True)
                first = np.asarray(offs)[np.argsort(ks)]  # of the same sources, ascending
                rank = np.repeat(first - begin, n) + np.arange(len(src))
                ok = rank < want[src[order]]
                yield pd.DataFrame({"src": src[order][ok], "rank": rank[ok], "slot": c * CHUNK + order[ok]})

    w = Window.partitionBy("src").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = common.cut(chunks.mapInPandas(counted, "chunk long, src int, n long"), "mix-slots")
    # One number for each source, of which there are max_sources at most.
    got = {r["src"]: r["n"] for r in counts.groupBy("src").agg(F.sum("n").alias("n")).collect()}
    owed = [(int(s), got.get(int(s), 0), int(want[s]) - got.get(int(s), 0)) for s in live if want[s] > got.get(int(s), 0)]
    after = np.cumsum([n_slots] + [n for *_, n in owed]).tolist()
    late = spark.createDataFrame([(*x, a) for x, a in zip(owed, after)], "src int, first long, n long, after long").selectExpr(
        "src", "first", "after", "explode(sequence(0L, n - 1)) AS k").selectExpr("src", "first + k AS rank", "after + k AS slot")
    offsets = (
        counts.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0)))
        .groupBy(F.col("chunk").alias("id"))
        .agg(F.collect_list(F.struct("src", "first")).alias("x"))
        .select("id", F.col("x.src").alias("src"), F.col("x.first").alias("first"))
    )
    return offsets.mapInPandas(ranked, "src int, rank long, slot long").unionByName(late)


def _placed(docs: DataFrame, weights, share: float, cap: float, seed: int, max_sources: int, keep) -> tuple[DataFrame, DataFrame, int]:
    """Documents with their place in their source's stream and the words taken; the slots; how
    many there are."""
    spark = docs.sparkSession
    common.small_batches(spark)
    size = F.coalesce(F.regexp_count("text", F.lit(common.WORD_PATTERN)), F.lit(0)).cast("long")
    base = common.cut(
        docs.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("h"), *keep)
        .withColumn("rid", F.monotonically_increasing_id()), "mix-sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("total"), F.count("*").alias("rows")).limit(max_sources + 1).collect()
    if len(sums) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sums = sorted(sums, key=lambda r: (r["source"] is None, r["source"] or ""))
    totals = [int(r["total"]) for r in sums]
    goal = targets(totals, [weights[i % len(weights)] for i in range(len(sums))], share, cap)
    quotas = [quota(t, g) for t, g in zip(totals, goal)]
    sources = spark.createDataFrame(
        [(r["source"], i, t, g, grain(t), -(-t // grain(t)), q) for i, (r, t, g, q) in enumerate(zip(sums, totals, goal, quotas))],
        "name string, src int, source_size long, target double, block long, blocks long, quota long")
    n_buckets = max(16, sum(r["rows"] for r in sums) // WINDOW_ROWS)
    placed = (
        base.join(F.broadcast(sources), F.col("source").eqNullSafe(F.col("name")))
        .drop("name", "source")
        .withColumn("bucket", F.pmod(F.shiftright("h", 16), F.lit(n_buckets)))
    )
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("src", "bucket").agg(F.sum("size").alias("n")).select(
        "src", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    upto = Window.partitionBy("src", "bucket").orderBy("h", "doc_id", "size", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        placed.withColumn("end", F.sum("size").over(upto))
        .join(offsets, ["src", "bucket"])
        .withColumn("end", F.col("end") + F.col("offset"))
        .withColumn("start", F.col("end") - F.col("size"))
        .withColumn("passes", F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0))
        .withColumn("rank", F.expr("start div block"))
        # Words of the stream that the last, unfinished pass takes.
        .withColumn("rest", (F.col("quota") - F.col("passes") * F.col("blocks")) * F.col("block"))
        .withColumn("taken", F.col("size") * F.col("passes") + F.greatest(F.lit(0), F.least("end", "rest") - F.col("start")))
    )
    return placed, schedule(spark, quotas), sum(quotas)


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0, seed=7, max_sources=100_000) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_slot for each row of docs.

    weights repeat over the sources in code-point order. max_sources bounds what the driver holds
    and broadcasts: a few numbers for each source; a corpus with more sources is refused.
    """
    placed, slots, _ = _placed(docs, weights, share, cap, seed, max_sources, ())
    begun = F.when(F.col("taken") > 0, F.col("rank"))
    return (
        placed.withColumn("rank", begun).join(slots.withColumnRenamed("slot", "first_slot").hint("merge"), ["src", "rank"], "left")
        .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot")
    )


def mixed_documents(docs: DataFrame, weights=(5.0, 2.0, 1.0), share=1.5, cap=2.0, seed=7, max_sources=100_000) -> DataFrame:
    """The rows of docs as often as the mix takes them, in the order of the mix: whole passes, and
    one more with the chance of the remainder, which doc_id alone decides. Columns as in docs.

    A copy stands where its first word's slot of that pass does; a last copy without one, and
    documents without words, which are kept once, stand anywhere, by their hash."""
    rows, key = common.keyed(docs, "mix-documents")
    own = rows.select("doc_id", "text", "source", F.col(key).alias("key"))
    order = common.unused(rows, "slot")

    def copies() -> DataFrame:
        placed, slots, n_slots = _placed(own, weights, share, cap, seed, max_sources, ("key",))
        part = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(F.lit(1.0))
        spare = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
        n = (F.floor(part) + F.when(spare < part - F.floor(part), 1).otherwise(0)).cast("int")
        return (
            placed.select("key", "h", "src", "rank", "blocks", n.alias("copies")).where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
            .withColumn("rank", F.col("rank") + F.col("copy") * F.col("blocks"))
            .join(slots.hint("merge"), ["src", "rank"], "left")
            .select(F.col("key").alias(key), F.coalesce("slot", F.pmod(F.xxhash64("h", "copy"), F.lit(max(1, n_slots)))).alias(order))
        )

    counts = common.settled(copies, "mix-copies")
    return (
        rows.join(counts.hint("merge"), key)  # one row for a document: never to be broadcast
        .repartitionByRange(order).sortWithinPartitions(order)
        .select(*[F.col(f"`{c}`") for c in docs.columns])
    )
