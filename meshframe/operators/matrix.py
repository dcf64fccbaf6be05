"""Matrices as (r, c, v) rows, zeros left out where sparse, and as dense blocks for numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.durable import drop, durable, fresh
from ..session import ship
from . import scan


#: Joined products that take as long as one multiplication in a dense block, and those that any
#: join may sum.
PRODUCT, FEW = 1 / 200, 2e8
#: Columns of a dense result that are sent to every task at most.
WIDE = 100_000


def matmul(a: DataFrame, b: DataFrame, block: int = 512) -> DataFrame:
    """A * B, whole numbers exactly: by an equi-join on the inner index and a partial and final sum
    where sparse, by dense blocks where the join would have more products to sum."""
    if _worth_blocks(a, b, block):
        return matmul_blocks(a, b, block, zeros=True)
    left = a.select(F.col("r"), F.col("c").alias("k"), F.col("v").alias("x"))
    right = b.select(F.col("r").alias("k"), F.col("c"), F.col("v").alias("y"))
    return left.join(right, "k").groupBy("r", "c").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def _worth_blocks(a: DataFrame, b: DataFrame, block: int) -> bool:
    """Whether the join's products outweigh the work on dense blocks, from counts by inner index."""
    kinds = {f.dataType.typeName() for m in (a, b) for f in m.schema if f.name == "v"}
    if not (kinds <= {"byte", "short", "integer", "long"} or kinds <= {"float", "double"}):
        return False
    own = a.groupBy(F.col("c").alias("k")).agg(F.count("*").alias("n"))
    other = b.groupBy(F.col("r").alias("k")).agg(F.count("*").alias("m"))
    products = own.join(other, "k").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    if products <= FEW:
        return False
    # Times the zeros that fill a block, an infinite element would spoil others.
    if kinds <= {"float", "double"} and a.select("v").unionAll(b.select("v")).where("isnan(v) OR abs(v) = double('infinity')").limit(1).count():
        return False
    at = lambda c: F.floor(F.col(c) / block)
    rows = a.select(at("c").alias("k"), at("r").alias("o")).distinct().groupBy("k").agg(F.count("*").alias("n"))
    cols = b.select(at("r").alias("k"), at("c").alias("o")).distinct().groupBy("k").agg(F.count("*").alias("m"))
    pairs = rows.join(cols, "k").agg(F.sum(F.col("n").cast("double") * F.col("m"))).first()[0] or 0.0
    return products > pairs * block**3 * PRODUCT


def sparse_times_dense(a: DataFrame, b: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Sparse A times dense B; with rows (r), a dense result where rows without elements are 0."""
    out = matmul(a.where("v <> 0"), b)
    if rows is None:
        return out
    columns, rows = b.select("c").distinct(), rows.select("r").distinct()
    n = columns.count()
    if n <= WIDE:
        cells = rows.join(F.broadcast(columns), how="cross")
    else:  # groups of columns meet every row
        groups = -(-n // WIDE) * 8
        cells = rows.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).join(
            columns.withColumn("g", F.pmod(F.hash("c"), F.lit(groups))), "g").drop("g")
    return cells.join(out, ["r", "c"], "left").withColumn("v", F.coalesce("v", F.lit(0)))


#: The arrays that hold a block's cells.
CELLS = ("i", "j", "v")


def to_blocks(a: DataFrame, block: int, kind: str = "double") -> DataFrame:
    """(br, bc, i, j, v) with the cells of each block as arrays."""
    cell = F.struct((F.col("r") % block).cast("int").alias("i"), (F.col("c") % block).cast("int").alias("j"), F.col("v").cast(kind).alias("v"))
    return a.groupBy(F.floor(F.col("r") / block).alias("br"), F.floor(F.col("c") / block).alias("bc")).agg(F.collect_list(cell).alias("x")).select(
        "br", "bc", *(F.col(f"x.{c}").alias(c) for c in CELLS))


def _dense(i, j, v, block: int, kind=np.float64) -> np.ndarray:
    out = np.zeros((block, block), kind)
    out[np.asarray(i, np.int64), np.asarray(j, np.int64)] = np.asarray(v, kind)
    return out


def _cells(m: np.ndarray, br: int, bc: int, block: int, held: np.ndarray | None = None) -> pd.DataFrame:
    i, j = np.nonzero(m if held is None else held)
    return pd.DataFrame({"r": br * block + i, "c": bc * block + j, "v": m[i, j]})


def matmul_blocks(a: DataFrame, b: DataFrame, block: int = 512, zeros: bool = False) -> DataFrame:
    """A * B of dense matrices: blocks that share an inner index meet, numpy multiplies them, and
    products of a block are summed. Elements that come out as 0 in a product of two blocks are left
    out; with zeros, those without any pair of elements are. Whole numbers are multiplied exactly."""
    ship(a.sparkSession)
    whole = all(m.schema["v"].dataType.typeName() in ("byte", "short", "integer", "long") for m in (a, b))
    kind, sql = (np.int64, "long") if whole else (np.float64, "double")
    x = to_blocks(a, block, sql).withColumnsRenamed({"bc": "bk", **{c: f"x{c}" for c in CELLS}})
    y = to_blocks(b, block, sql).withColumnsRenamed({"br": "bk", **{c: f"y{c}" for c in CELLS}})
    both = [f"{side}{c}" for side in "xy" for c in CELLS]

    def multiply(batches):
        for pdf in batches:
            for br, bc, xi, xj, xv, yi, yj, yv in zip(pdf["br"], pdf["bc"], *(pdf[c] for c in both)):
                held = _dense(xi, xj, np.ones(len(xi)), block) @ _dense(yi, yj, np.ones(len(yi)), block) if zeros else None
                yield _cells(_dense(xi, xj, xv, block, kind) @ _dense(yi, yj, yv, block, kind), br, bc, block, held)

    return x.join(y, "bk").select("br", "bc", *both).mapInPandas(multiply, f"r long, c long, v {sql}").groupBy("r", "c").agg(F.sum("v").alias("v"))


def row_pointers(a: DataFrame, rows: DataFrame) -> DataFrame:
    """(r, start, n): where each row's elements start in compressed sparse row order."""
    counts = rows.select("r").distinct().join(a.groupBy("r").agg(F.count("*").alias("n")), "r", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    starts = scan.prefix_scan(counts, "r", "n", inclusive=False, name="start")
    return starts.select("r", "start", "n")


def transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("c").alias("r"), F.col("r").alias("c"), "v")


def crout(m: np.ndarray) -> np.ndarray:
    """L and U of m in one matrix, without pivoting: U has a unit diagonal, L has not."""
    m = m.copy()
    for k in range(len(m)):
        m[k, k + 1 :] /= m[k, k]
        m[k + 1 :, k + 1 :] -= np.outer(m[k + 1 :, k], m[k, k + 1 :])
    return m


def lu(a: DataFrame, n: int, block: int = 64) -> DataFrame:
    """Packed LU factors of a dense n by n matrix, block by block: the diagonal block is factored,
    its row and column of blocks are solved against it, and all blocks beyond are updated. Fails
    on a zero pivot."""
    spark = a.sparkSession
    ship(spark)
    count = -(-n // block)
    size = lambda b: min(block, n - b * block)
    schema = "br long, bc long, data binary"

    def packed(batches):
        for pdf in batches:
            data = [_dense(i, j, v, block).tobytes() for i, j, v in zip(pdf["i"], pdf["j"], pdf["v"])]
            yield pd.DataFrame({"br": pdf["br"], "bc": pdf["bc"], "data": data})

    def load(raw, br, bc):
        return np.frombuffer(raw).reshape(block, block)[: size(br), : size(bc)]

    def store(m):
        out = np.zeros((block, block))
        out[: m.shape[0], : m.shape[1]] = m
        return out.tobytes()

    # A round writes its finished row and column of blocks, which nothing touches again, and the
    # blocks that are still open; those of the round before go.
    finished, path = fresh(spark), fresh(spark)
    state = durable(to_blocks(a, block).mapInPandas(packed, schema), path)
    for k in range(count):

        def solved(batches, k=k):
            p = None
            for pdf in batches:
                data = []
                for br, bc, raw, pivot in zip(pdf["br"], pdf["bc"], pdf["data"], pdf["pivot"]):
                    if p is None:  # the same for all rows
                        p = crout(load(pivot, k, k))
                        if not np.isfinite(p).all():
                            raise ZeroDivisionError("zero pivot")
                    m = load(raw, br, bc)
                    if br == bc:
                        m = p
                    elif br == k:
                        m = np.linalg.solve(np.tril(p), m)
                    else:
                        m = np.linalg.solve((np.triu(p, 1) + np.eye(len(p))).T, m.T).T
                    data.append(store(m))
                yield pd.DataFrame({"br": pdf["br"], "bc": pdf["bc"], "data": data})

        def updated(batches):
            for pdf in batches:
                data = [store(load(x, r, c) - np.frombuffer(lo).reshape(block, block)[: size(r)] @ np.frombuffer(up).reshape(block, block)[:, : size(c)]) for r, c, x, lo, up in zip(pdf["br"], pdf["bc"], pdf["data"], pdf["low"], pdf["up"])]
                yield pd.DataFrame({"br": pdf["br"], "bc": pdf["bc"], "data": data})

        edge = (F.col("br") == k) | (F.col("bc") == k)
        # One block of fixed size.
        pivot = F.broadcast(state.where((F.col("br") == k) & (F.col("bc") == k)).select(F.col("data").alias("pivot")))
        sides = durable(state.where(edge).join(pivot, how="cross").mapInPandas(solved, schema), f"{finished}/{k}")
        if k + 1 == count:
            break
        low = sides.where(F.col("bc") == k).select("br", F.col("data").alias("low"))
        up = sides.where(F.col("br") == k).select("bc", F.col("data").alias("up"))
        old, path = path, fresh(spark)
        state = durable(state.where(~edge).join(low, "br").join(up, "bc").select("br", "bc", "data", "low", "up").mapInPandas(updated, schema), path)
        drop(spark, old)
    drop(spark, path)

    def unpacked(batches):
        for pdf in batches:
            for br, bc, raw in zip(pdf["br"], pdf["bc"], pdf["data"]):
                yield _cells(load(raw, br, bc), br, bc, block)

    return spark.read.schema(schema).parquet(f"{finished}/*").mapInPandas(unpacked, "r long, c long, v double")


def lower(packed: DataFrame) -> DataFrame:
    return packed.where("r >= c")


def upper(packed: DataFrame, n: int) -> DataFrame:
    ones = packed.sparkSession.range(n).select(F.col("id").alias("r"), F.col("id").alias("c"), F.lit(1.0).alias("v"))
    return packed.where("r < c").unionByName(ones)


def rebuild(packed: DataFrame, n: int, block: int = 512) -> DataFrame:
    """L * U."""
    return matmul_blocks(lower(packed), upper(packed, n), block)
