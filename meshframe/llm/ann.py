"""Approximate nearest neighbours: a forest of random-projection trees and exact reranking.

Each tree cuts space by hyperplanes between two random vectors of the node, at the median, and is
fitted to a bounded sample; every vector is indexed in a leaf of each tree. A query walks all
trees at once through one priority queue, ordered by the chance that a neighbour lies in a node:
the product, over the cuts on the way, of a normal distribution's share on that side, whose width
is the distance of the query's k-th neighbour in the sample over the square root of the dimension.
The candidates' cosines are then computed exactly, in double precision, on the original vectors.

A query stops when its chance of missing a neighbour in all trees, as the leaves taken leave it, has
fallen to a threshold. That is fitted to the sample: vectors of it search their own neighbours in
it, and the threshold is where RECALL of these are found. In the whole table neighbours are nearer,
so that no fewer are. How many leaves that takes is the data's own affair: few where vectors are
clustered, a third of all vectors where they are noise, whatever the table's size.

Of equal vectors only the k + 1 with the least ids can be among anyone's k nearest, and only those
are indexed, so that no leaf fills up with copies. Of a leaf all vectors are reranked that a rough
cosine does not rule out, ties too. Leaves travel in buckets of a bounded size.

Odd cases: vectors that are null, empty, zero or hold null or non-finite components, those of
another length than most of the sample, and rows without an id take no part; ties go to the lesser
id; equal rows are one candidate; fewer candidates than k are all returned; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: Vectors of the sample that search it, and the share of their neighbours that has to be found.
ASKED, RECALL = 200, 0.96
#: Rough cosines differ from exact ones by far less.
ROUGH = 1e-9


class Tree:
    """Cuts of one tree. Children below zero are leaves: ~child is the leaf's number."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.normals, self.at, self.kids, leaves = [], [], [], 0
        stack = [(np.arange(len(sample)), -1, 0)]
        while stack:
            rows, parent, side = stack.pop()
            normal = None
            if len(rows) > leaf:
                for _ in range(5):
                    a, b = sample[rng.choice(rows, 2, replace=False)]
                    if np.abs(a - b).max() > 1e-9:
                        normal = (a - b) / np.linalg.norm(a - b)
                        along = sample[rows] @ normal
                        cut = float(np.median(along))
                        right = along > cut
                        if right.any() and not right.all():
                            break
                        normal = None
            if normal is None:
                number = ~leaves
                leaves += 1
            else:
                number = len(self.normals)
                self.normals.append(normal)
                self.at.append(cut)
                self.kids.append([0, 0])
                stack += [(rows[~right], number, 0), (rows[right], number, 1)]
            if parent >= 0:
                self.kids[parent][side] = number
        self.leaves = leaves
        self.normals = np.array(self.normals).reshape(len(self.normals), sample.shape[1] if sample.ndim == 2 else 0)
        self.at, self.kids = np.array(self.at), np.array(self.kids, np.int64).reshape(-1, 2)

    def leaf_of(self, unit: np.ndarray) -> np.ndarray:
        if not len(self.normals):
            return np.zeros(len(unit), np.int64)
        node = np.zeros(len(unit), np.int64)
        while (live := np.flatnonzero(node >= 0)).size:
            n = node[live]
            right = np.einsum("ij,ij->i", unit[live], self.normals[n]) > self.at[n]
            node[live] = self.kids[n, right.astype(np.int64)]
        return ~node


class Forest:
    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int):
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1] if len(sample) else 0
        self.trees = [Tree(sample, leaf, rng) for _ in range(trees)]
        self.first = np.cumsum([0] + [t.leaves for t in self.trees])

    def leaves_of(self, unit: np.ndarray) -> np.ndarray:
        """Leaf of each vector in each tree, numbered over all trees."""
        return np.stack([t.leaf_of(unit) + f for t, f in zip(self.trees, self.first)], 1)

    def walk(self, unit: np.ndarray, width: float) -> Iterator[tuple[int, float]]:
        """Leaves for one query, best first, each with the chance that a neighbour of the query is
        in none of those so far."""
        queue, missed, sides = [], np.ones(len(self.trees)), []
        for k, t in enumerate(self.trees):
            z = (t.normals @ unit - t.at) / width if len(t.normals) else np.empty(0)
            sides.append((_log_normal(-z).tolist(), _log_normal(z).tolist()))
            queue.append((-0.0, k, 0 if len(t.normals) else -1))
        while queue:
            log, k, node = heapq.heappop(queue)
            if node < 0:
                missed[k] = max(0.0, missed[k] - math.exp(-log))
                yield int(self.first[k]) + ~node, float(missed.prod())
                continue
            for side, kid in enumerate(self.trees[k].kids[node].tolist()):
                heapq.heappush(queue, (log - sides[k][side][node], k, kid))


def _log_normal(z: np.ndarray) -> np.ndarray:
    """Logarithm of the normal distribution function, by a logistic function near it."""
    return -np.logaddexp(0.0, -(1.5976 * z + 0.070565 * z**3))


class Search:
    """A forest with what the sample tells of distances and of when to stop."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, k: int, seed: int):
        self.forest, self.k = Forest(sample, trees, leaf, seed), k
        self.sample = sample.astype(np.float32)
        rng = np.random.default_rng(seed)
        self.least = 0.0
        if len(sample) <= k + 1:
            return
        some = rng.choice(len(sample), min(ASKED, len(sample)), replace=False)
        near = np.argsort(-(sample[some] @ sample.T), axis=1, kind="stable")[:, : k + 1]
        leaves, ends = self.forest.leaves_of(sample), []
        for unit, width, row, own in zip(sample[some], self.widths(sample[some]), near, some):
            wanted = [set(leaves[i].tolist()) for i in row if i != own][:k]
            before = 1.0
            for number, missed in self.forest.walk(unit, width):
                found = [w for w in wanted if number in w]
                ends += [before] * len(found)
                wanted = [w for w in wanted if number not in w]
                before = missed
                if not wanted:
                    break
        # A leaf is taken while the chance is above this: so RECALL of the neighbours were found.
        self.least = float(np.quantile(ends, 1 - RECALL, method="lower")) * (1 - 1e-9)

    def widths(self, unit: np.ndarray) -> np.ndarray:
        """How far a neighbour of each query may lie from it along a cut's normal. A query that
        is in the sample finds itself there first."""
        k = min(self.k + 1, len(self.sample)) - 1
        near = -np.partition(-(unit.astype(np.float32) @ self.sample.T), k, axis=1)[:, k] if len(self.sample) else np.zeros(len(unit))
        return np.sqrt(np.maximum(2 - 2 * near.astype(np.float64), 1e-6) / max(1, unit.shape[1]))

    def leaves(self, unit: np.ndarray) -> list[list[int]]:
        """Leaves that each query takes."""
        out = []
        for u, width in zip(unit, self.widths(unit)):
            out.append([])
            before = 1.0
            for number, missed in self.forest.walk(u, width):
                if before < self.least:
                    break
                out[-1].append(number)
                before = missed
        return out


def unit_rows(vectors, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors can take part, and those as unit vectors in double precision."""
    ok, rows = [], []
    for i, v in enumerate(vectors):
        if v is None:
            continue
        x = np.array([np.nan if c is None else c for c in v], np.float64) if not isinstance(v, np.ndarray) or v.dtype == object else v.astype(np.float64)
        if len(x) and (dim is None or len(x) == dim) and np.isfinite(x).all() and x.any():
            ok.append(i)
            rows.append(x / np.abs(x).max())
    if dim is None and rows:
        dim = Counter(map(len, rows)).most_common(1)[0][0]
        ok, rows = zip(*((i, x) for i, x in zip(ok, rows) if len(x) == dim))
    out = np.array(rows).reshape(len(rows), dim or 0)
    return np.array(ok, np.int64), out / np.linalg.norm(out, axis=1, keepdims=True)


def scaled(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors, however large or small."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosines of a vector with others, each row's by the same sums wherever it stands."""
    return (rows * query).sum(1) / np.sqrt((rows * rows).sum(1) * (query * query).sum())


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, trees: int = 10, leaf: int = 64, max_sample: int = 20_000, bucket_rows: int = 40_000, seed: int = 3) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, embedding) among
    vectors (vec_id, embedding) with another id."""
    spark = vectors.sparkSession
    common.small_batches(spark)
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    queries = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null and embedding is not null")
    same = Window.partitionBy(F.xxhash64("embedding"), F.xxhash64(F.lit(1), "embedding")).orderBy("vec_id")
    rows = common.cut(vectors.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).drop("n"), "ann-rows")
    n = rows.count()
    # The sample: at most max_sample vectors, those with the least hashes of their ids.
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max_sample).toPandas()["embedding"]
    _, unit = unit_rows(sample)
    search = Search(unit, trees, max(8, leaf * len(unit) // max(n, 1)), k, seed)
    forest = search.forest
    dim, n_leaves = forest.dim, int(forest.first[-1])

    def indexed(batches):
        for pdf in batches:
            ok, unit = unit_rows(pdf["embedding"], dim)
            if not len(ok):
                continue
            leaves = forest.leaves_of(unit)
            raw = [np.asarray(pdf["embedding"].iloc[i], np.float64).tobytes() for i in ok]
            ids = pdf["vec_id"].to_numpy()[ok]
            for t in range(leaves.shape[1]):
                yield pd.DataFrame({"leaf": leaves[:, t], "vec_id": ids, "raw": raw})

    placed = rows.mapInPandas(indexed, "leaf int, vec_id long, raw binary")
    # One number for each leaf; the sample bounds how many there are.
    sizes = np.zeros(n_leaves, np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("c")).collect():
        sizes[r["leaf"]] = r["c"]
    buckets = max(1, -(-n * trees // bucket_rows))
    # A leaf with more rows than a bucket should have is dealt over several.
    parts = np.maximum(1, -(-sizes // bucket_rows))

    def asked(batches):
        for pdf in batches:
            ok, unit = unit_rows(pdf["embedding"], dim)
            found = search.leaves(unit)
            ids = pdf["vec_id"].to_numpy()[ok]
            raw = np.array([np.asarray(pdf["embedding"].iloc[i], np.float64) for i in ok]).reshape(len(ok), dim)
            q = np.repeat(np.arange(len(found)), [len(x) for x in found])
            at = np.array([x for y in found for x in y], np.int64)
            q, at = np.repeat(q, parts[at]), np.repeat(at, parts[at])
            first = np.flatnonzero(np.append(True, (q[1:] != q[:-1]) | (at[1:] != at[:-1])))
            part = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) if len(q) else q
            bucket = (at + part) % buckets
            for b in np.unique(bucket):
                here = bucket == b
                who, local = np.unique(q[here], return_inverse=True)
                yield pd.DataFrame({"bucket": [int(b)], "ids": [ids[who].tobytes()], "raw": [raw[who].tobytes()], "who": [local.astype(np.int32).tobytes()], "leaf": [at[here].astype(np.int32).tobytes()]})

    def compared(index, asking):
        best: dict[int, tuple] = {}
        groups = index.groupby("leaf").indices
        ids, raw = index["vec_id"].to_numpy(), index["raw"].to_numpy()
        held: dict[int, tuple] = {}
        for r in asking.itertuples():
            qid, qraw = np.frombuffer(r.ids, np.int64), np.frombuffer(r.raw).reshape(-1, dim)
            who, leaf = np.frombuffer(r.who, np.int32), np.frombuffer(r.leaf, np.int32)
            order = np.argsort(leaf, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(leaf[order])) + 1):
                number = int(leaf[own[0]])
                if number not in groups:
                    continue
                if number not in held:
                    m = np.array([np.frombuffer(x) for x in raw[groups[number]]])
                    held[number] = ids[groups[number]], m, scaled(m)
                vec, m, u = held[number]
                rough = scaled(qraw[who[own]]) @ u.T  # rules out; the exact cosines follow
                last = min(len(vec), k + 1)  # the query itself may be among them
                least = np.partition(rough, len(vec) - last, axis=1)[:, len(vec) - last] - ROUGH
                for w, cosine, bound in zip(who[own], rough, least):
                    p = np.flatnonzero(cosine >= bound)
                    p = p[vec[p] != qid[w]]
                    old = best.get(int(qid[w]), (np.empty(0, np.int64), np.empty(0)))
                    v, at = np.unique(np.append(old[0], vec[p]), return_index=True)
                    c = np.append(old[1], cosines(qraw[w], m[p]))[at]
                    first = np.lexsort((v, -c))[:k]
                    best[int(qid[w])] = v[first], c[first]
        return pd.DataFrame([(q, v, c) for q, (vs, cs) in best.items() for v, c in zip(vs.tolist(), cs.tolist())], columns=["query_id", "vec_id", "score"])

    many = [int(x) for x in np.flatnonzero(parts > 1)]
    part = F.pmod(F.xxhash64("vec_id"), F.element_at(F.create_map(*[F.lit(y) for x in many for y in (x, int(parts[x]))]), F.col("leaf"))) if many else F.lit(None)
    spread = F.when(F.col("leaf").isin(many), part).otherwise(F.lit(0)) if many else F.lit(0)
    index = placed.withColumn("bucket", ((F.col("leaf") + spread) % buckets).cast("int"))
    found = index.groupBy("bucket").cogroup(queries.mapInPandas(asked, "bucket int, ids binary, raw binary, who binary, leaf binary").groupBy("bucket")).applyInPandas(compared, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
