"""N-gram Jaccard join by prefix trees, and its components.

A document's set holds its distinct 5-word shingles (lower-cased A-Z; with fewer words, the whole
sequence as one shingle). Two documents link when 100 * |intersection| >= 75 * |union|. Shingles
have one global order: those that are rare by a count sketch over the whole corpus come first,
and a linking pair must share shingles in the first quarter of both ordered sets.

1. One pass counts shingles in a sketch of fixed size and gives each document its set's size and
   key; documents with equal sets are one from here on.
2. First quarters meet by shingle; shingles of one set alone go.
3. Blocks of sets that share their first common shingle are joined in memory-bounded blocks, each
   in a trie of ordered sets: a traversal shares the overlap with a common beginning among all
   sets below it, leaves subtrees that the remaining lengths can't lift to the threshold, and
   those whose sets are in the traversing set's component already. Large blocks are split, with
   one common set in every part.
4. Only sets of different components that share a shingle are left. They must share so many of the
   first quarters' shingles as the sizes demand; a set meets the single sets that pass in a trie,
   and components of many sets in a grid of parts. So no link between components is lost, and
   groups of near copies never become pairs.

Odd cases: null and empty texts have empty sets, and are linked with nothing; a null doc_id joins
like any other but is no component_id while its component has another; equal rows are copies; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

N = 5
#: Counters of the sketch, as a power of two, and the slices that carry them.
SKETCH_BITS, SLICES = 23, 16
#: The filter of documents at most, as a power of two; sets that a task remembers.
BLOOM_BITS, SENT = 27, 500_000
#: Sets in a block at most, but for the one that all parts of a block share.
BLOCK = 400
LEVEL_SHIFT, HASH_SHIFT = 58, 6
_MUL = np.uint64(0x9E3779B97F4A7C15)
_END = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    flat, n = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        flat += w
        n.append(len(w))
    if not flat:
        return [np.empty(0, np.uint64) for _ in n]
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    words = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)[codes]
    runs = words.copy()
    with np.errstate(over="ignore"):
        for k in range(1, min(N, len(words))):
            runs[: len(words) - k] = _mix(runs[: len(words) - k] * _MUL + words[k:])
        out, at = [], 0
        for k in n:
            if k >= N:
                out.append(np.unique(runs[at : at + k - N + 1]))
            elif k:
                h = _END + np.uint64(k)
                for w in words[at : at + k]:
                    h = _mix(h * _MUL + w)
                out.append(np.array([h], np.uint64))
            else:
                out.append(np.empty(0, np.uint64))
            at += k
    return out


def set_key(s: np.ndarray) -> int:
    """64-bit key of a set."""
    with np.errstate(over="ignore"):
        return int(_mix(np.array([_mix(s ^ _END).sum(dtype=np.uint64) + np.uint64(len(s)) * _MUL], np.uint64)).view(np.int64)[0])


def needed(nx, ny):
    """Least intersection of linking sets of these sizes: 100 i >= 75 (nx + ny - i)."""
    return -(-3 * (nx + ny) // 7)


class _Node:
    __slots__ = ("owner", "start", "end", "kids", "docs", "least", "most", "alike")

    def __init__(self, owner, start, end):
        self.owner, self.start, self.end = owner, start, end
        self.kids, self.docs, self.least, self.most, self.alike = {}, [], 1 << 62, 0, True


class Trie:
    """Ordered sets in a path-compressed trie; joins each new set with those before it, and keeps
    the components of what it found."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets, self.root, self.parent = sets, _Node(0, 0, 0), list(range(len(sets)))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def insert(self, i: int) -> None:
        s, node, depth = self.sets[i], self.root, 0
        while True:
            if not node.most:
                node.owner = i
            node.alike = node.alike and self.find(node.owner) == self.find(i)
            node.least, node.most = min(node.least, len(s)), max(node.most, len(s))
            if depth == len(s):
                node.docs.append(i)
                return
            kid = node.kids.get(int(s[depth]))
            if kid is None:
                kid = node.kids[int(s[depth])] = _Node(i, depth, len(s))
                node, depth = kid, len(s)
                continue
            path = self.sets[kid.owner][kid.start : kid.end]
            n = min(len(path), len(s) - depth)
            differ = np.flatnonzero(path[:n] != s[depth : depth + n])
            same = int(differ[0]) if len(differ) else n
            if same < len(path):  # split the edge
                top = _Node(kid.owner, kid.start, kid.start + same)
                top.least, top.most, top.alike = kid.least, kid.most, kid.alike
                kid.start += same
                top.kids[int(self.sets[kid.owner][kid.start])] = kid
                node.kids[int(s[depth])] = kid = top
            node, depth = kid, depth + same

    def join(self, i: int) -> None:
        """Link set i with every set in the trie that reaches the threshold and is in another
        component."""
        s = self.sets[i]
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, at = stack.pop()
            if node.most and node.alike and self.find(node.owner) == self.find(i):
                continue
            if node.end > node.start:
                path = self.sets[node.owner][node.start : node.end]
                where = np.searchsorted(s, path)
                overlap += int((s[np.minimum(where, len(s) - 1)] == path).sum())
                at = int(np.searchsorted(s, path[-1], side="right"))
            if 4 * node.most < 3 * len(s) or 4 * len(s) < 3 * node.least:
                continue
            if overlap + min(len(s) - at, node.most - node.end) < needed(len(s), max(node.least, -(-3 * len(s) // 4))):
                continue
            for j in node.docs:
                if overlap >= needed(len(s), len(self.sets[j])):
                    self.parent[self.find(i)] = self.find(j)
            stack += [(kid, overlap, at) for kid in node.kids.values()]


def block_components(sets: list[np.ndarray], keys: list[int]) -> list[int]:
    """For each set, the least key of its component among these sets."""
    trie = Trie(sets)
    for i in sorted(range(len(sets)), key=lambda i: (len(sets[i]), keys[i])):
        trie.join(i)
        trie.insert(i)
    least: dict[int, int] = {}
    for i, k in enumerate(keys):
        r = trie.find(i)
        least[r] = min(least.get(r, k), k)
    return [least[trie.find(i)] for i in range(len(sets))]


def _counted(batches):
    """Key and size of each document's set; at the end, slices of this task's sketch."""
    common.trim()
    counts = np.zeros(1 << SKETCH_BITS, np.int32)
    for pdf in batches:
        sets = shingle_sets(pdf["text"])
        at, n = np.unique(np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS), return_counts=True) if sets else ((), ())
        counts[np.asarray(at, np.int64)] += np.asarray(n, np.int32)
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "n": [len(s) for s in sets], "key": pd.array([set_key(s) if len(s) else None for s in sets], dtype="Int64"), "slice": -1, "counts": None})
    for i, part in enumerate(np.split(np.minimum(counts, 255).astype(np.uint8), SLICES)):
        yield pd.DataFrame({"doc_id": [None], "n": 0, "key": pd.array([None], dtype="Int64"), "slice": i, "counts": [part.tobytes()]})


def _levels(seen: DataFrame) -> np.ndarray:
    """How common each counter's shingles are: 0 for all near the mean, then powers of two."""

    def summed(pdf):
        total = sum(np.frombuffer(x, np.uint8).astype(np.int32) for x in pdf["counts"])
        return pd.DataFrame({"slice": [int(pdf["slice"].iloc[0])], "counts": [total.tobytes()], "total": [int(total.sum(dtype=np.int64))]})

    sums = common.cut(seen.where("slice >= 0").select("slice", "counts").groupBy("slice").applyInPandas(summed, "slice int, counts binary, total long"), "jj-sketch")
    mean = (sums.agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)

    def levelled(batches):
        for pdf in batches:
            for i, raw in zip(pdf["slice"], pdf["counts"]):
                counts = np.frombuffer(raw, np.int32)
                # Above what chance puts on one counter; the mean is what others put on it.
                high = np.flatnonzero(counts > mean + 5 * mean**0.5 + 8)
                out = np.zeros(len(counts), np.uint8)
                out[high] = np.clip(1 + 2 * np.log2(np.maximum(counts[high] - mean, 1) / 8), 1, 60)
                yield pd.DataFrame({"slice": [i], "levels": [out.tobytes()]})

    # SLICES rows of fixed size, whatever the corpus.
    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    for r in sums.select("slice", "counts").mapInPandas(levelled, "slice int, levels binary").collect():
        out[r["slice"]] = np.frombuffer(r["levels"], np.uint8)
    common.trim()
    return out.ravel()


def ordered(s: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The set's shingles as numbers that sort in the global order."""
    level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return np.sort(level << np.uint64(LEVEL_SHIFT) | s >> np.uint64(HASH_SHIFT))


def _shared(batches):
    """Rows sorted by token, place and key: repeats go, and tokens that only one set has."""
    held, linked = None, False
    for pdf in batches:
        if not len(pdf):
            continue
        rows = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
        t, k = rows["token"].to_numpy(), rows["key"].to_numpy()
        new = np.append(True, (t[1:] != t[:-1]) | (k[1:] != k[:-1]))
        rows, t = rows[new], t[new]
        same = t[1:] == t[:-1]
        keep = np.append(linked, same) | np.append(same, False)
        held, linked = rows.iloc[-1:], bool(same[-1]) if len(same) else linked
        keep[-1] = False
        yield rows[keep]
    if held is not None and linked:
        yield held


def _bloom(keys: DataFrame, column: str) -> tuple[np.ndarray, int]:
    """A bit for the hash of each value, some 16 bits for a value between 2^16 and 2^BLOOM_BITS, so
    that it may be sent everywhere; and the bits as a power of two."""
    bits = min(BLOOM_BITS, max(16, (16 * keys.count()).bit_length()))

    def marked(batches):
        out = np.zeros(1 << bits, bool)
        for pdf in batches:
            out[_bloom_at(pdf[column].to_numpy(), bits)] = True
        yield pd.DataFrame({"bits": [np.packbits(out).tobytes()]})

    rows = keys.select(column).coalesce(8).mapInPandas(marked, "bits binary").collect()
    total = np.zeros(1 << bits >> 3, np.uint8)
    for r in rows:
        total |= np.frombuffer(r["bits"], np.uint8)
    return total, bits


def _bloom_at(values: np.ndarray, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (_mix(values.astype(np.int64).view(np.uint64) * _MUL) >> np.uint64(64 - bits)).astype(np.int64)


def _sized(first: DataFrame, sizes: DataFrame) -> DataFrame:
    """first with the size m of each label. Labels of a thousandth of all rows or more, of which
    there are a thousand at most, are broadcast, and their rows stay where they are."""
    least = max(100, first.count() // 1000)
    hot = F.broadcast(sizes.where(F.col("m") > least))
    rare = first.join(hot.select("label"), "label", "left_anti").join(sizes.where(F.col("m") <= least), "label")
    return first.join(hot, "label").unionByName(rare)


NO_ID = -(1 << 63)


def _sets_of(docs: DataFrame, wanted: DataFrame, levels: np.ndarray) -> DataFrame:
    """(key, owner, set) with all the wanted (key, owner), and some others: only documents whose id
    may be an owner's are read into sets, and only those travel."""
    bloom, bits = _bloom(wanted, "owner")

    def run(batches):
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            at = _bloom_at(ids, bits)
            part = pdf[(bloom[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)]
            sets = shingle_sets(part["text"])
            keep = [i for i, s in enumerate(sets) if len(s)]
            yield pd.DataFrame({"key": [set_key(sets[i]) for i in keep], "owner": part["doc_id"].to_numpy()[keep], "set": [ordered(sets[i], levels).tobytes() for i in keep]})

    return docs.mapInPandas(run, "key long, owner long, set binary")


def _joined(docs: DataFrame, assigned: DataFrame, owners: DataFrame, levels: np.ndarray, name: str) -> DataFrame:
    """Trie joins of blocks. assigned: block, key; returns key, label."""
    assigned = common.cut(assigned, name)
    n = assigned.count()
    if not n:
        return assigned.select("key", F.col("key").alias("label"))
    wanted = common.cut(assigned.select("key").distinct().join(owners, "key"), f"{name}-wanted")
    sets = _sets_of(docs, wanted, levels)
    buckets = max(1, n // 300)

    def run(pdf):
        out = []
        for _, block in pdf.groupby("block"):
            block = block.drop_duplicates("key")
            keys = block["key"].tolist()
            labels = block_components([np.frombuffer(x, np.uint64) for x in block["set"]], keys)
            out.append(pd.DataFrame({"key": keys, "label": labels}))
        return pd.concat(out)

    return common.cut(
        assigned.join(wanted, "key").join(sets, ["key", "owner"]).select("block", "key", "set").withColumn("bucket", F.pmod(F.xxhash64("block"), F.lit(buckets)))
        .groupBy("bucket").applyInPandas(run, "key long, label long").distinct(), f"{name}-labels")


def _parts(members: DataFrame) -> DataFrame:
    """Blocks (block, key) of a bounded size from groups (group, key): each part of a large group
    also has the group's least key."""
    sizes = members.groupBy("group").agg(F.count("*").alias("m"), F.min("key").alias("head")).where("m > 1").withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("long"))
    name = lambda part: F.xxhash64("group", part)
    own = members.join(sizes, "group").select(name(F.pmod(F.xxhash64("key"), F.col("parts"))).alias("block"), "key")
    heads = sizes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(name(F.col("part")).alias("block"), F.col("head").alias("key"))
    return own.unionByName(heads).distinct()


def components(edges: DataFrame, name: str) -> DataFrame:
    """(key, label) with one label for each component of the edges (key, label), for all keys.

    Only labels that share a key are a graph to walk: there, least labels spread along edges and
    jump to their labels' labels until none changes."""
    least = common.cut(edges.groupBy("key").agg(F.min("label").alias("least")), f"{name}-least")
    links = edges.join(least, "key").where("label <> least").select(F.col("label").alias("a"), F.col("least").alias("b")).distinct()
    both = common.cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), f"{name}-links")
    labels = common.cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("key"), "label"), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = (
            both.join(labels.select(F.col("key").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
            .join(labels.select(F.col("key").alias("a"), F.col("label").alias("own")), "a")
            .select(F.col("a").alias("key"), "own", F.least("near", "own").alias("label"))
        )
        jumped = near.join(labels.select(F.col("key").alias("label"), F.col("label").alias("jump")), "label", "left")
        new = common.cut(jumped.select("key", "own", F.least("label", F.coalesce("jump", "label")).alias("label")), f"{name}-{step}")
        if not new.where("own <> label").limit(1).count():
            break
        labels = new.select("key", "label")
    roots = new.select(F.col("key").alias("least"), "label")
    return least.join(roots, "least", "left").select("key", F.coalesce("label", "least").alias("label"))


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs."""
    spark = docs.sparkSession
    common.small_batches(spark, 4)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = common.cut(common.id_text(docs, "doc_id", "text").mapInPandas(_counted, "doc_id string, n int, key long, slice int, counts binary"), "jj-seen")
    info = seen.where("slice < 0").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), "key")
    levels = _levels(seen)
    some = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text")

    def quarters(batches):
        sent: set[int] = set()  # sets of this task, of which copies need not travel
        for pdf in batches:
            if len(sent) > SENT:
                sent.clear()
            sets = {k: s for s in shingle_sets(pdf["text"]) if len(s) and (k := set_key(s)) not in sent}
            sent.update(sets)
            keys, sets = list(sets), list(sets.values())
            for at in range(0, len(sets), 500):
                part = sets[at : at + 500]
                heads = [ordered(s, levels)[: len(s) - -(-3 * len(s) // 4) + 1] for s in part]
                n = [len(h) for h in heads]
                yield pd.DataFrame({"token": np.concatenate(heads).view(np.int64), "key": np.repeat(keys[at : at + 500], n), "place": np.repeat(np.array([len(s) for s in part], np.int64) << 32, n) + np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)})
        common.trim()

    rows = common.cut(
        some.select("text").mapInPandas(quarters, "token long, key long, place long")
        .repartition("token").sortWithinPartitions("token", "place", "key")
        .mapInPandas(_shared, "token long, key long, place long"), "jj-shared"
    ).select("token", "key", F.shiftright("place", 32).alias("n"), F.col("place").bitwiseAND(0xFFFFFFFF).alias("pos"))
    owners = info.where("key is not null").groupBy("key").agg(F.coalesce(F.min("doc_id"), F.lit(NO_ID)).alias("owner"))
    # Sets that share a fair part of their first quarters with others, by two of the shingles.
    counts = common.cut(rows.groupBy("key", "n").agg(F.count("*").alias("c"), F.min("token").alias("t1"), F.min(F.xxhash64("token")).alias("t2")), "jj-counts")
    groups = counts.where("20 * c >= n")
    members = groups.select(F.col("t1").alias("group"), "key").unionByName(groups.select(F.xxhash64("t2").alias("group"), "key"))
    first = components(_joined(some, _parts(members), owners, levels, "jj-first"), "jj-a")
    # What is left: sets and other components that share a shingle.
    w = Window.partitionBy("token")
    sizes = first.groupBy("label").agg(F.count("*").alias("m"))
    known = (
        counts.select("key", F.col("c").alias("s")).join(_sized(first, sizes), "key", "left")
        .select("key", "s", F.coalesce("label", "key").alias("label"), F.coalesce("m", F.lit(1)).alias("m"))
    )
    # One exchange by key and one by token; all that follows up to the join stays where it is.
    mixed = (
        rows.join(known, "key").withColumn("lo", F.min("label").over(w)).withColumn("hi", F.max("label").over(w))
        .where("lo <> hi").drop("lo", "hi")
    )
    groups = mixed.groupBy("token", F.col("label").alias("other")).agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("s").alias("s_y"), F.min("pos").alias("pos_y"), F.first("m").alias("m_y"))
    # The smaller component's sets look for the larger one; sizes of its sets in the group, as far
    # as they can link, bound what must be shared and where it must stand.
    overlap = lambda y: f"(3 * (n + {y}) + 6) div 7"
    ahead = lambda y: f"({overlap(y)} + 1 - (3 * greatest(n, {y}) + 3) div 4)"
    # It rises up to y = n and falls beyond, there with steps back of one: a size between may need one fewer.
    least = f"(least({ahead('lo')}, {ahead('hi')}) - if(hi > greatest(lo, n), 1, 0))"
    wanted = (
        mixed.join(groups, "token").where("label <> other AND (m < m_y OR m = m_y AND label < other)")
        .withColumn("lo", F.expr("greatest(lo, (3 * n + 3) div 4)")).withColumn("hi", F.expr("least(hi, 4 * n div 3)"))
        .where(f"lo <= hi AND least(s, s_y) >= {least} AND pos <= n - {overlap('lo')} AND pos_y <= hi - {overlap('hi')}")
        .select("key", "other", "m_y", F.expr(least).alias("ahead"))
        .groupBy("key", "other", "m_y").agg(F.min("ahead").alias("ahead"))
    )
    wanted = common.cut(wanted, "jj-wanted")
    single = wanted.where("m_y = 1")
    asked = single.select("key").unionByName(single.select(F.col("other").alias("key"))).distinct()
    own = common.cut(rows.join(asked, "key").groupBy("key").agg(F.collect_list("token").alias("tokens")), "jj-own")
    pairs = common.cut(
        single.join(own, "key")
        .join(own.select(F.col("key").alias("other"), F.col("tokens").alias("tokens_y")), "other")
        .where(F.size(F.array_intersect("tokens", "tokens_y")) >= F.col("ahead")).select(F.col("key").alias("key_x"), F.col("other").alias("key_y")), "jj-pairs")
    hubs = pairs.groupBy("key_x").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("parts"))
    one = pairs.join(hubs, "key_x").select(F.xxhash64("key_x", F.pmod(F.xxhash64("key_y"), F.col("parts"))).alias("block"), F.col("key_x").alias("x"), F.col("key_y").alias("key"))
    # A component of many sets meets those that look for it in a grid of parts of both.
    seek = wanted.where("m_y > 1").select(F.col("key").alias("x"), F.col("other").alias("label"))
    grid = seek.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("q")).join(sizes, "label").withColumn("p", F.ceil(F.col("m") / BLOCK).cast("long"))
    name = lambda p, q: F.xxhash64(F.lit("grid"), "label", p, q)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    major = first.join(grid, "label").withColumn("k", every("q")).select(name(F.pmod(F.xxhash64("key"), F.col("p")), F.col("k")).alias("block"), "key")
    minor = seek.join(grid, "label").withColumn("k", every("p")).select(name(F.col("k"), F.pmod(F.xxhash64("x"), F.col("q"))).alias("block"), F.col("x").alias("key"))
    assigned = one.select("block", "key").unionByName(one.select("block", F.col("x").alias("key"))).unionByName(major).unionByName(minor).distinct()
    second = _joined(some, assigned, owners, levels, "jj-second")
    labels = components(first.unionByName(second), "jj-b")
    of = owners.join(labels, "key", "left").select("key", F.coalesce("label", "key").alias("label"), "owner")
    least_id = of.groupBy("label").agg(F.min(F.when(F.col("owner") != NO_ID, F.col("owner"))).alias("component_id"))
    of = of.join(least_id, "label").select("key", "component_id")
    return info.join(of, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
