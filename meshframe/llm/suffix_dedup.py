"""Exact removal of repeated substrings by sorted suffixes.

A byte goes if it lies in a WINDOW-byte string that also starts anywhere else. A sparse suffix
array decides that, over suffixes that start at anchors: the anchor of a window is its least
GRAM-byte hash, the leftmost on ties, so that equal windows have their anchors at equal offsets
and only suffixes whose first GRAM bytes agree need to meet.

1. Anchors of all texts, each with the windows it speaks for and a hash of all their bytes,
   meet by the hash of the anchor's gram. Equal bytes: all those windows are repeated.
2. Of other anchors that share a gram, the bytes meet: suffixes to the right of the anchors, and
   reversed prefixes to the left, are put in order by deep-shallow sorting (multikey quicksort
   over 8-byte characters down to SHALLOW bytes, blind tries for the groups that still agree).
   Neighbours' common prefixes then tell how far each two anchors agree to either side, and which
   windows they share.
3. Grams with more than GROUP distinct surroundings don't meet in one task; the hashes of their
   windows (128 bits) are counted instead, which is as exact and splits by window.

Texts are keyed by a 64-bit hash; a text that occurs twice goes as a whole without being sorted.

Odd cases: a null text is an empty one; texts under WINDOW bytes keep all their bytes; a null
doc_id is allowed; equal rows are copies of each other; an empty table gives no rows; further
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

WINDOW, GRAM = 200, 64
SPAN = WINDOW - GRAM + 1  # grams in a window
#: Surroundings of a gram that one task puts in order, and those that are compared pair by pair.
GROUP, PAIRS = 20_000, 48
SHALLOW = 32
CTX = (WINDOW + SPAN - 1 + 7) // 8 * 8
_TABLE = np.random.default_rng(20240601).integers(0, 2**64, 256, np.uint64, endpoint=False)
_MUL = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def _join(a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """Hash of two neighbouring strings from their hashes."""
    h = a * _MUL[seed]
    h += b
    h ^= h >> np.uint64(29)
    return h


def _doubled(data: np.ndarray, upto: int, seed: int = 0) -> dict[int, np.ndarray]:
    """Hashes of all substrings of 8, GRAM and 2 * GRAM bytes."""
    h, n, out = _TABLE[data] + np.uint64(seed), 1, {}
    while n < upto and len(h) > n:
        h = _join(h[:-n], h[n:], seed)
        n *= 2
        if n in (8, 64, 128):
            out[n] = h
    return out


def _least(h: np.ndarray) -> np.ndarray:
    """For each start, the position of the leftmost least hash among the next SPAN."""
    value, at, n = h, np.arange(len(h), dtype=np.int32), 1
    while n < SPAN:
        step = min(n, SPAN - n)
        less = value[step:] < value[:-step]
        value = np.where(less, value[step:], value[:-step])
        at = np.where(less, at[step:], at[:-step])
        n += step
    return at


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Text number, gram hash, hash of the surroundings and packed place of every anchor.

    A place holds the anchor's position, how far before it its first window starts, and how many
    windows follow that one.
    """
    lengths = np.array([len(t) for t in texts], np.int64)
    keep = np.flatnonzero(lengths >= WINDOW)
    none = np.empty(0, np.int64)
    if not len(keep):
        return none, none.view(np.uint64), none.view(np.uint64), none
    data = np.frombuffer(b"".join(texts[i] for i in keep), np.uint8)
    lengths = lengths[keep]
    ends = np.cumsum(lengths)
    begins = ends - lengths
    hashes = _doubled(data, 128)
    at = _least(hashes[64])
    # Windows that stay in one text.
    valid = np.ones(len(at), bool)
    for e in ends[:-1]:
        valid[e - WINDOW + 1 : e] = False
    starts = np.flatnonzero(valid)
    at = at[starts]
    text = np.searchsorted(ends, starts, side="right")
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a, lo, hi, text = at[first].astype(np.int64), starts[first], starts[last], text[first]
    wide, end = hashes[128], hi + WINDOW
    around = _join(_join(wide[lo], wide[(lo + end - 128) // 2]), _join(wide[end - 128], ((end - lo) << 10 | (a - lo)).astype(np.uint64)))
    return keep[text], hashes[64][a], around, (a - begins[text]) << 20 | (a - lo) << 10 | (hi - lo)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and last window."""
    a, back, n = place >> 20, place >> 10 & 1023, place & 1023
    return a, a - back, a - back + n


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of strings by a blind trie: inner nodes hold only the position at which their
    children differ and those children's bytes; a string is compared once, with a leaf below."""
    root: list | int = 0
    for i, s in enumerate(strings[1:], 1):
        node, path = root, []
        while not isinstance(node, int):
            path.append(node)
            node = node[1].get(s[node[0]] if node[0] < len(s) else -1) if (s[node[0]] if node[0] < len(s) else -1) in node[1] else next(iter(node[1].values()))
        other = strings[node]
        n, depth = min(len(s), len(other)), 0
        step = n
        while step:  # the length of the common prefix
            if s[depth : depth + step] == other[depth : depth + step]:
                depth += step
                step = min(step, n - depth)
            else:
                step //= 2
        mine, theirs = (x[depth] if depth < len(x) else -1 for x in (s, other))
        parent = None
        for node in path:
            if node[0] >= depth:
                break
            parent = node
        if mine == theirs:  # equal strings: a leaf's list
            node = parent[1][s[parent[0]] if parent[0] < len(s) else -1] if parent else root
            target = node if not isinstance(node, int) and node[0] == depth else None
            if target is None:
                target = [depth, {theirs: node}]
            target[1][(-2 - i)] = i
            node = target
        else:
            node = parent[1][s[parent[0]] if parent[0] < len(s) else -1] if parent else root
            if not isinstance(node, int) and node[0] == depth:
                node[1][mine] = i
                continue
            node = [depth, {theirs: node, mine: i}]
        if parent:
            parent[1][s[parent[0]] if parent[0] < len(s) else -1] = node
        else:
            root = node
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(node)
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow(group: np.ndarray, data: np.ndarray, lengths: np.ndarray, skip: int = 0) -> np.ndarray:
    """Order of zero-padded strings (rows of data) by group, then bytes, which agree up to skip.

    Shallow: all segments that still agree are split by their next eight bytes at once. Deep: what
    agrees beyond SHALLOW bytes goes to a blind trie for each segment.
    """
    chars = data.view(">u8")
    order = np.argsort(group, kind="stable")
    segment = np.cumsum(np.append(0, group[order][1:] != group[order][:-1])) if len(order) else order
    for c in range(skip // 8, (skip + SHALLOW) // 8):
        size = np.bincount(segment)
        live = np.flatnonzero(size[segment] > 1)
        if not len(live):
            return order
        key = chars[order[live], c]
        by = np.lexsort((key, segment[live]))
        order[live] = order[live[by]]
        split = np.zeros(len(order), bool)
        split[1:] = segment[1:] != segment[:-1]
        k, s = key[by], segment[live]
        split[live[1:]] |= (k[1:] != k[:-1]) & (s[1:] == s[:-1])
        segment = np.cumsum(split)
    edge = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    for a, b in zip(edge, np.append(edge[1:], len(order))):
        if b - a > 1:
            own = order[a:b]
            order[a:b] = own[blind_trie([data[i, : lengths[i]].tobytes() for i in own])]
    return order


def common_prefixes(data: np.ndarray, lengths: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each string and the one before it in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 20_000):
        x, y = order[at : at + 20_000], order[at - 1 : at - 1 + len(order[at : at + 20_000])]
        differ = data[x] != data[y]
        n = np.where(differ.any(1), differ.argmax(1), data.shape[1])
        out[at : at + len(x)] = np.minimum(n, np.minimum(lengths[x], lengths[y]))
    return out


def _between(prefix: np.ndarray) -> np.ndarray:
    """Common prefixes of all pairs, from those of neighbours in sorted order."""
    m = len(prefix)
    out = np.zeros((m, m), np.int64)
    for i in range(m - 1):
        out[i, i + 1 :] = np.minimum.accumulate(prefix[i + 1 :])
    return out + out.T


def _by_offset(items, rank, fore_common, back_common, a, lo, hi):
    """Shared windows of one group, offset by offset: windows that start d bytes before their
    anchors are equal if the anchors' suffixes agree in WINDOW - d bytes and the prefixes in d,
    and either order tells which do. items in right order, rank: their places in left order."""
    back, least = (a - lo)[items], (a - hi)[items]
    out = np.zeros((int(back.max()) + 2, len(items)), bool)
    for d in range(int(least.min()), int(back.max()) + 1):
        live = np.flatnonzero((least <= d) & (d <= back))
        right = np.cumsum(fore_common < WINDOW - d)[live]
        left = np.cumsum(back_common < d)[rank[live]]
        _, which, n = np.unique(right * (len(items) + 1) + left, return_inverse=True, return_counts=True)
        out[d, live] = n[which] > 1
    edge = np.diff(out.astype(np.int8), axis=0, prepend=0)
    i, first = np.nonzero(edge.T == 1)
    _, last = np.nonzero(edge.T == -1)  # runs of offsets first to last - 1, in the same order
    at = a[items[i]]
    return items[i], at - last + 1, at - first + WINDOW


def shared_windows(group: np.ndarray, place: np.ndarray, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Item numbers and byte ranges [start, end) that windows shared within a group cover. raw: the
    bytes from an item's first window to its last one's end."""
    a, lo, hi = unpack(place)
    back, fore = a - lo, hi + WINDOW - a
    right, left = np.zeros((len(raw), CTX), np.uint8), np.zeros((len(raw), CTX), np.uint8)
    for i, (r, b) in enumerate(zip(raw, back)):
        x = np.frombuffer(r, np.uint8)
        right[i, : len(x) - b] = x[b:]
        left[i, :b] = x[:b][::-1]
    by_right = deep_shallow(group, right, fore, GRAM)
    by_left = deep_shallow(group, left, back)
    fore_common, back_common = common_prefixes(right, fore, by_right), common_prefixes(left, back, by_left)
    found: list[tuple] = []
    ordered = group[by_right]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    sizes = np.diff(np.append(first, len(ordered)))
    two = first[sizes == 2]
    both = np.concatenate([by_right[two], by_right[two + 1]])
    reach, depth = np.tile(fore_common[two + 1], 2), np.tile(back_common[two + 1], 2)
    # Windows d bytes before the anchor with d <= depth and WINDOW - d <= reach.
    least, most = np.maximum(WINDOW - reach, back[both] - (hi - lo)[both]), np.minimum(depth, back[both])
    ok = least <= most
    found.append((both[ok], (a[both] - most)[ok], (a[both] - least)[ok] + WINDOW))
    rank = np.empty(len(group), np.int64)
    for f, m in zip(first[sizes > 2], sizes[sizes > 2]):
        items, others = by_right[f : f + m], by_left[f : f + m]
        rank[others] = np.arange(m)
        if m > PAIRS:
            found.append(_by_offset(items, rank[items], fore_common[f : f + m], back_common[f : f + m], a, lo, hi))
            continue
        reach = _between(fore_common[f : f + m])
        depth = _between(back_common[f : f + m])
        depth = depth[np.ix_(rank[items], rank[items])]
        least = np.maximum(WINDOW - reach, (back - (hi - lo))[items][:, None])
        most = np.minimum(depth, back[items][:, None])
        ok = least <= most
        np.fill_diagonal(ok, False)
        i, j = np.nonzero(ok)
        ranges = np.unique(np.stack([items[i], a[items[i]] - most[i, j], a[items[i]] - least[i, j] + WINDOW]), axis=1)
        found.append(tuple(ranges))
    return tuple(np.concatenate(x) for x in zip(*found))


def merged(ranges: list) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def cut_out(raw: bytes, ranges: list) -> tuple[bytes, list[tuple[int, int]]]:
    """What remains of the bytes without the ranges, and the removed runs."""
    runs, at, kept = merged(ranges), 0, []
    for a, b in runs:
        kept.append(raw[at:a])
        at = b
    return b"".join(kept) + raw[at:], runs


def _local(i, gram, around, place, keys):
    """One anchor for each distinct surroundings among these texts, and the ranges of windows that
    occur twice among them already. Hot texts and periodic ones shrink to little before they
    meet others."""
    order = np.lexsort((around, gram))
    g, r = gram[order], around[order]
    new = np.append(True, (g[1:] != g[:-1]) | (r[1:] != r[:-1]))[: len(g)]
    group = np.cumsum(new) - 1
    again = np.zeros(len(g), bool)
    again[order] = np.bincount(group)[group] > 1 if len(g) else False
    rep = order[new]
    _, lo, hi = unpack(place)
    lo, end, of = lo[again], hi[again] + WINDOW, i[again]
    # Anchors of a text come in the order of their windows.
    start = np.append(True, (of[1:] != of[:-1]) | (lo[1:] > end[:-1]))[: len(of)]
    first = np.flatnonzero(start)
    stop = np.append(first[1:], len(of))[: len(first)] - 1
    spread = _join((keys[of[first]].view(np.uint64)), lo[first].astype(np.uint64)).view(np.int64)
    return pd.concat([
        pd.DataFrame({"gram": gram[rep].view(np.int64), "around": around[rep].view(np.int64), "key": keys[i[rep]], "place": place[rep], "local": False}),
        pd.DataFrame({"gram": spread, "around": lo[first], "key": keys[of[first]], "place": end[stop], "local": True})])


def _find_anchors(batches):
    def emit(texts, keys):
        return _local(*anchors(texts), np.array(keys, np.int64))

    for pdf in batches:
        texts, keys, size = [], [], 0
        for t, k in zip(pdf["text"], pdf["key"]):
            texts.append(t.encode("utf-8", "surrogatepass") if t else b"")
            keys.append(k)
            size += len(texts[-1])
            if size > 1 << 20:
                yield emit(texts, keys)
                texts, keys, size = [], [], 0
        if texts:
            yield emit(texts, keys)


def _meet(batches):
    """Over rows sorted by gram, around, key and place: ranges of windows that are repeated as
    they stand (item false), and the distinct anchors that share a gram alone (item true)."""
    held = None
    before = False  # whether the held row's run of equal surroundings has another before it

    def settle(rows, more):
        nonlocal held, before
        g, r, k, p = (rows[c].to_numpy() for c in ("gram", "around", "key", "place"))
        same_gram = g[1:] == g[:-1]
        same = same_gram & (r[1:] == r[:-1])
        copy = same & (k[1:] == k[:-1]) & (p[1:] == p[:-1])
        n = len(rows) - (1 if more else 0)
        prev = np.append(before[1] if before else False, same)
        prev_copy = np.append(before[2] if before else False, copy)
        nxt, nxt_gram, nxt_copy = (np.append(x, False) for x in (same, same_gram, copy))
        # Another run of surroundings before this one: true from its first row on.
        start = ~prev
        other = np.append(before[0] if before else False, same_gram & ~same)
        run_at = np.maximum.accumulate(np.where(start, np.arange(len(rows)), -1))
        has_before = np.where(run_at >= 0, other[np.maximum(run_at, 0)], before[0] if before else False)
        repeated = prev | nxt
        whole = repeated & ~(prev_copy | nxt_copy)
        item = ~nxt & (has_before | nxt_gram)
        a, lo, hi = unpack(p)
        out = [
            pd.DataFrame({"item": False, "key": k, "gram": lo, "place": hi + WINDOW})[whole & (np.arange(len(rows)) < n)],
            pd.DataFrame({"item": True, "key": k, "gram": g, "place": p})[item & (np.arange(len(rows)) < n)],
        ]
        if more:
            held, before = rows.iloc[-1:], (bool(has_before[-1]), bool(prev[-1]), bool(prev_copy[-1]))
        return pd.concat(out)

    for pdf in batches:
        known = pdf[pdf["local"]]
        yield pd.DataFrame({"item": False, "key": known["key"], "gram": known["around"], "place": known["place"]})
        pdf = pdf[~pdf["local"]].drop(columns="local")
        if len(pdf):
            yield settle(pdf if held is None else pd.concat([held, pdf], ignore_index=True), True)
    if held is not None:
        yield settle(held, False)


def _surroundings(batches):
    """The bytes of each item of a text."""
    for pdf in batches:
        for t, k, items in zip(pdf["text"], pdf["key"], pdf["items"]):
            if items is None or not len(items):
                continue
            raw = t.encode("utf-8", "surrogatepass")
            gram, place, large = (np.array([x[c] for x in items]) for c in ("gram", "place", "large"))
            _, lo, hi = unpack(place)
            yield pd.DataFrame({"gram": gram, "key": k, "place": place, "large": large, "raw": [raw[x : y + WINDOW] for x, y in zip(lo, hi)]})


def _sorted_ranges(pdf):
    i, start, end = shared_windows(pdf["gram"].to_numpy(), pdf["place"].to_numpy(), pdf["raw"].tolist())
    return pd.DataFrame({"key": pdf["key"].to_numpy()[i], "start": start, "end": end})


def _window_hashes(batches):
    """128-bit hashes of every window of the items of large groups."""
    for pdf in batches:
        for at in range(0, len(pdf), 2000):
            part = pdf.iloc[at : at + 2000]
            data = np.frombuffer(b"".join(part["raw"]), np.uint8)
            _, lo, hi = unpack(part["place"].to_numpy())
            n = hi - lo + 1
            begin = np.cumsum(n + WINDOW - 1) - (n + WINDOW - 1)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            s = np.repeat(begin, n) + offset
            h = []
            for seed in (0, 1):
                d = _doubled(data, 128, seed)
                h.append(_join(_join(d[128][s], d[64][s + 128], seed), d[8][s + 192], seed).view(np.int64))
            yield pd.DataFrame({"h1": h[0], "h2": h[1], "key": np.repeat(part["key"].to_numpy(), n), "start": np.repeat(lo, n) + offset})


def _finish(batches):
    for pdf in batches:
        out = []
        for k, t, fixed, found in zip(pdf["key"], pdf["text"], pdf["ranges"], pdf["found"]):
            ranges = [(r["start"], r["end"]) for x in (fixed, found) if x is not None for r in x]
            kept, runs = cut_out(t.encode("utf-8", "surrogatepass"), ranges)
            out.append((k, sum(b - a for a, b in runs), [{"start": a, "end": b} for a, b in runs], hashlib.sha256(kept).hexdigest()))
        yield pd.DataFrame(out, columns=["key", "n_removed", "removed", "kept_sha256"])


def dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, removed (runs of bytes [start, end)), kept_sha256 for each row."""
    spark = docs.sparkSession
    common.small_batches(spark)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("text"))
    rows = common.cut(texts.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "sd-rows")
    owners = rows.groupBy("key").agg(F.min("doc_id").alias("owner"), F.count("*").alias("copies"))
    met = common.cut(
        texts.select("text", "key").where(F.octet_length("text") >= WINDOW)
        .mapInPandas(_find_anchors, "gram long, around long, key long, place long, local boolean")
        .repartition("gram").sortWithinPartitions("gram", "around", "key", "place")
        .mapInPandas(_meet, "item boolean, key long, gram long, place long"), "sd-met")
    # Whether too many surroundings share a gram for one task; counts by gram alone.
    crowded = met.where("item").groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select("gram", F.lit(True).alias("large"))
    items = met.where("item").join(crowded, "gram", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    by_text = (
        met.where(~F.col("item")).select("key", F.struct(F.col("gram").alias("start"), F.col("place").alias("end")).alias("r"), F.lit(None).cast("struct<gram:long,place:long,large:boolean>").alias("i"))
        .unionByName(items.select("key", F.lit(None).cast("struct<start:long,end:long>").alias("r"), F.struct("gram", "place", "large").alias("i")))
        .groupBy("key").agg(F.collect_list("r").alias("ranges"), F.collect_list("i").alias("items"))
        .join(owners, "key")
    )
    null_id = F.lit(-(1 << 63))
    flagged = common.cut(
        texts.withColumn("owner", F.coalesce(F.col("doc_id").cast("long"), null_id)).drop("doc_id")
        .join(by_text.withColumn("owner", F.coalesce(F.col("owner").cast("long"), null_id)), ["key", "owner"])
        .select("key", "text", "ranges", "items"), "sd-flagged")
    around = flagged.select("text", "key", "items").mapInPandas(_surroundings, "gram long, key long, place long, large boolean, raw binary")
    n_items = met.where("item").count()
    buckets = max(1, n_items // 8000)
    in_order = (
        around.where(~F.col("large")).select("gram", "key", "place", "raw", F.pmod("gram", F.lit(buckets)).alias("bucket"))
        .groupBy("bucket").applyInPandas(_sorted_ranges, "key long, start long, end long")
    )
    same = Window.partitionBy("h1", "h2")
    counted = (
        around.where("large").select("key", "place", "raw").mapInPandas(_window_hashes, "h1 long, h2 long, key long, start long")
        .withColumn("n", F.count("*").over(same)).where("n > 1")
        .select("key", "start", (F.col("start") + WINDOW).alias("end"))
    )
    found = in_order.unionByName(counted).groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("found"))
    run = "array<struct<start:long,end:long>>"
    decided = flagged.select("key", "text", "ranges").join(found, "key", "left").mapInPandas(_finish, f"key long, n_removed long, removed {run}, kept_sha256 string")
    result = rows.join(owners.select("key", "copies"), "key").join(decided.dropDuplicates(["key"]), "key", "left")
    copied = (F.col("copies") > 1) & (F.col("n_bytes") >= WINDOW)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return result.select(
        "doc_id", "n_bytes",
        F.when(copied, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, whole).otherwise(F.coalesce("removed", F.array().cast(run))).alias("removed"),
        F.when(copied, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"))
