"""Benchmark decontamination by spaced seeds.

Texts become words (lower case, without punctuation at their ends). Fixed masks over a few
neighbouring words pick positions to hash and ignore the others, so that a substituted word spoils
few seeds. Seeds of texts and of benchmark items meet in a join by hash; around each hit the words
are compared along its diagonal, and the best-scoring overlap (a match counts 1, a substitution
-SUBSTITUTION; of equals the first and longest) is a leak if LEAST of its words agree. Of an item
of up to SHORT words LEAST, or LEAST_SHARE of its words, have to agree wherever they stand. Of the
diagonals of a text and an item the one where most words agree counts, the first of equals.

What is found: any overlap with eight neighbouring words alike, and nearly any other. Items
of up to SHORT words have masks of their own lengths, each without one or two groups of positions,
such that one of them fits whenever as many words agree as have to: these are found for certain. Items of fewer than FLOOR words tell nothing about a text and are left out.

Shape of the plan: one pass over the texts for any benchmark. A bitmap of the benchmark's seeds,
of BITS bits at most, lets pass what may meet a seed; what passes is joined to the table of seeds,
each key in SALT parts, as a passage may be in any share of all texts. Hits name the texts, by
hashes of their id and content, that a second pass joins to their items and compares.

Odd cases: null and empty texts, and items without words, give no hits; equal rows give equal
hits; null ids are carried along; an empty table on either side gives no hits; other columns are
untouched, whatever their names.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: 1: the word counts; 0: it is ignored.
MASKS = ("11101101", "110100110101", "1011011001011", "1111000111")
SUBSTITUTION = 2
#: Words that must agree, or this share of an item that has fewer; words of an item that counts.
LEAST, LEAST_SHARE, FLOOR = 12, 0.8, 5
#: Items up to this length have masks of their own: longer ones may miss more words than two.
SHORT = 14
#: Bits of the bitmap: so many for a seed, within these powers of two.
BITS_EACH, BITS = 256, (16, 29)
SALT = 8
_MUL = np.uint64(0x9E3779B97F4A7C15)


def needed(n: int) -> int:
    """Words that must agree with an item of n words."""
    return min(LEAST, math.ceil(LEAST_SHARE * n - 1e-9))


def masks_of(n: int) -> tuple[str, ...]:
    """Masks that an item of n words is seeded by. For a short item positions are dealt into
    groups, and a mask leaves out as many of them as words may differ."""
    if n < FLOOR:
        return ()
    if n > SHORT:
        return MASKS
    missing = n - needed(n)
    groups = {1: 3, 2: 4}[missing]
    return tuple("".join("0" if i % groups in out else "1" for i in range(n)).strip("0") for out in itertools.combinations(range(groups), missing))


def _mix(x):
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _plain(word: bytes) -> str:
    text = word.decode("utf-8", "surrogatepass").lower()
    a, b = 0, len(text)
    while a < b and not text[a].isalnum():
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return text[a:b]


def word_hashes(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, one after another, and the number of each text's words.
    Words without a letter or digit don't count."""
    flat, n = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").split() if t else []
        flat += w
        n.append(len(w))
    n = np.array(n, np.int64)
    if not flat:
        return np.empty(0, np.uint64), n
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    plain = [_plain(w) for w in distinct]
    hashes = np.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) for p in plain], np.uint64)
    real = np.array([bool(p) for p in plain])[codes]
    text = np.repeat(np.arange(len(n)), n)[real]
    return hashes[codes][real], np.bincount(text, minlength=len(n))


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """A hash for each start of the mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.full(n, len(mask) * 1009 + int(mask, 2), np.uint64)
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                h = _mix(h * _MUL + words[i : i + n])
    return h


def seeded(flat: np.ndarray, n: np.ndarray, masks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, text numbers and first words of all seeds of the texts that flat and n describe."""
    ends = np.cumsum(n)
    hashes, texts, firsts = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for m in masks:
        h = seeds(flat, m)
        at = np.arange(len(h))
        text = np.searchsorted(ends, at, side="right")
        inside = at + len(m) <= ends[text] if len(h) else np.empty(0, bool)
        hashes.append(h[inside])
        texts.append(text[inside])
        firsts.append((at - (ends - n)[text])[inside] if len(h) else at)
    return np.concatenate(hashes), np.concatenate(texts), np.concatenate(firsts)


def overlap(words: np.ndarray, item: np.ndarray, first: int):
    """(start, end, agreeing words) of the best overlap with an item whose first word stands at
    first; None if too little agrees."""
    a, b = max(0, first), min(len(words), first + len(item))
    same = words[a:b] == item[a - first : b - first]
    if len(item) <= SHORT:
        at = np.flatnonzero(same)
        return (a + int(at[0]), a + int(at[-1]) + 1, len(at)) if len(at) >= needed(len(item)) else None
    run = np.cumsum(np.where(same, 1, -SUBSTITUTION))
    low = np.minimum.accumulate(np.append(0, run[:-1]))
    end = int(np.argmax(run - low))
    start = int(np.argmin(np.append(0, run)[: end + 1]))
    agree = int(same[start : end + 1].sum())
    return (a + start, a + end + 1, agree) if agree >= needed(len(item)) else None


def best_overlap(words: np.ndarray, item: np.ndarray, firsts):
    """The best overlap over diagonals."""
    found = [x for x in (overlap(words, item, f) for f in sorted(firsts)) if x]
    return max(found, key=lambda x: x[2], default=None)


def benchmark_tables(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Items (item, item_id, words), their seeds (hash, item, item_first), and the masks in use."""

    def worded(batches):
        for pdf in batches:
            flat, n = word_hashes(pdf["text"])
            ends = np.cumsum(n)
            ok = n >= FLOOR
            raw = [flat[e - k : e].tobytes() for e, k in zip(ends, n)]
            yield pd.DataFrame({"item": pdf["item"], "item_id": pdf["item_id"], "words": raw, "n": n})[ok]

    rows = benchmark.where("text is not null").select(F.col("item_id").cast("string").alias("item_id"), "text", F.monotonically_increasing_id().alias("item"))
    items = common.cut(rows.mapInPandas(worded, "item long, item_id string, words binary, n int"), "leak-items")
    # At most SHORT + 1 rows.
    lengths = [r["n"] for r in items.select(F.least("n", F.lit(SHORT + 1)).alias("n")).distinct().collect()]
    masks = sorted({m for n in lengths for m in masks_of(n)})

    def run(batches):
        for pdf in batches:
            for item, raw, n in zip(pdf["item"], pdf["words"], pdf["n"]):
                h, _, first = seeded(np.frombuffer(raw, np.uint64), np.array([n]), masks_of(n))
                yield pd.DataFrame({"hash": h.view(np.int64), "item": item, "item_first": first})

    return items.drop("n"), common.cut(items.mapInPandas(run, "hash long, item long, item_first int"), "leak-seeds"), masks


def bitmap_of(found: DataFrame) -> tuple[np.ndarray, int]:
    """A bit for each hash's first so many bits, eight to a byte."""
    bits = max(BITS[0], min(BITS[1], math.ceil(math.log2(BITS_EACH * found.count() + 1))))
    page = 15

    def run(pdf):
        own = np.zeros(1 << page, bool)
        own[pdf["bit"].to_numpy() & ((1 << page) - 1)] = True
        return pd.DataFrame({"page": [int(pdf["bit"].iloc[0]) >> page], "raw": [np.packbits(own, bitorder="little").tobytes()]})

    pages = (
        found.select(F.shiftrightunsigned("hash", 64 - bits).alias("bit")).distinct()
        .groupBy(F.shiftright("bit", page)).applyInPandas(run, "page long, raw binary")
    )
    out = np.zeros((1 << bits) // 8, np.uint8)
    for r in pages.collect():  # as many bytes together as the bitmap has at most
        at = r["page"] << (page - 3)
        out[at : at + (1 << (page - 3))] = np.frombuffer(r["raw"], np.uint8)
    return out, bits


def _keys(df: DataFrame, *others) -> tuple[list, list[str]]:
    """Hashes of a row's id and text, which stand for it, under names that no column has."""
    names = [common.unused(df, "leak_key_a"), common.unused(df, "leak_key_b")]
    return [F.xxhash64("doc_id", "text").alias(names[0]), F.xxhash64(F.lit(1), "text").alias(names[1])], names


def suspects(docs: DataFrame, benchmark: DataFrame, names: list[str], keys: list, column: str) -> DataFrame:
    """The keys of texts that share a seed with items, and those as an array of (item_id, words,
    firsts): the diagonals of their hits."""
    items, found, masks = benchmark_tables(benchmark)
    bitmap, bits = bitmap_of(found)
    shift = np.uint64(64 - bits)

    def run(batches):
        for batch in batches:
            flat, n = word_hashes(batch.column("text").to_pylist())
            a, b = (batch.column(c).to_numpy() for c in ("a", "b"))
            for m in masks:
                h, text, first = seeded(flat, n, (m,))
                bit = (h >> shift).astype(np.int64)
                here = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                if len(here):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(h[here].view(np.int64)), pa.array(a[text[here]]), pa.array(b[text[here]]), pa.array(first[here].astype(np.int32))], ["hash", "a", "b", "first"])
        common.trim()

    hits = docs.where("text is not null").select("text", keys[0].alias("a"), keys[1].alias("b")).mapInArrow(run, "hash long, a long, b long, first int")
    salted = found.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return (
        hits.withColumn("salt", F.pmod("a", F.lit(SALT)).cast("int")).join(salted, ["hash", "salt"])
        .groupBy("a", "b", "item").agg(F.collect_set(F.col("first") - F.col("item_first")).alias("firsts"))
        .join(items, "item")
        .groupBy(F.col("a").alias(names[0]), F.col("b").alias(names[1]))
        .agg(F.collect_list(F.struct("item_id", "words", "firsts")).alias(column))
    )


def _compared(text: str, items) -> list[tuple]:
    words, _ = word_hashes([text])
    found = []
    for x in items:
        item = np.frombuffer(x["words"], np.uint64)
        best = best_overlap(words, item, x["firsts"])
        if best:
            found.append((x["item_id"], *best, len(item)))
    return found


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start and end (words of the text), n_match, n_item for each text and item
    that overlap."""
    common.small_batches(docs.sparkSession, 4)
    docs = docs.select("doc_id", "text")
    keys, names = _keys(docs)
    who = suspects(docs, benchmark, names, keys, "items")

    def run(batches):
        for pdf in batches:
            rows = [(i, *x) for i, t, items in zip(pdf["doc_id"], pdf["text"], pdf["items"]) for x in _compared(t, items)]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "n_match", "n_item"])

    both = docs.where("text is not null").withColumns(dict(zip(names, keys))).join(who.hint("merge"), names)
    found = common.id_text(both, "doc_id", "text", "items").mapInPandas(run, "doc_id string, item_id string, start long, end long, n_match long, n_item long")
    return common.id_back(common.id_back(found, docs, "doc_id"), benchmark, "item_id")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any overlap; all columns as they are."""
    common.small_batches(docs.sparkSession, 4)
    keys, names = _keys(docs)
    column, columns = common.unused(docs, "leak_items"), docs.columns
    who = suspects(docs, benchmark, names, keys, column)

    def run(batches):
        for batch in batches:
            items = batch.column(column)
            keep = np.ones(batch.num_rows, bool)
            for i in np.flatnonzero(items.is_valid().to_numpy(zero_copy_only=False)):
                keep[i] = not _compared(batch.column("text")[i].as_py(), items[i].as_py())
            yield batch.select(columns).filter(pa.array(keep))
        common.trim()

    both = docs.withColumns(dict(zip(names, keys))).join(who.hint("merge"), names, "left").drop(*names)
    return both.mapInArrow(run, docs.schema)
