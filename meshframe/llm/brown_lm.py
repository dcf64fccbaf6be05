"""Scoring texts with a Brown class-based bigram model.

Tokens are lower-cased words (A-Z only; words end at space, tab, LF, VT, FF, CR) and one end
token for each document. Every word that training has min_count times at least is clustered on its
own, however many there are, and the number of classes grows with the cube root of their number;
only rarer words, unseen ones too, share TAIL elements by their last bytes. Clustering has three
steps:

1. Exchange clustering of a core (words that make up min_share of the training tokens, so
   1 / min_share at most, and the tails) moves elements between CORE classes while the likelihood
   of the class bigrams rises.
2. Each word takes the best core class for its neighbours, and words whose commonest neighbours
   differ as well are told apart: the heaviest of these groups become classes of their own.
3. In distributed rounds each word moves to the class that makes its neighbours in the whole
   corpus likeliest; a round that does not raise the likelihood is not kept.

The model is

    P(word | previous) = P(class | previous class) * P(word | class),

both smoothed: transitions lean on the class's own frequency, emissions are add-one with one more
slot for all unseen words of a class. Counts cover all training documents and the whole
vocabulary; only the core's tables and those of the classes reach the driver.

Shape of the computation: texts become chunks of word numbers, each with its own dictionary of
64-bit word hashes. A word travels once for each chunk that has it, not once for each token; a
window over the hash gives it its corpus count and sends that back to the chunks. Classes go the
same way in each round: a chunk sends the classes beside each of its words to the word's hash,
where they are summed, and the word's new class comes back.

Odd cases: a null or empty text is the end token alone; a null doc_id counts as the empty text
when documents are dealt to training; equal rows are separate documents; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

TAIL = 512
TAIL_BITS = 9
#: A neighbour's slot is sent once for each time, up to so many times.
FEW = 3
#: Classes of the core, and words that one matrix product places.
CORE, WORDS = 48, 2000
FOLDS, HELD_OUT = 7, 2
END = b""


def tail_element(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % TAIL


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def tokens(text: str | None) -> list[bytes]:
    """Words, then the end token. bytes.lower and bytes.split know ASCII alone."""
    out = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    out.append(END)
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from zero on, compressed as planes of bytes, the lowest first."""
    planes = np.asarray(numbers, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(numbers).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, codec="zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).view("<i8").ravel()


def chunks(docs: DataFrame) -> DataFrame:
    """One row for each Arrow batch of documents: their ids, lengths, the distinct words' hashes
    with training counts and tail elements, and the texts as numbers of distinct words."""

    def run(batches):
        common.trim()
        part, k = TaskContext.get().partitionId(), 0
        for pdf in batches:
            if not len(pdf):
                continue
            ids = [None if i is None else int(i) for i in pdf["doc_id"]]
            held = np.array([held_out(i) for i in ids])
            lengths, flat = [], []
            for t in pdf["text"]:
                w = tokens(t)
                lengths.append(len(w))
                flat += w
            flat = np.array(flat, dtype=object)
            codes, distinct = pd.factorize(flat)
            del flat
            # The commonest words get the least numbers.
            rank = np.argsort(-np.bincount(codes), kind="stable")
            distinct, number = distinct[rank], np.empty(len(rank), np.uint32)
            number[rank] = np.arange(len(rank), dtype=np.uint32)
            codes = number[codes]
            train = codes[np.repeat(~held, lengths)]
            hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in distinct], np.uint64)
            tails = np.array([tail_element(w) for w in distinct], np.int64)
            packed = np.bincount(train, minlength=len(distinct)).astype(np.int64) << TAIL_BITS | tails
            del distinct
            yield pd.DataFrame({
                "chunk": [part << 32 | k], "doc_ids": [ids], "lengths": [np.array(lengths, np.int32)], "held": [held],
                "hashes": [hashes.tobytes()], "packed": [pack(packed)], "codes": [pack(codes)], "train_tokens": [len(train)]})
            k += 1

    return common.id_text(docs, "doc_id", "text").mapInPandas(
        run, "chunk long, doc_ids array<long>, lengths array<int>, held array<boolean>, hashes binary, packed binary, codes binary, train_tokens long")


def exchange(bigrams: np.ndarray, classes: int, rounds: int) -> np.ndarray:
    """Class of each element. bigrams: counts of element after element; element 0, the end, keeps
    class 0 to itself. Starts with the commonest elements in classes of their own."""
    n = len(bigrams)
    order = np.argsort(-(bigrams.sum(0) + bigrams.sum(1)), kind="stable")
    order = order[order != 0]
    of = np.zeros(n, np.int64)
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    hot = np.eye(classes)[of]
    after, before = bigrams @ hot, bigrams.T @ hot  # by the class of the next and previous element
    joint = hot.T @ after
    xlogx = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-12)), 0.0)
    for _ in range(rounds):
        moved = 0
        for w in order:
            own, old = bigrams[w, w], of[w]
            nxt, prv = after[w].copy(), before[w].copy()
            nxt[old] -= own
            prv[old] -= own
            base = joint.copy()
            base[old] -= nxt
            base[:, old] -= prv
            base[old, old] -= own
            rows, cols = base.sum(1), base.sum(0)
            out, into = nxt.sum() + own, prv.sum() + own
            logs = xlogx(base)
            gain = (xlogx(base + nxt) - logs).sum(1) + (xlogx(base.T + prv) - logs.T).sum(1)
            both = np.diag(base)
            gain += xlogx(both + nxt + prv + own) - xlogx(both + nxt) - xlogx(both + prv) + xlogx(both)
            gain -= xlogx(rows + out) - xlogx(rows) + xlogx(cols + into) - xlogx(cols)
            gain[0] = -np.inf
            new = int(np.argmax(gain))
            if gain[new] <= gain[old] + 1e-9:
                continue
            base[new] += nxt
            base[:, new] += prv
            base[new, new] += own
            joint = base
            after[:, old] -= bigrams[:, w]
            after[:, new] += bigrams[:, w]
            before[:, old] -= bigrams[w]
            before[:, new] += bigrams[w]
            of[w] = new
            moved += 1
        if not moved:
            break
    return of


def elements_of(hashes, tails, frequent, numbers) -> np.ndarray:
    """Elements of words: 0 the end, 1 to TAIL the tails, then frequent words (sorted hashes)."""
    out = tails + 1
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        hit = frequent[at] == hashes
        out = np.where(hit, numbers[at], out)
    return out


def class_count(n_words: int) -> int:
    """Classes for so many words clustered on their own: the core's, and without bound by the cube root."""
    return CORE + round(2 * n_words ** (1 / 3))


def logs_of(joint: np.ndarray, lean: float) -> np.ndarray:
    """Natural logarithms of the smoothed transitions from class to class."""
    share = (joint.sum(0) + 1) / (joint.sum(0) + 1).sum()
    return np.log((joint + lean * share) / (joint.sum(1, keepdims=True) + lean))


def likelihood(joint: np.ndarray) -> float:
    """Log-likelihood of the class bigrams, but for what no classes change."""
    xlogx = lambda x: float((x[x > 0] * np.log(x[x > 0])).sum())
    return xlogx(joint) - xlogx(joint.sum(0)) - xlogx(joint.sum(1))


def best_class(beside: np.ndarray, joint: np.ndarray, lean: float) -> np.ndarray:
    """The class for each row of beside: counts of the next, then of the previous token's class."""
    k = len(joint)
    logs = logs_of(joint, lean)
    gain = beside @ np.concatenate([logs.T, logs]) - beside[:, :k].sum(1, keepdims=True) * np.log(joint.sum(0) + 1)
    gain[:, 0] = -np.inf  # the end's own
    return gain.argmax(1)


def slot_type(k: int) -> np.dtype:
    return np.dtype("<u2" if 2 * k <= 1 << 16 else "<u4")


def neighbours(state: DataFrame, k: int, classed, min_count: int, end: int) -> DataFrame:
    """(chunk, pos, hash, beside, often) for each chunk and word clustered on its own: slots (the
    next token's class, or k and the previous one's) in the chunk's training texts, one for each
    time in beside, and as pairs of slot and count in often where there are over FEW."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pandas().itertuples():
                hashes, codes = np.frombuffer(r.hashes, np.int64), unpack(r.codes)
                at = classed(hashes, unpack(r.cls))[codes]
                own = np.flatnonzero((unpack(r.c2) >> 1 >= min_count) & (hashes != end))
                rank = np.full(len(hashes), -1)
                rank[own] = np.arange(len(own))
                word = rank[codes]
                took = np.flatnonzero(np.repeat(~r.held, r.lengths) & (word >= 0))
                # Neither end of a text is cut off: a word is followed by the end token at least.
                key = np.concatenate([word[took] * 2 * k + at[np.minimum(took + 1, len(at) - 1)], word[took] * 2 * k + k + np.where(took, at[took - 1], 0)])
                key, n = np.unique(key, return_counts=True)
                few = n <= FEW
                one, both = np.repeat(key[few], n[few]), key[~few]
                kinds = (
                    (one // (2 * k), (one % (2 * k)).astype(slot_type(k))),
                    (both // (2 * k), np.stack([both % (2 * k), n[~few]], 1).astype(np.uint32)))
                for lo in range(0, len(own), 20_000):
                    hi = min(len(own), lo + 20_000)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(hi - lo, r.chunk)), pa.array(own[lo:hi].astype(np.int32)), pa.array(hashes[own[lo:hi]]), *(split_bytes(w, x, lo, hi) for w, x in kinds)],
                        ["chunk", "pos", "hash", "beside", "often"])

    return state.select("chunk", "hashes", "codes", "lengths", "held", "c2", "cls").mapInArrow(run, "chunk long, pos int, hash long, beside binary, often binary")


def split_bytes(word: np.ndarray, rows: np.ndarray, lo: int, hi: int) -> pa.Array:
    """The bytes of the rows of each word from lo to hi; words ascend."""
    at = np.searchsorted(word, np.arange(lo, hi + 1))
    size = rows.itemsize * (rows.shape[1] if rows.ndim == 2 else 1)
    return pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(((at - at[0]) * size).astype(np.int32).tobytes()), pa.py_buffer(rows[at[0] : at[-1]].tobytes())])


def bytes_of(column: pa.Array, a: int, b: int, kind) -> tuple[np.ndarray, np.ndarray]:
    """Numbers in rows a to b of a binary column, and how many each row has."""
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset + a : column.offset + b + 1]
    raw = column.buffers()[2]
    size = np.dtype(kind).itemsize
    return np.frombuffer(raw, kind, (at[-1] - at[0]) // size, at[0]) if at[-1] > at[0] else np.empty(0, kind), np.diff(at) // size


def placed(rows: DataFrame, k: int, place) -> DataFrame:
    """(chunk, at, to): each chunk's positions and what place() makes of the words there from their
    neighbours in all chunks."""

    def out(chunk, pos, to):
        return pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(pos), pa.array(to.astype(np.int32))], ["chunk", "pos", "to"])

    def run(batches):
        last = None  # the word that may go on in the next batch: hash, counts, chunks, positions
        for batch in itertools.chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            h = batch.column("hash").to_numpy() if batch is not None else None
            if last and (batch is None or h[0] != last[0]):
                to = place(last[1][None])
                yield from (out(c, p, np.repeat(to, len(c))) for c, p in last[2])
                last = None
            if batch is None:
                return
            chunk, pos = batch.column("chunk").to_numpy(), batch.column("pos").to_numpy()
            beside, often = (batch.column(c).combine_chunks() if isinstance(batch.column(c), pa.ChunkedArray) else batch.column(c) for c in ("beside", "often"))
            new = np.concatenate([[True], h[1:] != h[:-1]])
            starts = np.append(np.flatnonzero(new), len(h))
            for lo in range(0, len(starts) - 1, WORDS):
                hi = min(len(starts) - 1, lo + WORDS)
                a, b = starts[lo], starts[hi]
                word = np.cumsum(new[a:b]) - 1
                (one, n_one), (both, n_both) = bytes_of(beside, a, b, slot_type(k)), bytes_of(often, a, b, np.uint32)
                counts = np.bincount(np.repeat(word, n_one) * 2 * k + one, minlength=(hi - lo) * 2 * k).astype(float)
                counts += np.bincount(np.repeat(word, n_both // 2) * 2 * k + both[::2], both[1::2], (hi - lo) * 2 * k)
                counts = counts.reshape(hi - lo, 2 * k)
                before = []
                if last:
                    counts[0] += last[1]
                    before, last = last[2], None
                keep = b
                if hi == len(starts) - 1:
                    keep = starts[-2]
                    rest = [(chunk[keep:b], pos[keep:b])]
                    last = (h[keep], counts[-1].copy(), before + rest if hi - lo == 1 else rest)
                    counts = counts[:-1]
                if len(counts):
                    to = place(counts)
                    yield from (out(c, p, np.repeat(to[:1], len(c))) for c, p in before)
                    yield out(chunk[a:keep], pos[a:keep], to[word[: keep - a]])

    return (
        rows.repartition("hash").sortWithinPartitions("hash").mapInArrow(run, "chunk long, pos int, to int")
        .groupBy("chunk").agg(F.collect_list("pos").alias("at"), F.collect_list("to").alias("to")))  # neither has nulls: both in one order


STATE = "chunk long, doc_ids array<long>, lengths array<int>, held array<boolean>, hashes binary, codes binary, c2 binary, cls binary"


def reclassed(state: DataFrame, moves: DataFrame, classed, shift: int, name: str) -> DataFrame:
    """The state with each word's new class; classed(hashes, cls) is what it was."""

    def run(batches):
        for pdf in batches:
            new = []
            for hashes, cls, at, to in zip(pdf["hashes"], pdf["cls"], pdf["at"], pdf["to"]):
                cls = classed(np.frombuffer(hashes, np.int64), unpack(cls))
                if at is not None:
                    cls[at] = to + shift
                new.append(pack(cls))
            yield pdf.assign(cls=new).drop(columns=["at", "to"])

    moves = common.cut(moves, f"{name}-moves")
    common.discard(state.sparkSession)  # the neighbours' shuffle, before the state's own
    out = common.cut(state.join(moves, "chunk", "left").mapInPandas(run, STATE), name)
    common.discard(state.sparkSession, moves)
    return out


def bigrams_of(state: DataFrame, k: int, classed) -> tuple[np.ndarray, np.ndarray]:
    """Training counts of class after class, and the classes' distinct words."""

    def run(batches):
        for pdf in batches:
            for hashes, codes, lengths, held, c2, cls in zip(pdf["hashes"], pdf["codes"], pdf["lengths"], pdf["held"], pdf["c2"], pdf["cls"]):
                cls, c2 = classed(np.frombuffer(hashes, np.int64), unpack(cls)), unpack(c2)
                at = cls[unpack(codes)]
                pair = (np.concatenate([[0], at[:-1]]) * k + at)[np.repeat(~held, lengths)]
                pair, n = np.unique(np.concatenate([pair, k * k + cls[(c2 & 1 == 1) & (c2 > 1)]]), return_counts=True)
                yield pd.DataFrame({"pair": pair, "n": n})

    got = state.select("hashes", "codes", "lengths", "held", "c2", "cls").mapInPandas(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    flat = np.zeros(k * k + k)
    flat[got["pair"].to_numpy(np.int64)] = got["n"]
    return flat[: k * k].reshape(k, k), flat[k * k :]


@dataclass
class Model:
    """Classes of all words, in the state's chunks, and what they count for."""

    state: DataFrame
    classed: Callable
    k: int
    joint: np.ndarray
    class_words: np.ndarray
    n_tokens: int
    lean: float

    def score(self) -> DataFrame:
        classed, n_tokens, class_words = self.classed, self.n_tokens, self.class_words
        class_tokens, n_words = self.joint.sum(0), int(class_words.sum())
        transition = logs_of(self.joint, self.lean) / np.log(10)

        def scored(batches):
            for pdf in batches:
                for r in pdf.itertuples():
                    count, cls = unpack(r.c2) >> 1, classed(np.frombuffer(r.hashes, np.int64), unpack(r.cls))
                    emit = np.log10((count + 1) / (class_tokens + class_words + 1)[cls])
                    base = np.log10((count + 1) / (n_tokens + n_words + 1))
                    codes = unpack(r.codes)
                    at = cls[codes]
                    each = emit[codes] + transition[np.concatenate([[0], at[:-1]]), at]
                    first = np.cumsum(r.lengths) - r.lengths
                    yield pd.DataFrame({
                        "doc_id": pd.array(r.doc_ids, dtype="Int64"), "held_out": r.held, "n_tokens": r.lengths.astype(np.int64),
                        "n_known": np.add.reduceat((count > 0)[codes].astype(np.int64), first), "train_tokens": n_tokens,
                        "base_score": np.add.reduceat(base[codes], first), "score": np.add.reduceat(each, first)})

        return self.state.mapInPandas(
            scored, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def score(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs."""
    return fit(docs, **options).score()


def fit(docs: DataFrame, classes: int | None = None, rounds: int = 4, min_share: float = 5e-4, lean: float = 20.0, min_count: int = 5, moves: int = 1) -> Model:
    """The model of the training documents among docs. classes: as class_count() says where it is
    None."""
    spark = docs.sparkSession
    common.small_batches(spark)
    parts = common.cut(chunks(docs), "lm-chunks")
    n_tokens = parts.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)).alias("n")).first()["n"]

    def entries(batches):
        for pdf in batches:
            for c, h, p in zip(pdf["chunk"], pdf["hashes"], pdf["packed"]):
                h, p = np.frombuffer(h, np.int64), unpack(p)
                pos = np.arange(len(h), dtype=np.int32)
                for at in range(0, len(h), 50_000):
                    yield pd.DataFrame({"chunk": c, "pos": pos[at : at + 50_000], "hash": h[at : at + 50_000], "n": p[at : at + 50_000] >> TAIL_BITS})

    # The count of a word over all chunks, and whether this chunk is the one that speaks for it. A
    # word has one row a chunk: the commonest has one in as many rows as a chunk has words.
    w = Window.partitionBy("hash")
    back = common.cut(
        parts.select("chunk", "hashes", "packed").mapInPandas(entries, "chunk long, pos int, hash long, n long")
        .select("chunk", "pos", (F.sum("n").over(w) * 2 + (F.col("chunk") == F.min("chunk").over(w)).cast("long")).alias("c2"))
        .groupBy("chunk").agg(F.collect_list("pos").alias("at"), F.collect_list("c2").alias("c2")), "lm-counts")
    common.discard(spark)
    end = np.uint64(xxhash.xxh3_64_intdigest(END)).astype(np.int64)
    least = max(1.0, min_share * n_tokens)

    def begun(batches):
        for pdf in batches:
            c2 = []
            for at, found in zip(pdf["at"], pdf["c2"]):
                c2.append(np.empty(len(at), np.int64))
                c2[-1][at] = found
            yield pdf.drop(columns=["packed", "at"]).assign(c2=[pack(c) for c in c2], cls=[pack(unpack(p) & (TAIL - 1)) for p in pdf["packed"]])

    # A word's class is its tail at first.
    state = common.cut(parts.drop("train_tokens").join(back, "chunk").mapInPandas(begun, STATE), "lm-words")
    common.discard(spark, parts, back)

    def summed(batches):
        for pdf in batches:
            for h, c2, tail in zip(pdf["hashes"], pdf["c2"], pdf["cls"]):
                h, c2, tail = np.frombuffer(h, np.int64), unpack(c2), unpack(tail)
                own, n = (c2 & 1) == 1, c2 >> 1
                alone = own & (n >= least) & (h != end)
                rest = own & (n > 0) & (n < least) & (h != end)
                by = np.bincount(tail[rest], minlength=TAIL)
                yield pd.DataFrame({"hash": h[alone], "element": -1, "words": 1})
                yield pd.DataFrame({"hash": [0], "element": [-2], "words": [int((own & (n >= min_count) & (h != end)).sum())]})
                yield pd.DataFrame({"hash": 0, "element": 1 + np.arange(TAIL), "words": by}).query("words > 0")

    stats = state.select("hashes", "c2", "cls").mapInPandas(summed, "hash long, element int, words long").groupBy("hash", "element").agg(F.sum("words").alias("words")).toPandas()
    alone = stats[stats["element"] == -1].sort_values("hash")
    frequent = np.concatenate([alone["hash"].to_numpy(np.int64), [end]])
    numbers = np.concatenate([1 + TAIL + np.arange(len(alone)), [0]]).astype(np.int64)
    by_hash = np.argsort(frequent)
    frequent, numbers = frequent[by_hash], numbers[by_hash]
    n_elements = 1 + TAIL + len(alone)

    def pairs(batches):
        for pdf in batches:
            for h, tail, codes, lengths, held in zip(pdf["hashes"], pdf["cls"], pdf["codes"], pdf["lengths"], pdf["held"]):
                at = elements_of(np.frombuffer(h, np.int64), unpack(tail), frequent, numbers)[unpack(codes)]
                key = (np.concatenate([[0], at[:-1]]) * n_elements + at)[np.repeat(~held, lengths)]
                key, n = np.unique(key, return_counts=True)
                yield pd.DataFrame({"pair": key, "n": n})

    # A document's first token follows the end token, as the token before it in the chunk is one.
    counted = state.select("hashes", "cls", "codes", "lengths", "held").mapInPandas(pairs, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    bigrams = np.zeros(n_elements * n_elements)
    bigrams[counted["pair"].to_numpy(np.int64)] = counted["n"]
    bigrams = bigrams.reshape(n_elements, n_elements)
    k = classes or class_count(int(stats.loc[stats["element"] == -2, "words"].sum()))
    core = min(CORE, k)
    of = exchange(bigrams, core, rounds)
    hot = np.eye(core)[of]
    joint = hot.T @ bigrams @ hot

    def in_core(hashes, tail):
        return of[elements_of(hashes, tail, frequent, numbers)]

    # Groups of words by their core class and their commonest neighbours' ones, the heaviest first.
    def grouped(beside):
        return (best_class(beside, joint, lean) * core + beside[:, :core].argmax(1)) * core + beside[:, core:].argmax(1)

    first = state
    state = reclassed(first, placed(neighbours(first, core, in_core, min_count, end), core, grouped), in_core, core, "lm-groups")
    common.discard(spark, first)

    def weighed(batches):
        for pdf in batches:
            for codes, lengths, held, cls in zip(pdf["codes"], pdf["lengths"], pdf["held"], pdf["cls"]):
                group, n = np.unique(unpack(cls)[unpack(codes)[np.repeat(~held, lengths)]], return_counts=True)
                yield pd.DataFrame({"group": group, "n": n})

    weights = state.select("codes", "lengths", "held", "cls").mapInPandas(weighed, "group int, n long").groupBy("group").agg(F.sum("n").alias("n")).toPandas()
    weights = weights[weights["group"] >= core].sort_values(["n", "group"], ascending=[False, True])["group"].to_numpy(np.int64)[: k - core]
    lut = np.concatenate([np.arange(core), np.arange(core**3) // core**2])
    lut[weights] = core + np.arange(len(weights))
    classed = lambda _, cls: lut[cls]
    k = core + len(weights)
    joint, class_words = bigrams_of(state, k, classed)
    for step in range(moves):
        was = joint
        after = reclassed(state, placed(neighbours(state, k, classed, min_count, end), k, lambda beside: best_class(beside, was, lean)), classed, 0, f"lm-moved-{step}")  # noqa: B023
        found = bigrams_of(after, k, lambda _, cls: cls)
        if likelihood(found[0]) <= likelihood(joint):
            common.discard(spark, after)
            break
        common.discard(spark, state)
        state, classed, (joint, class_words) = after, lambda _, cls: cls, found
    return Model(state, classed, k, joint, class_words, n_tokens, lean)
