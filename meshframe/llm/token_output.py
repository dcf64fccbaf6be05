"""Token-ID output: shard files of raw ids, and a minimal perfect hash index over document keys.

Shard file: the ids of its documents one after another (unsigned 16-bit little-endian where the
vocabulary allows, else 32-bit), then one unsigned 32-bit token count for each document, then a
footer of three unsigned 64-bit numbers (documents, tokens, bytes of an id) and 8 magic bytes.

Index: keys are dealt by hash to parts of about PART_KEYS; each part is one file with a minimal
perfect hash (levels of bit arrays with ranks), and for each slot a stored 32-bit fingerprint, the
shard, the offset of the key's first id there, the number of its ids, and the ordinal of its first
document with the number of its documents and of the shards that they go on through. A lookup
hashes the key, tests one bit for each level (about 1.5 of them on average), compares the
fingerprint, and reads the ids at the offset; no other key's ids are read. Only where documents
share a key their counts are read besides, from the ordinal on.

Shards are ranges of the document id and a hash of the text, so that documents that share an id, or
have none, may take any number of shards.

Odd cases: a null text is an empty one, and any document ends with the end id; a null key is a
key like any other and comes first; documents that share a key stay neighbours and are found
together; an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MAGIC = b"MFSHARD1"
PART_KEYS = 1 << 16
#: Bytes of neighbouring documents that are read at once.
READ = 8 << 20
#: Room for a key in a level, in bits, and the salts of the two hashes.
GAMMA = 1.7
#: Segments that a task remembers the ids of, and that it leaves to the next one.
MEMO, CORE = 400_000, 150_000
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class Store:
    """Files in a folder that all executors share: local paths directly, other schemes by Arrow's
    file systems. A file appears whole, by a rename, so that a retried task repeats no harm."""

    def __init__(self, uri: str):
        self.fs = None
        if uri.startswith("file:") or ":" not in uri.split("/")[0]:
            self.root = "/" + uri.removeprefix("file:").lstrip("/")
        else:
            from pyarrow import fs

            self.fs, self.root = fs.FileSystem.from_uri(uri)

    def write(self, name: str, parts: Iterator[bytes]) -> None:
        task = TaskContext.get()
        temp = f"{self.root}/.{name}.{task.taskAttemptId() if task else 0}"
        if self.fs:
            self.fs.create_dir(self.root, recursive=True)
            with self.fs.open_output_stream(temp) as out:
                for p in parts:
                    out.write(p)
            self.fs.move(temp, f"{self.root}/{name}")
        else:
            os.makedirs(self.root, exist_ok=True)
            with open(temp, "wb") as out:
                for p in parts:
                    out.write(p)
            os.replace(temp, f"{self.root}/{name}")

    def read(self, name: str, start: int = 0, length: int | None = None) -> bytes:
        """length bytes from start, or to the end; a negative start counts from the end."""
        opened = self.fs.open_input_file(f"{self.root}/{name}") if self.fs else open(f"{self.root}/{name}", "rb")
        with opened as f:
            f.seek(start, 2 if start < 0 else 0)
            return f.read() if length is None else f.read(length)


def segments(text: str) -> tuple[str, list[str]]:
    """The text cut before single spaces between other characters: the first segment, and the
    others without their space. The tokenizer cuts there as well, so that ids of the segments,
    joined, are the ids of the text."""
    raw = text.split(" ")
    if all(raw) and list(map(str.strip, raw)) == raw:
        return raw[0], raw[1:]
    first, rest = raw[0], []
    for before, piece in zip(raw, raw[1:]):
        if before and piece and not before[-1].isspace() and not piece[0].isspace():
            rest.append(piece)
        elif rest:
            rest[-1] += " " + piece
        else:
            first += " " + piece
    return first, rest


_HEAD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")


def pieces(segment: str) -> tuple[str, ...]:
    """The segment cut after its first letters, where an ASCII character that is none follows, and
    around a line feed between other characters. The tokenizer cuts there as well."""
    m = _HEAD.match(segment)
    if m is None or (k := m.end()) == len(segment) or segment[k] >= "\x80":
        return (segment,)
    head, rest = segment[:k], segment[k:]
    a, feed, b = rest.partition("\n")
    if feed and a and b and not a[-1].isspace() and not b[0].isspace():
        return head, a, feed, b
    return head, rest


class Encoder:
    """Encodes texts with a tokenizer file of the tokenizers library, each distinct segment once.

    Distinct segments are encoded many at a time with a special token between them, at which the
    library cuts before anything else."""

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.memo, self.plain = Tokenizer.from_file(path), {}, {}  # with a space before, and without
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # each word comes once
        self.type = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = self.bytes([end_id])
        special = [(i, t) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)]
        self.mark_id, self.mark = (special[0][0], special[0][1].content) if special else (None, None)

    def bytes(self, ids: list[int]) -> bytes:
        return np.array(ids, self.type).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text on its own."""
        out: list[bytes] = []
        for at in range(0, len(texts), 2000):
            part = texts[at : at + 2000]
            if self.mark is None or any(self.mark in t for t in part):
                out += [self.bytes(e.ids) for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
                continue
            all_ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(part)], add_special_tokens=False)[0].ids)
            cuts, raw, w = np.flatnonzero(all_ids == self.mark_id), all_ids.astype(self.type).tobytes(), self.type.itemsize
            out += [raw[a:b] for a, b in zip([0, *((cuts + 1) * w).tolist()], [*(cuts * w).tolist(), len(raw)])]
        return out

    def forget(self, latest: int = 0) -> None:
        """Drop all but the first CORE segments, common ones that came early, and the latest."""
        for memo in (self.memo, self.plain):
            for s in list(itertools.islice(memo, CORE, max(CORE, len(memo) - latest))):
                del memo[s]

    def learn(self, segments_: list[str]) -> None:
        """Remember the ids of segments that stand after a space."""
        whole, parts = [], {}
        for s in segments_:
            if s.isalpha():
                whole.append(s)
            elif s[-1] in ",.!?" and s.isascii() and (head := s[:-1]).isalpha():  # the common case of pieces()
                parts[s] = head, s[-1]
            elif len(x := pieces(s)) == 1:
                whole.append(s)
            else:
                parts[s] = x
        heads = {x[0] for x in parts.values()}.difference(whole)
        whole += [h for h in heads if h not in self.memo]
        self.memo.update(zip(whole, self.ids([" " + s for s in whole])))
        others = list({p for x in parts.values() for p in x[1:]} - self.plain.keys())
        self.plain.update(zip(others, self.ids(others)))
        for s, x in parts.items():
            self.memo[s] = self.memo[x[0]] + b"".join([self.plain[p] for p in x[1:]])

    def encode(self, texts: pa.StringArray) -> list[bytes]:
        """Ids of each text, and the end id. Arrow cuts the texts at all spaces and finds the
        distinct segments; texts where a space has white space beside it are cut one by one."""
        if max(len(self.memo), len(self.plain)) > MEMO:
            self.forget(MEMO // 3)
        cut = pc.split_pattern(texts, " ")
        offsets = cut.offsets.to_numpy()
        coded = cut.values.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        offsets, codes, distinct = offsets - offsets[0], coded.indices.to_numpy(), coded.dictionary.to_pylist()
        begins, ends = offsets[:-1], offsets[1:]
        stripped = list(map(str.strip, distinct))
        loose = np.array([i for i, (s, x) in enumerate(zip(distinct, stripped)) if not s or s != x], np.int64)
        bad = np.zeros(len(begins), bool)
        if len(loose):
            marks = np.zeros(len(distinct), bool)
            marks[loose] = True
            bad[np.searchsorted(ends, np.flatnonzero(marks[codes]), side="right")] = True
            bad &= ends - begins > 1
        rest = np.ones(len(codes), bool)
        rest[begins] = False
        rest &= ~np.repeat(bad, ends - begins)
        raw: list = [b""] * len(distinct)
        used = np.unique(codes[rest]).tolist()
        for i, x in zip(used, map(self.memo.get, map(distinct.__getitem__, used))):
            raw[i] = x
        new = [i for i in used if raw[i] is None]
        self.learn([distinct[i] for i in new])
        for i in new:
            raw[i] = self.memo[distinct[i]]
        width = self.type.itemsize
        size = np.fromiter(map(len, raw), np.int64, len(raw)) // width
        begin, each = np.cumsum(size) - size, np.where(rest, size[codes], 0)
        done = np.cumsum(each)
        at = np.repeat(begin[codes] - done + each, each)
        at += np.arange(len(at))
        body = np.frombuffer(b"".join(raw), self.type)[at].tobytes()
        last = done[ends - 1] * width
        starts = np.append(0, last[:-1])
        heads = self.ids([distinct[i] for i in codes[begins].tolist()])
        out = [h + body[a:b] + self.end for h, a, b in zip(heads, starts.tolist(), last.tolist())]
        for i in np.flatnonzero(bad).tolist():
            first, more = segments(texts[i].as_py())
            self.learn([s for s in dict.fromkeys(more) if s not in self.memo])
            out[i] = self.ids([first])[0] + b"".join(map(self.memo.__getitem__, more)) + self.end
        return out


_encoders: dict[tuple[str, int], Encoder] = {}


def encoder_of(path: str, end_id: int) -> Encoder:
    """This Python worker's encoder; later tasks find what it remembers."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(33))) * _M2
        return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: a key's slot is the rank of its bit in
    the first level where no other remaining key shares it."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks = np.cumsum([0] + [int(x.sum()) for x in levels])
        self.within = [np.cumsum(x) - x for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], np.asarray(keys, np.uint64)
        while len(left):
            m = max(8, int(GAMMA * len(left)))
            at = (_mix(left, len(levels) + 1) % np.uint64(m)).astype(np.int64)
            alone = np.bincount(at, minlength=m) == 1
            levels.append(alone)
            left = left[~alone[at]]
            if len(levels) > 200:
                raise ValueError("keys of a perfect hash must be distinct")
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for keys that no level holds."""
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, level in enumerate(self.levels):
            at = (_mix(keys[open_], k + 1) % np.uint64(len(level))).astype(np.int64)
            hit = level[at]
            out[open_[hit]] = self.ranks[k] + self.within[k][at[hit]]
            open_ = open_[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(self.levels), *map(len, self.levels)], "<u4")
        return sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash and the number of bytes that it took."""
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        sizes, at, levels = np.frombuffer(raw, "<u4", n, 4), 4 + 4 * n, []
        for m in sizes.tolist():
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, -(-m // 8), at), count=m).astype(bool))
            at += -(-m // 8)
        return cls(levels), at


SLOT = np.dtype([("fingerprint", "<u4"), ("shard", "<u4"), ("shards", "<u4"), ("ordinal", "<u8"), ("rows", "<u8"), ("at", "<u8"), ("tokens", "<u8")])
PLACE = [c for c in SLOT.names if c != "fingerprint"]


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 977) >> np.uint64(32)).astype(np.uint32)


def _key(column: str = "doc_id"):
    return F.xxhash64(column)


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int = 2, shards: int | None = None) -> tuple[DataFrame, int]:
    """Write shard files and index of docs (doc_id, text) into the folder out.

    Returns for each shard (shard, first_token, first_doc, docs, tokens, width), and the number of
    index parts. shards: by default as many as the scan has partitions, so that a shard holds what
    one task reads.
    """
    spark = docs.sparkSession
    common.small_batches(spark, 6)
    docs = docs.select("doc_id", "text")
    shards = shards or max(1, docs.rdd.getNumPartitions())

    def encoded(batches):
        common.trim()
        encoder, store = encoder_of(tokenizer, end_id), Store(out)
        shard, lengths, keys = TaskContext.get().partitionId(), [], []

        def payload():
            for batch in batches:
                if batch.num_rows:
                    ids = encoder.encode(batch.column("text"))
                    lengths.extend(len(x) // encoder.type.itemsize for x in ids)
                    keys.append(batch.column("key").to_numpy())
                    yield b"".join(ids)
            n = np.array(lengths, "<u4")
            yield n.tobytes()
            yield np.array([len(n), n.sum(), encoder.type.itemsize], "<u8").tobytes() + MAGIC

        store.write(f"shard-{shard:06d}.ids", payload())
        encoder.forget()
        common.trim()
        if keys:
            n = np.array(lengths, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.full(len(n), shard, np.int32), np.concatenate(keys), np.arange(len(n)), np.cumsum(n) - n, n)], ["shard", "key", "ordinal", "at", "n"])

    rows = common.cut(
        docs.withColumn("key", _key()).withColumn("text", F.coalesce("text", F.lit("")))
        .repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .drop("doc_id")
        .mapInArrow(encoded, "shard int, key long, ordinal long, at long, n long"), "token-rows")
    #: One row a shard, a bounded number: a shard is as large as a scan partition.
    per_shard = sorted(tuple(r) for r in rows.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("n")).collect())
    first = [np.cumsum([0] + [x[k] for x in per_shard]).tolist() for k in (2, 1)]
    width = encoder_of(tokenizer, end_id).type.itemsize
    manifest = spark.createDataFrame(
        [(s, t, d, docs, n, width) for (s, docs, n), t, d in zip(per_shard, *first)],
        "shard int, first_token long, first_doc long, docs long, tokens long, width int")
    parts = max(1, -(-rows.count() // PART_KEYS))

    def indexed(pdf):
        keys = pdf["key"].to_numpy().view(np.uint64)
        h = PerfectHash.build(keys)
        slots = np.empty(len(keys), SLOT)
        at = h.slots(keys)
        slots["fingerprint"][at] = fingerprints(keys)
        for c in PLACE:
            slots[c][at] = pdf[c]
        part = int(pdf["part"].iloc[0])
        Store(out).write(f"index-{part:08d}.mph", iter([h.dump(), slots.tobytes()]))
        return pd.DataFrame({"part": [part], "keys": [len(keys)]})

    built = (
        rows.groupBy("key").agg(
            F.min(F.struct("shard", "ordinal", "at")).alias("first"), (F.max("shard") - F.min("shard") + 1).alias("shards"), F.count("*").alias("rows"), F.sum("n").alias("tokens"))
        .select("key", "first.*", "shards", "rows", "tokens")
        .withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
        .groupBy("part").applyInPandas(indexed, "part int, keys long")
    )
    built.agg(F.sum("keys")).collect()
    return manifest, parts


def lookup(keys: DataFrame, out: str, parts: int) -> DataFrame:
    """Through the index: doc_id and the slot's shard, shards, ordinal, rows, at, tokens for each
    row of keys (doc_id) whose key the index holds. Other keys give no row, but for one in 2**32."""

    def found(pdf):
        raw = Store(out).read(f"index-{int(pdf['part'].iloc[0]):08d}.mph")
        h, at = PerfectHash.load(raw)
        slots = np.frombuffer(raw, SLOT, offset=at)
        keys = pdf["key"].to_numpy().view(np.uint64)
        slot = h.slots(keys)
        ok = slot >= 0
        ok[ok] = slots["fingerprint"][slot[ok]] == fingerprints(keys[ok])
        got = slots[slot[ok]]
        return pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy()[ok]} | {c: got[c].astype(np.int64) for c in PLACE})

    places = (
        common.id_text(keys, "doc_id", _key().alias("key"))
        .withColumn("part", F.pmod("key", F.lit(parts)).cast("int"))
        .groupBy("part").applyInPandas(found, "doc_id string, " + ", ".join(f"{c} long" for c in PLACE))
    )
    return common.id_back(places, keys, "doc_id")


def read_ids(store: Store, name: str, at: np.ndarray, n: np.ndarray, width: int) -> Iterator[bytes]:
    """The ids of documents that begin at these offsets, ascending, with so many ids; neighbours
    are read together, and nothing else is."""
    k = 0
    while k < len(at):
        end = k + 1
        while end < len(at) and at[end] == at[end - 1] + n[end - 1] and (at[end] + n[end] - at[k]) * width <= READ:
            end += 1
        raw = store.read(name, int(at[k]) * width, int(at[end - 1] + n[end - 1] - at[k]) * width)
        for a, b in zip(((at[k:end] - at[k]) * width).tolist(), (n[k:end] * width).tolist()):
            yield raw[a : a + b]
        k = end


def fetch(places: DataFrame, manifest: DataFrame, out: str) -> DataFrame:
    """Read documents back from the shard files: doc_id, start, n_tokens, ids_crc32 for each
    document at the places that lookup() gave."""

    def read(pdf):
        store, one = Store(out), pdf.iloc[0]
        name, width = f"shard-{int(one['here']):06d}.ids", int(one["width"])
        pdf = pdf.sort_values("at", kind="stable")
        ids, ats, lengths = [], [], []
        for doc_id, at, tokens, ordinal, rows in zip(pdf["doc_id"], pdf["at"], pdf["n"], pdf["first"], pdf["rows"]):
            if rows == 1 and tokens >= 0:
                n = np.array([tokens])
            else:
                n = np.frombuffer(store.read(name, int(one["tokens"]) * width + 4 * int(ordinal), 4 * int(rows)), "<u4").astype(np.int64)
            ids += [doc_id] * len(n)
            ats.append(at + np.cumsum(n) - n)
            lengths.append(n)
        at, n = np.concatenate(ats), np.concatenate(lengths)
        crc = [zlib.crc32(np.frombuffer(x, f"<u{width}").astype("<u4").tobytes()) for x in read_ids(store, name, at, n, width)]
        return pd.DataFrame({"doc_id": ids, "start": at + int(one["first_token"]), "n_tokens": n, "ids_crc32": crc})

    # What of a key's documents a shard holds: all, or of a run through several shards its part.
    shards = F.broadcast(manifest.withColumnRenamed("shard", "here"))
    begins = F.broadcast(manifest.select("shard", F.col("first_doc").alias("run_doc")))
    placed = common.id_text(places, "doc_id", *PLACE).withColumnRenamed("tokens", "n")
    columns = ["doc_id", "here", "first", "rows", "at", "n", "first_token", "tokens", "width"]
    single = placed.where("shards = 1").withColumnRenamed("shard", "here").withColumnRenamed("ordinal", "first").join(shards, "here").select(*columns)
    several = (
        placed.where("shards > 1").join(begins, "shard")
        .withColumn("here", F.expr("explode(sequence(shard, shard + shards - 1))")).join(shards, "here")
        .withColumn("first", F.expr("if(here = shard, ordinal, 0L)"))
        .withColumn("at", F.expr("if(here = shard, at, 0L)"))
        .withColumn("rows", F.expr("least(docs - first, rows - (first_doc + first - run_doc - ordinal))"))
        .withColumn("n", F.lit(-1).cast("long"))  # told by the documents' own counts
        .select(*columns)
    )
    found = single.unionByName(several).where("rows > 0").groupBy("here").applyInPandas(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return common.id_back(found, places, "doc_id")


def encode_and_read_back(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write docs, then read every document back through the index."""
    out = common.fresh(docs.sparkSession, "token-ids")
    manifest, parts = write(docs, out, tokenizer, end_id)
    return fetch(lookup(docs.select("doc_id").distinct(), out, parts), manifest, out)
