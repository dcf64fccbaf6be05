"""Quality by importance resampling.

Two bag-of-n-grams models over hashed buckets, one of the target text (rows labelled good) and
one of the raw corpus, give each document a log importance weight, the sum over its n-grams of
log p_target - log p_raw. Gumbel top-k keeps k documents: those with the largest weight plus
Gumbel noise, which samples without replacement in proportion to the weights. k is the number of
documents whose weight clears a cut that is fitted to labelled rows.

At most max_labels labelled rows, those with the least hashes of their ids, fit target model and
cut; the raw model counts every document.

Odd cases: null and empty texts weigh 0; null labels and labels of unknown documents don't count;
of several labels of one document the least counts; without labels of both kinds all documents
are kept; equal rows get equal keys and fates; an empty table gives no rows; other columns are
untouched.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
#: Words, or runs of other characters.
_PARTS = re.compile(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)


def grams(texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of the texts, and the text number of each."""
    flat, n = [], []
    for t in texts:
        w = t.encode("utf-8", "surrogatepass").lower().split() if t else []
        flat += w
        n.append(len(w))
    if not flat:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    codes, distinct = pd.factorize(np.array(flat, dtype=object))
    parts = [_PARTS.findall(w) for w in distinct]
    hashes = np.array([xxhash.xxh3_64_intdigest(p) for x in parts for p in x], np.uint64)
    size = np.array([len(x) for x in parts])
    first = np.cumsum(size) - size
    each = size[codes]
    at = np.repeat(first[codes], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    tokens = hashes[at]
    text = np.repeat(np.repeat(np.arange(len(n)), n), each)
    with np.errstate(over="ignore"):
        two = (tokens[:-1] * _MUL + (tokens[1:] ^ (tokens[1:] >> np.uint64(31)))) * _MUL
    same = text[1:] == text[:-1]
    buckets = np.concatenate([tokens, two[same]]) >> np.uint64(50)
    return buckets.astype(np.int64), np.concatenate([text, text[1:][same]])


class Model:
    """Log ratios by bucket, and the cut that good documents clear."""

    def __init__(self, target: np.ndarray, raw: np.ndarray):
        p, q = target + 1.0, raw + 1.0
        self.ratio = np.log(p / p.sum()) - np.log(q / q.sum())
        self.cut = -np.inf

    def weights(self, texts) -> np.ndarray:
        buckets, text = grams(texts)
        return np.bincount(text, self.ratio[buckets], minlength=len(texts))


def best_cut(weights: np.ndarray, good: np.ndarray) -> float:
    """The cut with the fewest errors, where a lost good row counts as much as five kept bad ones;
    in the middle of the gap there."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    # errors[i]: rows i and on are kept.
    errors = 5 * np.append(0, np.cumsum(g)) + np.append(np.cumsum(~g[::-1])[::-1], 0)
    i = int(np.argmin(errors))
    if i == 0:
        return -np.inf
    return float((w[i - 1] + w[i]) / 2) if i < len(w) else float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 50_000) -> Model:
    common.small_batches(docs.sparkSession, 3)
    marked = (
        labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good_"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id", "left").select("text", "good_")

    def counted(batches):
        common.trim()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for pdf in batches:
            buckets, text = grams(pdf["text"])
            raw += np.bincount(buckets, minlength=BUCKETS)
            target += np.bincount(buckets[(pdf["good_"] == 1).to_numpy()[text]], minlength=BUCKETS)
        yield pd.DataFrame({"raw": [raw.tobytes()], "target": [target.tobytes()], "slot": [0]})

    def summed(pdf):
        add = lambda c: sum(np.frombuffer(x, np.int64) for x in pdf[c]).tobytes()
        return pd.DataFrame({"raw": [add("raw")], "target": [add("target")], "slot": [0]})

    # One row of fixed size from each task.
    total = rows.mapInPandas(counted, "raw binary, target binary, slot int").groupBy("slot").applyInPandas(summed, "raw binary, target binary, slot int").collect()
    read = lambda c: np.frombuffer(total[0][c], np.int64) if total else np.zeros(BUCKETS, np.int64)
    model = Model(read("target"), read("raw"))

    def weighed(batches):
        for pdf in batches:
            yield pd.DataFrame({"w": model.weights(pdf["text"]), "good": (pdf["good_"] == 1).to_numpy()})

    known = rows.where("good_ is not null").mapInPandas(weighed, "w double, good boolean").toPandas()
    if known["good"].any() and not known["good"].all():
        model.cut = best_cut(known["w"].to_numpy(), known["good"].to_numpy(bool))
    return model


def _noise(docs: DataFrame, seed: int):
    """Gumbel noise that the id and the text decide."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def scores(docs: DataFrame, model: Model, seed: int = 17) -> DataFrame:
    """doc_id, log_weight and key (weight plus noise) of each row."""

    def run(batches):
        for pdf in batches:
            w = model.weights(pdf["text"])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "log_weight": w, "key": w + pdf["noise"]})

    found = common.id_text(docs, "doc_id", "text", _noise(docs, seed).alias("noise")).mapInPandas(run, "doc_id string, log_weight double, key double")
    return common.id_back(found, docs, "doc_id")


def kth_largest(rows: DataFrame, column: str, k: int, few: int = 20_000) -> float:
    """The k-th largest value, by histograms that narrow until few values are left."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    n = rows.count()
    while n > few and hi > lo:
        step = (hi - lo) / 1000
        if lo + step == lo:
            break
        bin_ = F.least(F.floor((F.col(column) - lo) / step), F.lit(999))
        counts = {r["b"]: r["c"] for r in rows.where(F.col(column).between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count("*").alias("c")).collect()}
        for b in sorted(counts, reverse=True):
            if counts[b] >= k:
                break
            k -= counts[b]
        inside = rows.where(F.col(column).between(lo, hi) & (bin_ == b)).agg(F.min(column), F.max(column), F.count("*")).first()
        if (inside[0], inside[1]) == (lo, hi):
            break
        lo, hi, n = inside
    if n > few:
        return lo
    left = sorted((r[0] for r in rows.where(F.col(column).between(lo, hi)).select(column).collect()), reverse=True)
    return left[k - 1]


def least_key(scored: DataFrame, model: Model) -> float:
    """The key from which on documents are kept."""
    k = scored.where(F.col("log_weight") >= model.cut).count() if np.isfinite(model.cut) else 0
    return kth_largest(scored, "key", k) if k else -np.inf


def resample(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, log_weight, key, kept of each row."""
    model = fit(docs, labels)
    scored = common.cut(scores(docs, model, seed), "quality-scores")
    return scored.withColumn("kept", F.col("key") >= F.lit(least_key(scored, model)))


def kept_documents(docs: DataFrame, labels: DataFrame, seed: int = 17) -> DataFrame:
    """The rows that the resampling keeps; all columns as they are."""
    model = fit(docs, labels)
    least = least_key(common.cut(scores(docs, model, seed), "quality-scores"), model)
    if least == -np.inf:
        return docs
    noise = common.unused(docs, "noise")

    def run(batches):
        for batch in batches:
            w = model.weights(batch.column("text").to_pylist())
            keep = w + batch.column(noise).to_numpy() >= least
            yield batch.drop_columns([noise]).filter(pa.array(keep))
        common.trim()

    return docs.withColumn(noise, _noise(docs, seed)).mapInArrow(run, docs.schema)
