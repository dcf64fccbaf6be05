"""Document operators against brute force, and on odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from meshframe.llm import brown_lm, common, decontaminate, jaccard, mixing, quality, queries, secret_scan, stages, suffix_dedup, token_output

from .conftest import EDGES, SMALL


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def words(t):
    return (t or "").encode().lower().split()


# Near duplicates


def components_by_force(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)})
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i), d)) for i, (d, _) in enumerate(rows)), key=str)


def edited(r, base, n):
    w = list(base)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(10**6)}"
    return " ".join(w)


def test_jaccard_join(documents, monkeypatch):
    r = random.Random(4)
    base = [f"b{r.randrange(500)}" for _ in range(120)]
    rows = [(i, edited(r, base, r.choice((0, 1, 2, 3, 4, 6, 9)))) for i in range(60)]
    rows += [(100 + i, " ".join(f"b{r.randrange(500)}" for _ in range(r.randrange(1, 40)))) for i in range(30)]
    rows += [(200 + i, " ".join(base[:50] + [f"z{i}x{k}" for k in range(25)])) for i in range(10)]
    for block in (400, 5):  # also where blocks are split
        monkeypatch.setattr(jaccard, "BLOCK", block)
        got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(documents(rows)).collect()), key=str)
        assert got == components_by_force(rows)


def test_jaccard_links_sizes_between_the_ends(documents):
    # x links y alone, whose component has sizes 10 to 12; 11 demands fewer common shingles than both.
    rows = []
    for k in range(0, 400, 4):
        w = [f"w{k}x{i}" for i in range(1, 14)]
        rows += [(k + i, " ".join(t)) for i, t in enumerate((w + ["a"], w + ["b", "c"], w + ["b", "c", "d"], w[1:] + ["b", "c"]))]
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(documents(rows)).collect()), key=str)
    assert got == components_by_force(rows)


def test_jaccard_on_table_and_odd_rows(table, documents):
    rows = texts_of(table("documents"))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(table("documents")).collect()), key=str)
    assert got == components_by_force(rows)
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.join(documents(EDGES)).collect()), key=str)
    assert got == components_by_force(EDGES)
    assert jaccard.join(documents(EDGES).limit(0)).count() == 0


def test_trie_joins_what_force_joins():
    r = random.Random(1)
    sets = [np.array(sorted(r.sample(range(60), r.randrange(1, 30))), np.uint64) for _ in range(80)]
    sets += [np.array(sorted(set(sets[0].tolist()) | {100 + k}), np.uint64) for k in range(5)]
    got = jaccard.block_components(sets, list(range(len(sets))))
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(set(a.tolist()) & set(b.tolist()))
            if 100 * both >= 75 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    assert got == [find(i) for i in range(len(sets))]


# Repeated substrings


def dedup_by_force(rows, width=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(b[p : p + width] for b in raw for p in range(len(b) - width + 1))
    out = []
    for (d, _), b in zip(rows, raw):
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if seen[b[p : p + width]] > 1:
                gone[p : p + width] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def dedup_rows(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.removed), r.kept_sha256) for r in suffix_dedup.dedup(df).collect()), key=str)


@pytest.mark.parametrize("group,pairs", [(20_000, 48), (20_000, 2), (1, 48)])
def test_dedup(documents, monkeypatch, group, pairs):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup, "PAIRS", pairs)
    r = random.Random(2)
    filler = lambda n: "".join(r.choice("abcdefgh é") for _ in range(n))
    passage = filler(330)
    rows = [(i, filler(r.randrange(0, 150)) + passage[r.randrange(60) : 330 - r.randrange(60)] + filler(r.randrange(150))) for i in range(25)]
    rows += [(50, "ab" * 400), (51, "ab" * 120), (52, passage + passage), (53, passage[:199]), (54, filler(500)), (55, rows[0][1]), (56, "x" * 200), (57, "x" * 200)]
    # GROUP is read on the driver alone, PAIRS in the workers' own copy of the module.
    assert dedup_rows(documents(rows)) == dedup_by_force(rows)


def test_dedup_on_odd_rows(documents):
    rows = [x if x[1] is None or len(x[1]) < 10_000 else (x[0], x[1][:3000]) for x in EDGES]
    assert dedup_rows(documents(rows)) == dedup_by_force(rows)
    assert suffix_dedup.dedup(documents(EDGES).limit(0)).count() == 0


def test_deep_shallow_sorts():
    r = random.Random(3)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 90))) for _ in range(300)]
    strings += [b"a" * 80 + s[:8] for s in strings] + [b"a" * 60] * 4
    data = np.zeros((len(strings), 96), np.uint8)
    for i, s in enumerate(strings):
        data[i, : len(s)] = np.frombuffer(s, np.uint8)
    lengths = np.array([len(s) for s in strings])
    group = np.array([r.randrange(4) for _ in strings])
    order = suffix_dedup.deep_shallow(group, data, lengths)
    assert [(group[i], strings[i]) for i in order] == sorted(zip(group.tolist(), strings))
    shared = suffix_dedup.common_prefixes(data, lengths, order)
    for k in range(1, len(order)):
        a, b = strings[order[k - 1]], strings[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert shared[k] == n


# Secrets


def test_secret_patterns(documents):
    rows = EDGES + [(20, 'é api_key = "abcDEF123" token: x Token:"longer_value"'), (21, "AKIA" + "A" * 16 + " AKIA123 " + "0" * 24 + "g" + "a" * 23), (22, "key 9fKq2LzT7vXw4RbN8mYc1HsJ5pGd3Ea end")]
    found = {r.doc_id: r for r in secret_scan.scan(documents(rows)).collect()}
    assert len(secret_scan.scan(documents(rows)).collect()) == len(rows)
    spans = lambda i: [(s.kind, s.start, s.end) for s in found[i].base]
    text = dict(rows)
    assert [text[20][a:b] for _, a, b in spans(20)] == ['api_key = "abcDEF123', 'Token:"longer_value']
    assert [(k, text[21][a:b]) for k, a, b in spans(21)] == [("access", "AKIA" + "A" * 16), ("hex", "0" * 24)]
    assert [s.kind for s in found[22].spans] == ["random"]
    assert found[6].spans == [] and found[1].spans == []


def test_base_matches_plain_regex(table):
    for _, t in texts_of(table("documents")):
        base, every = secret_scan.spans(t)
        want = [("assign", *m.span()) for m in secret_scan.ASSIGN.finditer(t) if len(m[2]) >= 6]
        want += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert base == sorted(want, key=lambda s: (s[1], secret_scan.KINDS.index(s[0])))
        assert set(base) <= set(every)


def test_secrets_inside_runs():
    # After a name and =, joined to a name by what its encoding lacks, and beside a pattern's span.
    r = random.Random(8)
    s = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40))
    b64, url = s[:20] + "+" + s[20:30] + "/" + s[30:], s[:20] + "_" + s[20:30] + "-" + s[30:]
    for before, secret, after in (("aws_credential=", s, ""), ("AUTH=", s, "=="), ("my_key-", b64, ""), ("my_key_", b64, "="), ("path/", url, ""), ("AKIA" + "A" * 16 + "-", s, ""), ("0" * 24 + "/", s, "")):
        every = secret_scan.spans(f"see {before}{secret}{after} end")[1]
        found = [(a, b) for k, a, b in every if k == "random"]
        assert len(found) == 1 and found[0][1] == 4 + len(before + secret + after) and abs(found[0][0] - 4 - len(before)) <= 1, (before, every)
    assert not any(k == "random" for k, _, _ in secret_scan.spans("see some/path_to/a-long/file_name=with/another-long/file_name end")[1])


def test_battery_tells_random_from_words():
    r = random.Random(5)
    random_strings = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(40)) for _ in range(100)]
    names = ["getElementsByClassNameAndAttribute", "international-cooperation-agreement", "thisisaverylongwordwithoutanyspaces", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "ABABABABABABABABABABABABABABABAB", "some/path/to/a/file/with/long/name", "2024-01-01-2024-01-02-2024-01-03"]
    assert sum(secret_scan.discoveries(random_strings)) >= 95
    assert not any(secret_scan.discoveries(names))


# Language model


def test_language_model(table, documents):
    rows = texts_of(table("documents"))
    counts = collections.Counter()
    tokens = lambda t: words(t) + [b""]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    for i, t in rows:
        if not held(i):
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = {r.doc_id: r for r in brown_lm.score(table("documents"), classes=12).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.train_tokens) == (held(i), len(tokens(t)), n)
        assert r.n_known == sum(counts[w] > 0 for w in tokens(t))
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)))
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    odd = brown_lm.score(documents(EDGES), classes=4).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in odd) == sorted((str(i), len(tokens(t))) for i, t in EDGES)
    assert all(math.isfinite(r.score) and r.score < 0 for r in odd)
    assert brown_lm.score(documents(EDGES).limit(0)).count() == 0


def test_language_model_score_by_force(documents):
    """The score from the classes that the model gave the words, token by token; chances of all that
    may follow sum to one at most."""
    r = random.Random(11)
    rows = [(i, " ".join(f"w{min(r.randrange(60), r.randrange(60))}" for _ in range(r.randrange(1, 30)))) for i in range(200)] + [(900, None), (901, "never seen words")]
    model = brown_lm.fit(documents(rows), classes=9)
    cls, count = {}, {}
    for row in model.state.collect():
        known = np.frombuffer(row.hashes, np.int64)
        for h, c, n in zip(known.tolist(), model.classed(known, brown_lm.unpack(row.cls)).tolist(), (brown_lm.unpack(row.c2) >> 1).tolist()):
            assert cls.setdefault(h, c) == c and count.setdefault(h, n) == n
    number = lambda w: int(np.uint64(xxhash.xxh3_64_intdigest(w)).astype(np.int64))
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    k = model.k
    pair, of_class, kinds = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    for i, t in rows:
        if not held(i):
            last = 0
            for w in words(t) + [b""]:
                c = cls[number(w)]
                pair[last, c] += 1
                of_class[c] += 1
                last = c
    for h, n in count.items():
        kinds[cls[h]] += n > 0
    share = (pair.sum(0) + 1) / (pair.sum(0) + 1).sum()
    step = (pair + 20 * share) / (pair.sum(1, keepdims=True) + 20)
    assert np.allclose(step.sum(1), 1)
    for c in range(k):  # the class's words, and one slot for all that it has not seen
        assert sum((n + 1) / (of_class[c] + kinds[c] + 1) for h, n in count.items() if n and cls[h] == c) + 1 / (of_class[c] + kinds[c] + 1) <= 1 + 1e-9
    got = {x.doc_id: x.score for x in model.score().collect()}
    for i, t in rows:
        last, want = 0, 0.0
        for w in words(t) + [b""]:
            c = cls[number(w)]
            want += math.log10(step[last, c] * (count[number(w)] + 1) / (of_class[c] + kinds[c] + 1))
            last = c
        assert got[i] == pytest.approx(want)


def test_language_model_grows(documents):
    # Two kinds of words that no frequent word is among and whose last bytes are the same.
    r = random.Random(3)
    pairs = [(f"w{i}xx", f"w{3000 + j}xx") for _ in range(10) for i, j in zip(range(3000), r.sample(range(3000), 3000))]
    rows = [(i, " ".join(f"the {a} of {b}" for a, b in pairs[i * 100 : i * 100 + 100])) for i in range(300)]
    got = brown_lm.score(documents(rows)).collect()
    assert sum(r.score for r in got) / sum(r.n_tokens for r in got) > -1.85  # -2.04 where they share a class
    assert [brown_lm.class_count(n) for n in (0, 10**6, 10**9, 10**12)] == [brown_lm.CORE + n for n in (0, 200, 2000, 20000)]


def test_exchange_raises_the_likelihood():
    # Three kinds of elements that follow each other in turn.
    r = np.random.default_rng(0)
    kind = np.append(-1, r.integers(0, 3, 60))
    n = r.poisson(0.2, (61, 61)) + r.poisson(20, (61, 61)) * (kind[:, None] % 3 == (kind[None, :] - 1) % 3)
    n[0, 1:] = n[1:, 0] = 1
    n[0, 0] = 0

    def value(of):
        hot = np.eye(4)[of]
        joint = hot.T @ n @ hot
        log = lambda x: np.where(x > 0, x * np.log(np.maximum(x, 1e-9)), 0).sum()
        return log(joint) - log(joint.sum(0)) - log(joint.sum(1))

    start, end = brown_lm.exchange(n.astype(float), 4, 0), brown_lm.exchange(n.astype(float), 4, 10)
    assert end[0] == 0 and (end[1:] > 0).all() and value(end) > value(start)
    for k in range(3):
        assert np.bincount(end[1:][kind[1:] == k]).max() >= 0.8 * (kind == k).sum()


# Decontamination


def plain_words(t):
    out = [w.decode("utf-8", "surrogatepass") for w in words(t)]
    out = [re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in out]
    return [w for w in out if w]


def overlaps_by_force(rows, items):
    """Every text against every item along every diagonal, word by word."""
    out = []
    for i, t in rows:
        text = plain_words(t)
        for j, u in items:
            item = plain_words(u)
            need = min(12, math.ceil(0.8 * len(item) - 1e-9))
            best = None
            for first in range(1 - len(item), len(text)) if len(item) >= 5 else ():
                place = range(max(0, first), min(len(text), first + len(item)))
                same = [k for k in place if text[k] == item[k - first]]
                stretch = (same[0], same[-1] + 1, len(same)) if same else (0, 0, 0)
                if len(item) > 14:  # the stretch with the highest score
                    top, score, agree, begin = 0, -1, 0, 0
                    for k in place:
                        if score < 0:
                            begin, agree, score = k, 0, 0
                        score, agree = (score + 1, agree + 1) if text[k] == item[k - first] else (score - 2, agree)
                        if score > top:
                            top, stretch = score, (begin, k + 1, agree)
                if stretch[2] >= need and (best is None or stretch[2] > best[2]):
                    best = stretch
            if best:
                out.append((i, j, *best, len(item)))
    return sorted(out, key=str)


def overlap_rows(df, bench):
    return sorted(((x.doc_id, x.item_id, x.start, x.end, x.n_match, x.n_item) for x in decontaminate.hits(df, bench).collect()), key=str)


def test_decontamination(spark, documents):
    r = random.Random(6)
    item = [f"q{r.randrange(10**6)}" for _ in range(30)]
    one_off = item[:14] + ["other"] + item[15:]
    filler = lambda n: [f"f{r.randrange(10**6)}" for _ in range(n)]
    items = [(1, " ".join(item)), (2, None), (3, ""), (4, "three little words"), (None, " ".join(filler(20))), (5, "yes"), (6, " ".join(item))]
    rows = EDGES + [(30, " ".join(filler(9) + item + filler(9))), (31, " ".join(filler(9) + one_off + filler(2))), (32, " ".join(filler(50))), (33, " ".join(item[:6] + filler(30))), (34, "So: three LITTLE words! and yes it is so"), (35, " ".join(w.upper() + "," for w in item[5:25])), (36, " ".join(item + filler(5) + item[:20]))]
    rows += [(37, rows[-1][1])] * 2
    lengths = []
    for n in range(4, 16):  # an item of each short length, with each set of as many other words as it may miss
        own = [f"s{n}x{k}" for k in range(n)]
        items.append((100 + n, " ".join(own)))
        for out in [(k,) for k in range(n)] + ([(j, k) for k in range(n) for j in range(k)] if n >= 10 else []):
            lengths.append((1000 * n + len(lengths), " ".join(filler(3) + ["other" if k in out else w for k, w in enumerate(own)] + filler(2))))
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows += lengths
    want = overlaps_by_force([x for x in rows if x[0] not in (6, 7)], items)
    short = [x for x in want if x[1] is None or not 100 <= x[1] or x[5] <= decontaminate.SHORT]
    got = overlap_rows(documents(rows), bench)
    assert set(got) <= set(want) and set(short) <= set(got) and len(got) > 0.9 * len(want)
    kept = decontaminate.clean(documents(rows), bench)
    assert kept.columns == documents(rows).columns
    leaked = {x[0] for x in got}
    assert sorted(str(x.doc_id) for x in kept.collect()) == sorted(str(i) for i, _ in rows if i not in leaked)
    for a, b in ((documents(rows), bench.limit(0)), (documents(rows).limit(0), bench)):
        assert decontaminate.hits(a, b).count() == 0 and decontaminate.clean(a, b).count() == a.count()


def test_decontamination_of_many_items(spark, documents):
    r = random.Random(7)
    items = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(r.choice((5, 9, 16, 40))))) for k in range(6000)]
    rows = [(k, " ".join(f"w{r.randrange(300)}" for _ in range(60))) for k in range(40)]
    rows += [(100 + k, " ".join([*(f"w{r.randrange(300)}" for _ in range(r.randrange(9))), t, "w1 w2"])) for k, (_, t) in enumerate(items[::150])]
    some = [x for x in items if x[0] % 150 == 0 or x[0] % 25 == 1]
    want = overlaps_by_force(rows, some)
    known = {j for j, _ in some}
    got = [x for x in overlap_rows(documents(rows), spark.createDataFrame(items, "item_id long, text string")) if x[1] in known]
    assert set(got) <= set(want) and {x[0] for x in got if x[0] >= 100} == set(range(100, 140))


# Quality


def test_quality(table, documents, spark):
    docs, labels = table("documents"), table("labels")
    got = {r.doc_id: r for r in quality.resample(docs, labels).collect()}
    known = {r.doc_id: r.quality for r in labels.collect()}
    good = [got[i].kept for i, q in known.items() if q == 1]
    bad = [got[i].kept for i, q in known.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.2
    kept = quality.kept_documents(docs, labels)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in got.items() if r.kept)
    again = {r.doc_id: r.key for r in quality.resample(docs, labels).collect()}
    assert again == {i: r.key for i, r in got.items()}
    some = spark.createDataFrame([(4, 1), (8, 0), (None, 1), (99, 0), (2, None)], "doc_id long, quality int")
    assert quality.resample(documents(EDGES), some).count() == len(EDGES)
    assert quality.kept_documents(documents(EDGES), some.limit(0)).count() == len(EDGES)
    assert quality.resample(documents(EDGES).limit(0), some).count() == 0


def plain_grams(t):
    """Buckets of a text's unigrams and bigrams, one by one, in whole numbers."""
    m, out, last = 1 << 64, [], None
    for w in words(t):
        for part in re.findall(rb"[0-9a-z\x80-\xff]+|[^0-9a-z\x80-\xff]+", w):
            h = xxhash.xxh3_64_intdigest(part)
            out.append(h >> 50)
            if last is not None:
                out.append((last * 0x9E3779B97F4A7C15 + (h ^ (h >> 31))) * 0x9E3779B97F4A7C15 % m >> 50)
            last = h
    return out


def resampled_by_force(rows, labels):
    """The weight of each row, and which rows the labels' best cut and the largest keys keep."""
    mark = {}
    for i, q in labels:
        if i is not None and q is not None:
            mark[i] = min(q, mark.get(i, q))
    raw, target = collections.Counter(), collections.Counter()
    for i, t in rows:
        raw.update(plain_grams(t))
        if mark.get(i) == 1:
            target.update(plain_grams(t))
    n = 1 << 14
    p, q = sum(target.values()) + n, sum(raw.values()) + n
    weight = [sum(math.log((target[b] + 1) / p) - math.log((raw[b] + 1) / q) for b in plain_grams(t)) for _, t in rows]
    known = sorted((w, mark[i] == 1) for (i, _), w in zip(rows, weight) if i in mark)
    best = min(range(len(known) + 1), key=lambda k: 5 * sum(g for _, g in known[:k]) + sum(not g for _, g in known[k:]))
    cut = (known[best - 1][0] + known[best][0]) / 2 if 0 < best < len(known) else None
    return weight, cut and sum(w >= cut for w in weight)


def test_quality_by_force(spark, table):
    rows, labels = texts_of(table("documents")), [(r.doc_id, r.quality) for r in table("labels").collect()]
    weight, kept = resampled_by_force(rows, labels)
    got = {r.doc_id: r for r in quality.resample(table("documents"), table("labels")).collect()}
    assert all(got[i].log_weight == pytest.approx(w, abs=1e-6) for (i, _), w in zip(rows, weight))
    assert sum(r.kept for r in got.values()) == kept
    assert min(r.key for r in got.values() if r.kept) > max(r.key for r in got.values() if not r.kept)
    assert np.std([r.key - r.log_weight for r in got.values()]) == pytest.approx(math.pi / 6**0.5, rel=0.25)


def test_quality_of_rows_without_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    known = sorted((r.doc_id, r.quality) for r in labels.collect() if r.quality is not None)
    half = [x for k, x in enumerate(known) if k % 2]
    got = {r.doc_id: r.kept for r in quality.resample(docs, spark.createDataFrame(half, "doc_id long, quality int")).collect()}
    for label, least in ((1, 0.9), (0, 0.7)):
        assert np.mean([got[i] == (q == 1) for i, q in known[::2] if i in got and q == label]) > least


def test_kth_largest(spark):
    df = spark.range(50_000).selectExpr("cast(pmod(xxhash64(id), 1000) as double) as x")
    values = sorted((r.x for r in df.collect()), reverse=True)
    for k in (1, 17, 25_000, 50_000):
        assert quality.kth_largest(df, "x", k, few=100) == values[k - 1]


# Mixing


def test_targets():
    assert mixing.targets([100, 100, 100], [5, 2, 1], 1.5, 2) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.targets([0, 10], [5, 2], 1.5, 2) == [0.0, 15.0]
    assert mixing.targets([], [], 1.5, 2) == []


def mix_by_force(rows):
    """(size, source_size, target) by row, and the targets by source; rows are (doc_id, text, source)."""
    sizes = [len(words(t)) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight, left = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 1.5 * sum(sizes)
    goal, open_ = {}, list(names)
    while open_:
        each = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if each * weight[s] > 2 * total[s]]
        for s in full or open_:
            goal[s] = 2.0 * total[s] if full else each * weight[s]
            left -= goal[s]
        open_ = [s for s in open_ if s not in goal]
    return [(n, total[r[2]], goal[r[2]]) for n, r in zip(sizes, rows)], total, goal


def test_mixing(table, documents):
    many = documents([(i, " ".join(["w"] * (1 + i % 7))) for i in range(600)], source=lambda k: f"s{k % 40:02}")  # 40 sources of a few dozen words
    tiny = documents([(i, "a b c") for i in range(9)], source=lambda k: f"s{k}")
    for df in (table("documents"), many, tiny):
        rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
        want, total, goal = mix_by_force(rows)
        got = mixing.mix(df).collect()
        assert sorted((r.doc_id, r.size, r.source_size) for r in got) == sorted((i, n, t) for (i, *_), (n, t, _) in zip(rows, want))
        source = {i: s for i, _, s in rows}
        for s in total:
            own = [r for r in got if source[r.doc_id] == s]
            assert all(r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 2 * r.size for r in own)
            assert abs(sum(r.taken for r in own) - goal[s]) <= mixing.grain(total[s])
        assert all((r.first_slot is None) == (r.taken == 0) for r in got)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df).collect()))


def test_schedule(spark):
    quotas = [700, 0, 3, 1, 90_000, 40_000]
    slots = sorted(mixing.schedule(spark, quotas).collect(), key=lambda r: r.slot)
    assert len({r.slot for r in slots}) == len(slots) == sum(quotas)
    for s, q in enumerate(quotas):
        assert [r["rank"] for r in slots if r.src == s] == list(range(q))
    for at in range(10_000, 130_000, 10_000):
        seen = collections.Counter(r.src for r in slots[:at])
        assert all(abs(seen[s] - q * at / sum(quotas)) <= 8 for s, q in enumerate(quotas))
    assert mixing.schedule(spark, []).count() == mixing.schedule(spark, [0]).count() == 0


def test_mixed_order(documents):
    df = documents([(i, " ".join(["w"] * 40)) for i in range(900)], source=lambda k: "abc"[k % 3])
    first = {r.doc_id: r.first_slot for r in mixing.mix(df).collect()}
    got = [r.doc_id for r in mixing.mixed_documents(df).collect()]
    once = [first[i] for i in dict.fromkeys(got)]
    assert set(got) <= set(first) and len(got) > len(set(got))
    assert sum(a is not None and b is not None and a > b for a, b in zip(once, once[1:])) < 0.05 * len(once)


def test_mixing_odd_rows(documents):
    df = documents(EDGES, source=lambda k: None if k % 4 == 0 else f"s{k % 2}")
    got = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(i), len(words(t))) for i, t in EDGES)
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns and {r.doc_id for r in mixed.collect()} <= {i for i, _ in EDGES}
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_points_are_even():
    p = mixing.points(0, 4096)
    assert np.abs(np.bincount((p * 64).astype(int), minlength=64) - 64).max() <= 3
    assert np.allclose(mixing.points(1 << 20, 100), np.modf((np.arange(100) + (1 << 20) + 0.5) * mixing.STEP)[0], atol=1e-7)


# Token ids


def test_token_files(table, documents, spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    for df in (table("documents"), documents(EDGES)):
        got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_output.encode_and_read_back(df, path).collect()), key=lambda r: r[1])
        rows = {}
        for i, t in texts_of(df):
            ids = plain.encode(t or "", add_special_tokens=False).ids + [2]
            rows.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        assert [r[0] for r in got] == sorted((i for i, _ in texts_of(df)), key=lambda i: (i is not None, i or 0))
        start = 0
        for i, s, n, crc in got:
            assert s == start and (n, crc) in rows[i]
            start += n
    assert token_output.encode_and_read_back(documents(EDGES).limit(0), path).count() == 0
    out = f"file://{tmp_path}/ids"
    manifest, parts = token_output.write(documents(EDGES), out, path)
    unknown = spark.createDataFrame([(12345,), (8,)], "doc_id long")
    assert [r.doc_id for r in token_output.lookup(unknown, out, parts).collect()] == [8]


def test_lookup_reads_its_range_alone(documents, spark, tmp_path, monkeypatch):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    # A third of the rows share an id, and a third have none: both run through several shards.
    rows = [(None if i % 3 == 0 else 77 if i % 3 == 1 else 1000 + i, f"text number {i} " + "word " * (i % 9)) for i in range(300)]
    out = f"file://{tmp_path}/ids"
    manifest, parts = token_output.write(documents(rows), out, path, shards=7)
    keys = documents(rows).select("doc_id").distinct()
    places = token_output.lookup(keys, out, parts)
    assert max(r.shards for r in places.collect()) > 1
    ids = lambda t: plain.encode(t, add_special_tokens=False).ids + [2]
    want = sorted(((i, len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for i, t in rows), key=str)
    got = token_output.fetch(places, manifest, out).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == want
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    twice = token_output.fetch(token_output.lookup(keys.unionAll(keys), out, parts), manifest, out)
    assert twice.count() == 2 * len(rows)
    # Bytes read for some documents: their own, two a token.
    store, read = token_output.Store(out), []
    monkeypatch.setattr(store, "read", lambda name, start=0, length=None, f=store.read: read.append(length) or f(name, start, length))
    one = [r for r in places.collect() if r.shards == r.rows == 1][:2]
    for r in one:
        raw = list(token_output.read_ids(store, f"shard-{r.shard:06d}.ids", np.array([r["at"]]), np.array([r.tokens]), 2))
        assert np.frombuffer(raw[0], "<u2").tolist() == ids(dict(rows)[r.doc_id])
    assert read == [2 * r.tokens for r in one]


def test_encoder_equals_library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, own, r = Tokenizer.from_file(path), token_output.Encoder(path, 2), random.Random(1)
    parts = ["a", "b", " ", "  ", "\n", "\t", "1", ".", "'s", "é", "<|endoftext|>", " ", "　", "word", "\x00", "😀", "\r", "ing,", "Ωmega"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for t, raw in zip(texts, own.encode(pa.array(texts))):
        assert np.frombuffer(raw, "<u2").tolist() == [*plain.encode(t, add_special_tokens=False).ids, 2]


def test_perfect_hash():
    keys = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    h, _ = token_output.PerfectHash.load(token_output.PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))


# The pipeline


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    got = corpus_pipeline.run(spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and got.count() > 100


def test_stages_by_force(spark, table):
    """Each stage of the pipeline on what the one before kept, against plain Python."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    docs = table("documents")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    good = common.cut(stages.good_documents(spark, docs, SMALL), "good")
    weight, n = resampled_by_force(texts_of(docs), [(r.doc_id, r.quality) for r in table("labels").collect()])
    assert good.count() == n
    one = common.cut(stages.distinct_documents(spark, good, SMALL), "one")
    assert ids(one) == sorted({c if k else i for i, k, c in components_by_force(texts_of(good))})
    some = one.where("doc_id % 4 = 0 or length(text) < 1000")  # the force below compares word by word
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    leaked = {x[0] for x in overlaps_by_force([x for x in texts_of(some) if len(words(x[1])) < 400], items[::4])}
    clean = common.cut(stages.uncontaminated_documents(spark, some, SMALL), "clean")
    assert not leaked & set(ids(clean)) and len(ids(clean)) > 0.8 * some.count()
    mixed = common.cut(stages.mixed_documents(spark, clean, SMALL), "mixed")
    want, total, goal = mix_by_force([(r.doc_id, r.text, r.source) for r in clean.collect()])
    taken, longest = collections.Counter(), collections.Counter()
    for r in mixed.collect():
        size = len(words(r.text))
        taken[r.source] += size
        longest[r.source] = max(longest[r.source], size)
    assert max(collections.Counter(ids(mixed)).values()) <= 2
    assert all(abs(taken[s] - goal[s]) <= max(3 * longest[s], 0.4 * goal[s]) for s in total)
    got = stages.token_files(spark, mixed, SMALL).collect()
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    of = {r.doc_id: plain.encode(r.text or "", add_special_tokens=False).ids + [2] for r in clean.collect()}
    assert sorted(r.doc_id for r in got) == ids(mixed)
    assert all((r.n_tokens, r.ids_crc32) == (len(of[r.doc_id]), zlib.crc32(np.array(of[r.doc_id], "<u4").tobytes())) for r in got)


def test_clashing_names(spark, documents):
    names = "row_key rid h key noise leak_items leak_key_a slot bucket end start taken copies __rid__ __noise__ __copies__ __copy__ item hash words".split()
    df = documents([x for x in EDGES if x[0] not in (6, 7)]).select("doc_id", "text", "lang", "source", "n_chars", *(F.lit(f"own {n}").alias(n) for n in names))
    for stage in (stages.good_documents, stages.distinct_documents, stages.uncontaminated_documents, stages.mixed_documents):
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns and out.count() > 0
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
    for made in (queries.secret_scan.scan(df), jaccard.join(df), brown_lm.score(df, classes=4), mixing.mix(df), suffix_dedup.dedup(df)):
        assert made.count() == df.count()


def test_settings_and_tables_are_put_back(spark, documents):
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(bound, "1234567")
    found = common.settled(lambda: mixing.mix(documents(EDGES)), "test")
    assert spark.conf.get(bound) == "1234567" and found.count() == len(EDGES)
    spark.conf.unset(bound)
    left = {f.rsplit("/", 1)[0] for f in found.inputFiles()}
    assert len(left) == 1 and "test-" in left.pop()


def test_stages_keep_columns_and_odd_rows(spark, documents):
    df = documents(EDGES)
    for _, stage in (("a", stages.good_documents), ("b", stages.distinct_documents), ("c", stages.uncontaminated_documents), ("d", stages.mixed_documents)):
        out = stage(spark, df, SMALL)
        assert out.columns == df.columns
        assert stage(spark, df.limit(0), SMALL).count() == 0
    kept = sorted((str(r.doc_id) for r in stages.distinct_documents(spark, df, SMALL).collect()))
    assert kept == sorted(["1", "2", "3", "4", "None", "6", str(1 << 60), "8"])


def test_queries_have_the_promised_columns(spark):
    want = {
        "op3_secret_scans": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"], "op4_jaccard_join": ["doc_id", "n_shingles", "component_id"],
        "op5_brown_lm": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], "op7_token_output": ["doc_id", "start", "n_tokens", "ids_crc32"],
        "op9_mixing": ["doc_id", "size", "source_size", "target", "taken"], "op10_suffix_dedup": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]}
    for name, columns in want.items():
        df = queries.queries()[name](spark, SMALL)
        assert df.columns[: len(columns)] == columns
