"""HTML extraction and nearest neighbours."""

import html
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from meshframe.llm import ann, html_extract


def test_held_out_pages():
    writer, model, exact = html_extract.Pages(777), html_extract.trained(), 0
    for _ in range(150):
        page = writer.page()
        nodes, blocks = html_extract.parse(page, True)
        want = " ".join(t for i, t in blocks if nodes[i].keep == 1)
        exact += want == html_extract.extract([page], model)[0]
    assert exact >= 140


def test_pages_table(table):
    for r in html_extract.main_text(table("pages")).join(table("pages").select("page_id", "html"), "page_id").collect():
        inner = r.html.split("<article>", 1)[1].split("</article>")[0]
        inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)>", " ", inner))
        assert r.text == " ".join(html.unescape(inner).split())


def test_odd_pages(spark):
    pages = [(1, "u", None), (2, None, ""), (3, "u", "plain text only"), (4, "u", "<p>unclosed <b>bold<div>x"), (5, "u", "<<>&&#x41;&bogus;</p></x><!-- "), (None, "u", "<article><p>a&nbsp;&amp; b<br>c</p></article>"), (7, "u", "<script>while(1)"), (8, "u", "<div " * 2000), (9, "u", "<article>" + "<p>many words here, again.</p>" * 20_000 + "</article>")]
    pages += [(10, "u", '<div data-keep="true"><article data-keep="no"><p>kept, whatever the attribute says, in a sentence.</p></article></div>'), (11, "u", "<x>" * 100_000 + "deep"), (12, "u", "<x>" * 50_000 + "</y>" * 50_000), (13, "u", "<a '>' " * 50_000)]
    df = spark.createDataFrame([(*p, "x") for p in pages + [pages[3]]], "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_extract.main_text(df).collect()]
    assert len(got) == len(pages) + 1
    by = dict(got)
    assert by[1] == by[2] == by[7] == "" and by[None] == "a & b c" and len(by[9].split()) == 80_000
    assert html_extract.main_text(df.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    r, writer = random.Random(0), html_extract.Pages(3)
    for _ in range(50):
        nodes, _ = html_extract.parse(writer.page())
        html_extract.features(nodes)
        kept = html_extract.decode(nodes, [r.uniform(-3, 3) for _ in nodes])
        at = {id(n): k for n, k in zip(nodes, kept)}
        assert all(at[id(n.parent)] or not at[id(n)] for n in nodes if n.parent)


def brute(rows, queries, k):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 8]
    out = {}
    for q, v in ok:
        if q in queries:
            c = [(-float((v * w).sum() / np.sqrt((v * v).sum() * (w * w).sum())), i) for i, w in ok if i != q]
            out[q] = [i for _, i in sorted(set(c))[:k]]
    return out


def test_small_search_is_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [1.0] * 7 + [None]), (2004, [1.0, 2.0]), (2005, []), (None, rows[3][1]), (2006, [float("inf")] + [1.0] * 7)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    got = {}
    for r in ann.nearest(df, df.where("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    want = brute(rows, {i for i, _ in rows if i is not None and i % 50 == 0}, 5)
    assert {q: [x[k] for k in sorted(x)] for q, x in got.items()} == want
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = df.where("vec_id < 3")
    assert ann.nearest(few, few).count() == 6


def test_ties(spark):
    """Multiples of one vector by powers of two, all with a cosine of exactly 1, in full leaves."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=16)
    rows = [(i, (v * 2.0 ** (i - 30)).tolist()) for i in range(60)] + [(1000 + i, rng.normal(size=16).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.nearest(df, df.where("vec_id in (0, 50)")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [(k, i) for k, i, _ in sorted(got[0])] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert [(k, i) for k, i, _ in sorted(got[50])] == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert len({c for x in got.values() for *_, c in x}) == 1


def recall(spark, df, vectors, ids):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    found = ann.nearest(df, df.where("vec_id % 50 = 0")).toPandas()
    hits = total = 0
    for q, g in found.groupby("query_id"):
        i = int(np.flatnonzero(ids == q)[0])
        c = unit @ unit[i]
        c[i] = -2
        hits += len(set(g.vec_id) & set(ids[np.argsort(-c)[:5]]))
        total += 5
    return hits / total


def test_recall_of_the_query(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    p = e.toPandas()
    assert recall(spark, e, np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()) >= 0.9


def test_recall_beyond_the_sample(spark, tmp_path):
    rng = np.random.default_rng(4)
    noise = rng.normal(size=(24_000, 64))
    centres = rng.normal(size=(300, 64))
    near = centres[rng.integers(0, 300, 24_000)] + 0.3 * rng.normal(size=(24_000, 64))
    for name, x in (("noise", noise), ("near", near)):
        pq.write_table(pa.table({"vec_id": np.arange(len(x)), "embedding": list(x)}), tmp_path / f"{name}.parquet")
        assert recall(spark, spark.read.parquet(f"file://{tmp_path}/{name}.parquet"), x, np.arange(len(x))) >= 0.9
    search = ann.Search(near[:20_000] / np.linalg.norm(near[:20_000], axis=1, keepdims=True), 10, 53, 5, 3)
    taken = [len(x) for x in search.leaves(near[20_000:20_100] / np.linalg.norm(near[20_000:20_100], axis=1, keepdims=True))]
    assert np.mean(taken) < 0.02 * search.forest.first[-1]
