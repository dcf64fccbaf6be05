"""Operators on small fixtures: the edge cases, against numpy and plain Python."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshframe.functions.arithmetic import two_decimals, wrap_int8, wrap_int32
from meshframe.operators import elementwise, graph, logs, matrix, reduce, redistribute, scan, signal, stencil
from meshframe.plans import tasks
from meshframe.plans.durable import iterate
from meshframe.sources import arrays, files, images, webgraph

INT = 1 << 31


def cells(spark, m):
    m = np.asarray(m)
    return spark.createDataFrame([(i, j, m[i, j].item()) for i in range(m.shape[0]) for j in range(m.shape[1])], f"r long, c long, v {'double' if m.dtype.kind == 'f' else 'long'}")


def dense(df, shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[r.r, r.c] = r.v
    return out


def test_wrapping(spark):
    df = spark.createDataFrame([(x,) for x in (0, INT - 1, INT, -INT, -INT - 1, 5 * INT + 3, 127, 128, -129)], "x long")
    for r in df.select("x", wrap_int32(F.col("x")).alias("i"), wrap_int8(F.col("x")).alias("b")).collect():
        assert r.i == (r.x + INT) % (2 * INT) - INT and r.b == (r.x + 128) % 256 - 128


def test_two_decimals(spark):
    df = spark.createDataFrame([(x,) for x in (2.275, 1.005, 0.125, 0.375, 3.0, 7.456)], "x double")
    got = [r.y for r in df.select(two_decimals(F.col("x")).alias("y")).collect()]
    assert got == [float(f"{x:.2f}") for x in (2.275, 1.005, 0.125, 0.375, 3.0, 7.456)]


def test_reductions(spark):
    df = spark.createDataFrame([("a", 3), ("a", 5), ("a", 0), ("b", -7)], "k string, v long")
    got = {op: {r.k: r.v for r in reduce.reduce(df, ["k"], "v", op).collect()} for op in reduce.OPERATIONS}
    assert got["add"] == {"a": 8, "b": -7} and got["product"] == {"a": 0, "b": -7}
    assert got["logical_and"] == {"a": 0, "b": 1} and got["logical_or"] == {"a": 1, "b": 1} and got["logical_xor"] == {"a": 0, "b": 1}
    assert got["bitwise_xor"] == {"a": 6, "b": -7} and got["bitwise_and"] == {"a": 0, "b": -7} and got["bitwise_or"] == {"a": 7, "b": -7}
    assert reduce.reduce(df.limit(0), ["k"], "v", "add").count() == 0
    with pytest.raises(TypeError):
        reduce.reduction("bitwise_and", "double")
    with pytest.raises(ValueError):
        reduce.reduction("mean")


def test_fold_in_levels(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), "id", (F.col("id") % 7 + 1).alias("v"))
    got = {r.k: r.v for r in reduce.exact_product(df, ["k"], "v", "id").collect()}
    for k in (0, 1):
        p = 1
        for i in range(k, 5000, 2):
            p = p * (i % 7 + 1) % (1 << 32)
        assert got[k] == (p + INT) % (2 * INT) - INT
    small = reduce.fold(df, ["k"], "v", lambda a, x: a + x, F.lit(0).cast("long"), "id", fan_in=50)
    assert {r.k: r.v for r in small.collect()} == {k: sum(i % 7 + 1 for i in range(k, 5000, 2)) for k in (0, 1)}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(-(10**9), 10**9), min_size=1, max_size=60), st.integers(1, 9), st.integers(2, 5))
def test_scans(spark, values, chunk, top):
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    both = scan.prefix_scan(df, "i", "v", chunk=chunk, top=top), scan.prefix_scan(df, "i", "v", inclusive=False, chunk=chunk, top=top)
    total = np.cumsum(values).tolist()
    assert [r.scan for r in both[0].orderBy("i").collect()] == total
    assert [r.scan for r in both[1].orderBy("i").collect()] == [0, *total[:-1]]


def test_positions_and_sorts(spark):
    r = random.Random(0)
    values = [r.randrange(1 << 32) for _ in range(300)] + [5] * 20
    df = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    want = {i: p for p, (_, i) in enumerate(sorted((v, i) for i, v in enumerate(values)))}
    assert {x.i: x.pos for x in redistribute.radix_sort(df, "v", "i").collect()} == want
    assert {x.i: x.pos for x in redistribute.radix_rounds(df, "v", "i", bits=16, rounds=2).collect()} == want
    first = {i: p for p, (_, i) in enumerate(sorted((v >> 28, i) for i, v in enumerate(values)))}
    assert {x.i: x.pos for x in redistribute.msd_round(df, "v", "i").collect()} == first
    assert redistribute.radix_sort(df.limit(0), "v", "i").count() == 0


def test_victims_and_preferences(spark):
    idle = spark.createDataFrame([(1, 0, 3), (2, 0, 3)], "stub int, queued int, running int")
    assert redistribute.steal_victim(idle, "queued", "running", "stub").first()[0] == 1
    none = idle.withColumn("running", F.lit(0))
    assert redistribute.steal_victim(none, "queued", "running", "stub").first()[0] is None
    better = lambda *x: spark.range(1).select(redistribute.better(*map(F.lit, x))).first()[0]
    for a1, a2, b1, b2, wins in (
        (1, 1, 2, 2, True), (2, 2, 1, 1, False), (1, 1, 1, 1, False), (1, 2, 1, 3, True), (1, 3, 1, 2, False), (1, 2, 3, 2, True), (0, 1, 0, 2, False), (1, 0, 2, 0, False),
        (10.0, 100.0, 10.5, 95.0, False), (10.5, 95.0, 10.0, 100.0, False), (1.0, 2.1, 2.0, 2.0, False), (2.0, 2.0, 1.0, 2.1, False)):
        assert better(a1, a2, b1, b2) == wins, (a1, a2, b1, b2)
    stubs = spark.createDataFrame([(1, 5, 1, True, 0), (2, 5, 9, True, 1), (3, 0, 2, False, 1), (4, 0, 0, True, 1)], "stub int, queued int, running int, multi boolean, kind int")
    pick = lambda **x: redistribute.steal_victim(stubs.withColumns(x.pop("change", {})), "queued", "running", "stub", **x).first()[0]
    assert (pick(), pick(ignore=1), pick(ignore=2)) == (1, 2, 1)
    idle = {"queued": F.lit(0), "running": F.lit(0)}
    assert pick(change=dict(idle)) is None and pick(change=dict(idle), multi="multi") in (1, 2, 4)
    assert pick(change=dict(idle), multi="multi", kind="kind", ignore=4) == 1 and pick(change=idle | {"kind": F.lit(0)}, multi="multi", kind="kind", ignore=4) in (1, 2)


def test_wrapping(spark):
    big, m = 1 << 62, 1 << 64
    signed = lambda x: (x + m // 2) % m - m // 2
    values = [big, big, big, -3, 7]
    df = spark.createDataFrame([(1, v) for v in values], "k int, x long")
    product = 1
    for v in values:
        product *= v
    for kind, to in (("long", signed), ("unsigned long", lambda x: x % m)):
        assert int(reduce.reduce(df, ["k"], "x", "add", kind).first()["v"]) == to(sum(values))
        assert int(reduce.reduce(df, ["k"], "x", "product", kind).first()["v"]) == to(product)
    odd = [(1 << 40) + 1, 12345678901, -98765432101, 3]
    product = 1
    for v in odd:
        product *= v
    df = spark.createDataFrame([(1, v) for v in odd], "k int, x long")
    assert reduce.reduce(df, ["k"], "x", "product").first()["v"] == signed(product)
    assert reduce.reduce(df, ["k"], "x", "product", "unsigned int").first()["v"] == product % (1 << 32)


def test_elements(spark):
    df = spark.createDataFrame([(0, 0), (1, 5), (2, None)], "i long, v long")
    assert elementwise.identity_violations(df, "i", "v").first()[0] == 2
    assert elementwise.is_singular(df.limit(0).select("i", F.col("i").alias("j"), "v"), "i", "j", "v").first()[0] is False
    plan = elementwise.select_range(spark.read.parquet("/root/testdata/sf0.001/events.parquet"), "event_id", 3, 4)
    assert sorted(r.event_id for r in plan.collect()) == [3, 4, 5, 6]
    assert "GreaterThanOrEqual(event_id,3)" in plan._jdf.queryExecution().executedPlan().toString()


def test_pagerank(spark):
    links = [(1, 2), (1, 2), (1, 3), (2, 3), (3, 3), (4, 1), (5, 9)]
    rank = {p: 1.0 for p in {x for e in links for x in e}}
    for _ in range(3):
        new = dict.fromkeys(rank, 0.0)
        for s, d in links:
            new[d] += 0.85 * rank[s] / sum(1 for x, _ in links if x == s)
        rank = new
    edges = spark.createDataFrame(links, "src long, dst long")
    for got in (graph.pagerank(edges, 3), graph.pagerank_pull(graph.invert(edges), graph.pages_of(edges), 3)):
        assert {r.page: r["rank"] for r in got.collect()} == pytest.approx(rank)


def test_products(spark):
    r = np.random.default_rng(0)
    a, b = r.integers(-9, 9, (7, 11)), r.integers(-9, 9, (11, 5))
    a[3] = 0
    assert (dense(matrix.matmul(cells(spark, a), cells(spark, b)), (7, 5)) == a @ b).all()
    assert (dense(matrix.matmul_blocks(cells(spark, a), cells(spark, b), 4), (7, 5)) == a @ b).all()
    full = matrix.sparse_times_dense(cells(spark, a), cells(spark, b), spark.range(7).select(F.col("id").alias("r")))
    assert full.count() == 35 and (dense(full, (7, 5)) == a @ b).all()
    assert (dense(matrix.transpose(cells(spark, a)), (11, 7)) == a.T).all()
    starts = {x.r: x.start for x in matrix.row_pointers(cells(spark, a).where("v <> 0"), spark.range(7).select(F.col("id").alias("r"))).collect()}
    assert [starts[i] for i in range(7)] == [0, *np.cumsum((a != 0).sum(1))[:-1]]


@pytest.mark.parametrize("n,block", [(1, 4), (9, 3), (10, 4)])
def test_lu(spark, n, block):
    m = np.random.default_rng(n).random((n, n)) + n * np.eye(n)
    packed = matrix.lu(cells(spark, m), n, block)
    f = dense(packed, (n, n))
    assert np.allclose(np.tril(f) @ (np.triu(f, 1) + np.eye(n)), m)
    assert np.allclose(dense(matrix.rebuild(packed, n, 4), (n, n)), m)


def filtered(image, w):
    h, wide = image.shape
    k = len(w) // 2
    w = np.array(w)[::-1]
    out = np.zeros_like(image)
    for y in range(h):
        for x in range(wide):
            s = sum(int(w[i, j]) * int(image[min(max(y + i - k, 0), h - 1), min(max(x + j - k, 0), wide - 1)]) for i in range(len(w)) for j in range(len(w)))
            out[y, x] = (s + 128) % 256 - 128
    return out


@pytest.mark.parametrize("h,w,radius,tile", [(9, 14, 1, 4), (3, 2, 2, 5), (1, 1, 3, 8), (12, 12, 2, 5)])
def test_stencil(spark, h, w, radius, tile):
    r = np.random.default_rng(h)
    image, weights = r.integers(-128, 128, (h, w)), r.integers(-4, 5, (2 * radius + 1,) * 2)
    df = cells(spark, image).select(F.col("r").alias("y"), F.col("c").alias("x"), "v")
    back = lambda d: dense(d.select(F.col("y").alias("r"), F.col("x").alias("c"), "v"), (h, w))
    assert (back(stencil.convolve(df, weights, tile=tile)) == filtered(image, weights)).all()
    assert (back(stencil.convolve_rounds(df, weights, 2, tile=tile)) == filtered(filtered(image, weights), weights)).all()
    with pytest.raises(ValueError):
        stencil.convolve(df, [[1, 2], [3, 4]])


def test_fourier(spark):
    z = np.random.default_rng(1).normal(size=(6, 10)) + 1j * np.random.default_rng(2).normal(size=(6, 10))
    df = spark.createDataFrame([(i, j, z[i, j].real.item(), z[i, j].imag.item()) for i in range(6) for j in range(10)], "r long, c long, re double, im double")

    def back(d):
        out = np.zeros_like(z)
        for x in d.collect():
            out[x.r, x.c] = x.re + 1j * x.im
        return out

    assert np.allclose(back(signal.fft_rows(df)), np.fft.fft(z, axis=1)) and np.allclose(back(signal.fft_columns(df)), np.fft.fft(z, axis=0))
    assert np.allclose(back(signal.fft_2d(df)), np.fft.fft2(z)) and np.allclose(back(signal.fft_2d_transposed(df)), np.fft.fft2(z))
    assert np.allclose(back(signal.fft_2d(signal.fft_2d(df), signal.REVERSE)), z * z.size)


@pytest.mark.parametrize("direction", [signal.FORWARD, signal.REVERSE])
@pytest.mark.parametrize("cut", [1, 3, 7, 1000])
def test_fourier_of_lines_in_batches(spark, cut, direction):
    r = np.random.default_rng(cut)
    lines = {None: 6, -5: 3, 0: 1, 2: 4, 3: 4, 4: 4, 9: 23, 10: 2}
    grid = [(k, int(3 * j - 7), *r.normal(size=2).tolist()) for k, n in lines.items() for j in range(n)]
    df = spark.createDataFrame([grid[j] for j in r.permutation(len(grid))], "r long, c long, re double, im double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", cut)
    try:
        got = {(x.r, x.c): x.re + 1j * x.im for x in signal.fft_rows(df, direction).collect()}
        turned = signal.fft_columns(df.select(F.col("c").alias("r"), F.col("r").alias("c"), "re", "im"), direction).collect()
        assert signal.fft_rows(df.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(x.c, x.r): x.re + 1j * x.im for x in turned} and got.keys() == {x[:2] for x in grid}
    for k, n in lines.items():
        z = np.array([x[2] + 1j * x[3] for x in grid if x[0] == k])
        want = np.fft.fft(z) if direction == signal.FORWARD else np.fft.ifft(z) * n
        assert np.allclose([got[k, 3 * j - 7] for j in range(n)], want)


def _grown(spark, name, run):
    """Peak MB of the largest of the Python workers that are called name, after a run."""

    def peak(batches):
        import resource
        import time

        import pyarrow as pa

        time.sleep(1)  # so that every worker gets a task
        yield from (pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]}) for _ in batches)

    spark.sparkContext.environment["MESHFRAME_TEST"] = name
    try:
        run().write.format("noop").mode("overwrite").save()
        return spark.range(0, 4, 1, 4).mapInArrow(peak, "mb double").agg(F.max("mb")).first()[0]
    finally:
        del spark.sparkContext.environment["MESHFRAME_TEST"]


@pytest.mark.parametrize("name", ["fft_2d_transposed", "fft_columns", "fft_2d"])
def test_fourier_holds_a_line_at_a_time(spark, name):
    rows, columns = 100_000, 16
    spark.sparkContext.environment["MESHFRAME_TEST"] = name  # Python workers of its own

    def peak(batches):
        import resource
        import time

        import pyarrow as pa

        time.sleep(1)  # so that every worker gets a task
        yield from (pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024]}) for _ in batches)

    def most():
        return spark.range(0, 4, 1, 4).mapInArrow(peak, "mb double").agg(F.max("mb")).first()[0]

    try:
        few = arrays.plane(spark, 100, columns, F.col("r") % 7).withColumnsRenamed({"v": "re"}).withColumn("im", F.lit(0.0))
        getattr(signal, name)(few).write.format("noop").mode("overwrite").save()
        base = most()
        grid = arrays.plane(spark, rows, columns, F.col("r") % 7).withColumnsRenamed({"v": "re"}).withColumn("im", F.lit(0.0))
        getattr(signal, name)(grid).write.format("noop").mode("overwrite").save()
        assert most() - base < rows * columns * 32 / 2**20  # less than the grid, whose lines take a 16th each
    finally:
        del spark.sparkContext.environment["MESHFRAME_TEST"]


@pytest.mark.parametrize("direction", [signal.FORWARD, signal.REVERSE])
@pytest.mark.parametrize("n", [101, 127, 128, 202, 1009, 1024, 1200, 2018, 4999])
def test_fourier_of_a_line_through_files(n, direction):
    import pyarrow as pa

    r = np.random.default_rng(n)
    lengths = {-1: 4, 0: n, 1: 100, 5: n, 6: 1, None: n}
    keys = [k for k, m in lengths.items() for _ in range(m)]
    places = [3 * j - 7 if j < m - 2 else None for m in lengths.values() for j in range(m)]
    z = r.normal(size=len(keys)) + 1j * r.normal(size=len(keys))
    for cut in (7, 250):
        table = pa.table({"r": pa.array(keys, pa.int64()), "c": pa.array(places, pa.int64()), "re": z.real.copy(), "im": z.imag.copy()})
        got = pa.Table.from_batches(signal._transformed(table.to_batches(cut), "r", "c", direction, 100, 64))
        assert got["r"].to_pylist() == keys and got["c"].to_pylist() == places
        at = 0
        for m in lengths.values():
            own = z[at : at + m]
            want = np.fft.fft(own) if direction == signal.FORWARD else np.fft.ifft(own) * m
            assert np.allclose(got["re"].to_numpy()[at : at + m] + 1j * got["im"].to_numpy()[at : at + m], want)
            at += m


@pytest.mark.parametrize("name", ["fft_columns", "fft_2d"])
@pytest.mark.parametrize("rows", [1_000_000, 999_983])
def test_fourier_holds_a_part_of_a_long_line(spark, monkeypatch, name, rows):
    columns = 4
    monkeypatch.setattr(signal, "LINE", 100_000, raising=False)
    monkeypatch.setattr(signal, "BLOCK", 1 << 15, raising=False)
    few, grid = (arrays.plane(spark, n, columns, F.col("r") * F.col("r") % 7 + F.col("c")).withColumnsRenamed({"v": "re"}).withColumn("im", F.lit(0.0)) for n in (100, rows))
    base = _grown(spark, f"{name} {rows}", lambda: getattr(signal, name)(few))
    most = _grown(spark, f"{name} {rows}", lambda: getattr(signal, name)(grid))
    assert most - base < rows * 64 / 2**20  # the numbers of a line and their transform take 32 bytes a place, its rows 32


def test_fourier_2d_of_long_lines(spark, monkeypatch):
    monkeypatch.setattr(signal, "LINE", 20, raising=False)
    monkeypatch.setattr(signal, "BLOCK", 16, raising=False)
    z = np.random.default_rng(5).normal(size=(37, 48, 2)) @ [1, 1j]
    df = spark.createDataFrame([(r, c, float(z[r, c].real), float(z[r, c].imag)) for r in range(37) for c in range(48)], "r long, c long, re double, im double")

    def back(f):
        got = np.full(z.shape, np.nan, complex)
        for x in f.collect():
            got[x.r, x.c] = x.re + 1j * x.im
        return got

    once = signal.fft_2d(df)
    assert np.allclose(back(once), np.fft.fft2(z))
    assert np.allclose(back(signal.fft_2d(once, signal.REVERSE)), z * z.size)
    assert np.allclose(back(signal.fft_2d_transposed(df)), np.fft.fft2(z))


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("noise\nTask [2, 7]\nSubtask 4 1.5 2.5\nSubtask 5_Cancelled 2 3\nSerial Task Execution Time = 1.25\nParallel Task 6 Execution Time = 2\n")
    lines = files.read_lines(spark, str(tmp_path))
    rows = [(r.host, r.task, r.subtask, r.cancelled, r.begin, r.end) for r in logs.timeline(lines, "log", "number").orderBy("number").collect()]
    assert rows == [(2, 7, 4, False, 1.5, 2.5), (2, 7, 5, True, 2.0, 3.0)]
    assert sorted((r["mode"], r.seconds) for r in logs.run_times(lines).collect()) == [(0, 1.25), (6, 2.0)]
    times = spark.createDataFrame([(1, 0, x) for x in (1.0, 2.0, 4.0)] + [(1, 3, 5.0)], "run int, mode int, seconds double")
    stats = {r["mode"]: (r["mean"], r["median"], r["sd"]) for r in logs.run_statistics(times, ["run", "mode"]).collect()}
    assert stats == {0: (2.33, 2.0, 1.25), 3: (5.0, 5.0, 0.0)}
    report = logs.report(logs.run_statistics(times, ["run", "mode"]), "run").first()
    assert report.mode_0 == 2.33 and report.mode_1 is None
    spans = spark.createDataFrame([("a", 0, 4), ("a", 2, 6), ("a", 8, 9), ("b", 1, 1)], "k string, b long, e long")
    got = {r.k: (r.accumulated, r.actual, r.overlapped) for r in logs.overlapped(spans, ["k"], "b", "e").collect()}
    assert got["a"] == (9, 7, 2)


def test_web_graph(spark, tmp_path):
    pages = [[2, 3], [], [1, 1, 4], [3]]
    for k in range(2):
        (tmp_path / f"web_{k}.bin").write_bytes(webgraph.encode_pages(pages[2 * k : 2 * k + 2], 3))
    (tmp_path / "metadata").write_bytes(np.array([4, 3, 2], "<u4").tobytes())
    meta = webgraph.read_metadata(spark, str(tmp_path / "metadata"))
    assert meta == {"pages": 4, "max_outlinks": 3, "pages_per_file": 2}
    paths = [str(tmp_path / f"web_{k}.bin") for k in range(2)]
    assert {r.page: list(r.outlinks) for r in webgraph.read_pages(spark, paths, meta).collect()} == {i + 1: p for i, p in enumerate(pages)}
    with pytest.raises(Exception, match="beyond page 3"):
        webgraph.read_pages(spark, paths, meta | {"pages": 3}).collect()
    made = webgraph.generate(spark, 2000, 20, seed=3)
    rows = made.collect()
    links = [(r.page, x) for r in rows for x in r.outlinks]
    assert all(1 <= x <= 2000 for _, x in links) and 9 < len(links) / 2000 < 11
    assert np.mean([min(abs(p - x), 2000 - abs(p - x)) <= 2 for p, x in links]) > 0.85
    assert rows == webgraph.generate(spark, 2000, 20, seed=3).collect()


def test_images(spark, tmp_path):
    pixels = np.random.default_rng(0).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    (tmp_path / "x.bmp").write_bytes(images.encode_bmp(pixels))
    for r in images.read_bmp(spark, str(tmp_path / "x.bmp")).collect():
        assert (r.b, r.g, r.r) == tuple(pixels[r.y, r.x].view(np.int8))
    assert images.random_image(spark, 4, 5).count() == 20


def test_arrays(spark):
    assert [r.v for r in arrays.fetch_range(arrays.linear(spark, 10, F.col("i") * 2), "i", 3, 2)] == [6, 8]
    with pytest.raises(ValueError):
        arrays.fetch(arrays.plane(spark, 3, 3), 8)
    m = dense(arrays.dominant_plane(spark, 6), (6, 6))
    assert (2 * np.diag(m) > m.sum(1)).all()
    assert arrays.random_ints(spark, 5).collect() == arrays.random_ints(spark, 5).collect()


def test_tasks(spark):
    seen = []
    tasks.register("double", tasks.Callbacks(lambda df: df.withColumn("v", F.col("v") * 2), data_distribution=lambda df: df.where("i < 3"), data_reduction=lambda df: df.agg(F.sum("v").alias("v")), completion=lambda df, data: seen.append(data)))
    with pytest.raises(KeyError):
        tasks.register("double", tasks.Callbacks(lambda df: df))
    task = tasks.submit("double", arrays.linear(spark, 5, F.col("i")), user_data="note")
    assert task.result().first().v == 6 and seen == ["note"] and task.seconds > 0
    tasks.release("double")
    tasks.register("slow", tasks.Callbacks(lambda df: elementwise.map_opaque(df, _slow, "i long, v int")))
    with pytest.raises(Exception):  # noqa: B017
        tasks.submit("slow", arrays.linear(spark, 4), timeout=1.0).result()
    tasks.release("slow")
    assert tasks.hosts(spark) >= 1


def _slow(batches):
    import time

    for pdf in batches:
        time.sleep(30)
        yield pdf


def test_iterate(spark):
    got = iterate(lambda df, k: df.withColumn("v", F.col("v") + k), arrays.linear(spark, 2), 4)
    assert [r.v for r in got.collect()] == [6, 6]


def test_products_in_blocks_when_dense(spark, monkeypatch):
    a, b = np.random.default_rng(5).integers(-9, 9, (7, 6)), np.random.default_rng(6).integers(-9, 9, (6, 5))
    a[0] = 0
    want = {(r.r, r.c, r.v) for r in matrix.matmul(cells(spark, a), cells(spark, b)).collect()}
    monkeypatch.setattr(matrix, "PRODUCT", 1e-9)
    monkeypatch.setattr(matrix, "FEW", 0)
    x, y = cells(spark, a), cells(spark, b)
    assert not matrix._worth_blocks(x.where('r < 0'), y, 4)
    infinite = spark.createDataFrame([(0, 0, float("inf")), (0, 1, 1.0)], "r long, c long, v double")
    assert not matrix._worth_blocks(infinite, infinite.withColumn("r", F.col("c")), 4)
    assert matrix._worth_blocks(x, y, 4)
    got = matrix.matmul(x, y, 4)
    assert {(r.r, r.c, r.v) for r in got.collect()} == want


def test_chunks_of_logs(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(3)
    spans = [("ab"[int(k)], int(x), int(x + y)) for k, x, y in zip(rng.integers(0, 2, 40), rng.integers(0, 30, 40), rng.integers(1, 9, 40))]
    df = spark.createDataFrame(spans, "k string, b long, e long")
    log = tmp_path / "run.log"
    log.write_text("".join(f"Task [{i // 7}, {i}]\n" if i % 7 == 3 else f"Subtask {i} {i}.0 {i + 1}.5\n" if i % 5 else "noise\n" for i in range(400)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        lines = files.read_lines(spark, str(log))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in lines.orderBy("number").collect()] == log.read_text().splitlines()
    assert sorted(r.number for r in lines.collect()) == list(range(400))
    whole = logs.timeline(lines, "log", "number").collect(), sorted(logs.overlapped(df, ["k"], "b", "e").collect())
    monkeypatch.setattr(logs, "CHUNK", 3)
    assert (sorted(logs.timeline(lines, "log", "number").collect(), key=str), sorted(logs.overlapped(df, ["k"], "b", "e").collect())) == (sorted(whole[0], key=str), whole[1])
    for k, accumulated, actual, _ in whole[1]:
        own = [range(b, e) for kk, b, e in spans if kk == k]
        assert (accumulated, actual) == (sum(map(len, own)), len(set().union(*own)))
