"""One query for each array, matrix, graph and log operator, over whole tables, with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.arithmetic import wrap_int8
from .operators import elementwise, graph, logs, matrix, reduce, redistribute, scan, signal, stencil
from .plans import durable, tasks
from .sources import arrays, files, images, webgraph

QUERIES: dict = {}
SQL: dict[str, str] = {}

# What the queries read, as SQL.
EV = "ev AS (SELECT event_id AS i, user_id AS u, event_type AS t, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
EDGES = "sup AS (SELECT count(*) AS n FROM supplier), edges AS (SELECT l_suppkey AS src, l_partkey % sup.n AS dst FROM lineitem, sup)"
CELLS = "cells AS (SELECT vec_id AS r, d AS c, CAST(round(CAST(embedding[d + 1] AS DOUBLE) * 100) AS BIGINT) AS v FROM embeddings, (SELECT unnest(range(0, 64)) AS d) x)"
GRAM = f"{CELLS}, gram AS (SELECT a.c AS r, b.c AS c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM cells a JOIN cells b ON a.r = b.r GROUP BY 1, 2)"


def _cents(x: str) -> str:
    low, big = f"floor({x} * 100)", f"({x} * CAST(134217729 AS DOUBLE))"
    high = f"({big} - ({big} - {x}))"
    error = f"(({high} * 100 - {x} * 100) + ({x} - {high}) * 100)"
    return f"({low} + CASE WHEN {x} * 100 - {low} > 0.5 OR ({x} * 100 - {low} = 0.5 AND ({error} > 0 OR ({error} = 0 AND {low} % 2 = 1))) THEN 1 ELSE 0 END) / CAST(100 AS DOUBLE)"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its own name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _events(spark, d) -> DataFrame:
    return _table(spark, d, "events").select(F.col("event_id").alias("i"), F.col("user_id").alias("u"), F.col("event_type").alias("t"), F.round(F.col("value") * 100).cast("long").alias("v"))


def _edges(spark, d) -> DataFrame:
    n = _table(spark, d, "supplier").agg(F.count("*").alias("n"))
    return _table(spark, d, "lineitem").select("l_suppkey", "l_partkey").join(F.broadcast(n), how="cross").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") % F.col("n")).alias("dst"))


def _cells(spark, d) -> DataFrame:
    return arrays.embedding_cells(_table(spark, d, "embeddings"))


def _gram(spark, d) -> DataFrame:
    a = _cells(spark, d)
    return matrix.matmul(matrix.transpose(a), a)


def _add_reductions() -> None:
    plain = {"add": "CAST(sum(v) AS BIGINT)", "min": "min(v)", "max": "max(v)", "bitwise_and": "bit_and(v)", "bitwise_or": "bit_or(v)", "bitwise_xor": "bit_xor(v)"}
    logic = {"logical_and": "CAST(bool_and(v % 3 <> 0) AS BIGINT)", "logical_or": "CAST(bool_or(v % 3 <> 0) AS BIGINT)", "logical_xor": "CAST(count(*) FILTER (WHERE v % 3 <> 0) % 2 AS BIGINT)"}
    for op, agg in plain.items():
        QUERIES[f"reduce_{op}"] = lambda s, d, op=op: reduce.reduce(_events(s, d), ["t"], "v", op)
        SQL[f"reduce_{op}"] = f"WITH {EV} SELECT t, {agg} AS v FROM ev GROUP BY t"
    for op, agg in logic.items():
        QUERIES[f"reduce_{op}"] = lambda s, d, op=op: reduce.reduce(_events(s, d).withColumn("v", F.col("v") % 3), ["u"], "v", op)
        SQL[f"reduce_{op}"] = f"WITH {EV} SELECT u, {agg} AS v FROM ev GROUP BY u"
    for kind, made in {"double": "CAST(max(v) / CAST(8 AS DOUBLE) AS DOUBLE)", "int": "CAST(max(v) / 8 AS INTEGER)"}.items():
        QUERIES[f"reduce_max_{kind}"] = lambda s, d, kind=kind: reduce.reduce(_events(s, d).withColumn("v", F.col("v") / 8 if kind == "double" else F.expr("v div 8")), ["t"], "v", "max", kind)
        SQL[f"reduce_max_{kind}"] = f"WITH {EV} SELECT t, {made if kind == 'double' else 'CAST(max(v // 8) AS INTEGER)'} AS v FROM ev GROUP BY t"


_add_reductions()


@query(f"WITH {EV}, s AS (SELECT t, sum(v * 1000003) AS x FROM ev GROUP BY t) SELECT t, CAST(((x + 2147483648) % 4294967296 + 4294967296) % 4294967296 - 2147483648 AS INTEGER) AS v FROM s")
def reduce_add_int32(spark, d):
    return reduce.reduce(_events(spark, d).withColumn("v", F.col("v") * 1000003), ["t"], "v", "add", "int")


@query(f"WITH {EV} SELECT i // 8 AS g, CAST(product(v % 5 + 1) AS BIGINT) AS v FROM ev GROUP BY 1")
def reduce_product(spark, d):
    return reduce.reduce(_events(spark, d).select(F.expr("i div 8").alias("g"), (F.col("v") % 5 + 1).alias("v")), ["g"], "v", "product")


@query(f"WITH {EV} SELECT i // 8 AS g, CAST(product(v % 5 + 1) AS INTEGER) AS v FROM ev GROUP BY 1")
def reduce_product_int32(spark, d):
    return reduce.exact_product(_events(spark, d).select("i", F.expr("i div 8").alias("g"), (F.col("v") % 5 + 1).alias("v")), ["g"], "v", "i")


@query(f"WITH {EV} SELECT t, max(v) AS v FROM ev GROUP BY t")
def reduce_fold(spark, d):
    return reduce.fold(_events(spark, d), ["t"], "v", lambda a, x: F.greatest(a, x), F.lit(-(1 << 62)), "i", fan_in=500)


@query(f"WITH {EV} SELECT t, CAST(max(abs(v - 5000)) AS DOUBLE) AS v FROM ev GROUP BY t")
def reduce_custom(spark, d):
    def furthest(v):
        return float(v.abs().max())

    from .session import ship

    ship(spark)
    return reduce.custom(_events(spark, d).withColumn("v", (F.col("v") - 5000).cast("double")), ["t"], "v", furthest)


@query(f"WITH {EV} SELECT u, CAST(sum(v % 3) AS BIGINT) AS v FROM ev WHERE v % 3 <> 0 GROUP BY u")
def reduce_sparse(spark, d):
    return reduce.sparse_add(_events(spark, d).withColumn("v", F.col("v") % 3), "u", "v")


@query(f"WITH {EV} SELECT t, count(v) AS reductions, CAST(sum(v) AS BIGINT) AS buffer FROM ev GROUP BY t")
def reduce_carried(spark, d):
    """Three reductions, each from the state that the one before left."""
    rows, state = _events(spark, d), None
    for k in range(3):
        state = reduce.carried(rows.where(F.col("i") % 3 == k), ["t"], "v", state)
    return state


#: SQL of each built-in reduction of x, and the types that it gives.
_WHOLE = {"int": ("x", "INTEGER", "int"), "unsigned int": ("x + 5000", "BIGINT", "bigint"), "long": ("x * 1000003", "BIGINT", "bigint"), "unsigned long": ("x + 5000", "BIGINT", "bigint")}
_REAL = {"float": ("x / 4.0", "FLOAT", "float"), "double": ("x / 4.0", "DOUBLE", "double")}


def _reductions(kind: str, x: str, type_: str) -> str:
    to = lambda e: f"CAST({e} AS {type_})"
    found = {"add": "sum(x)", "min": "min(x)", "max": "max(x)", "logical_and": "min(CASE WHEN x <> 0 THEN 1 ELSE 0 END)", "logical_or": "max(CASE WHEN x <> 0 THEN 1 ELSE 0 END)", "logical_xor": "sum(CASE WHEN x <> 0 THEN 1 ELSE 0 END) % 2"}
    found |= {"bitwise_and": "bit_and(CAST(x AS BIGINT))", "bitwise_or": "bit_or(CAST(x AS BIGINT))", "bitwise_xor": "bit_xor(CAST(x AS BIGINT))"} if kind in _WHOLE else {}
    small = "product(i % 5 + 1)" if kind in _WHOLE else "product(i % 5 + 0.5)"
    own = ", ".join([f"{to(e)} AS {op}" for op, e in found.items()] + [f"{to(small)} AS product"])
    return f"WITH {EV}, y AS (SELECT i // 8 AS g, i, CAST({x.replace('x', '(v % 64 - 20)')} AS {'BIGINT' if kind in _WHOLE else 'DOUBLE'}) AS x FROM ev) SELECT g, {own} FROM y GROUP BY g"


def _reduced(kind: str, x: str, type_: str):
    def run(spark, d):
        rows = _events(spark, d).select(F.expr("i div 8").alias("g"), "i", (F.col("v") % 64 - 20).alias("x")).select("g", "i", F.expr(f"cast({x} as {type_ if kind in _REAL else 'bigint'})").alias("x"))
        ops = [op for op in reduce.OPERATIONS if op != "product" and (kind in _WHOLE or not op.startswith("bitwise"))]
        out = rows.groupBy("g").agg(*(reduce.reduction(op, kind)("x").cast(type_).alias(op) for op in ops))
        small = rows.withColumn("x", F.expr("i % 5 + 1" if kind in _WHOLE else "i % 5 + 0.5D"))
        return out.join(reduce.reduce(small, ["g"], "x", "product", kind, "product").withColumn("product", F.col("product").cast(type_)), "g")

    return run


for _kind, (_x, _sql, _spark) in (_WHOLE | _REAL).items():
    _name = "reductions_" + _kind.replace(" ", "_")
    QUERIES[_name], SQL[_name] = _reduced(_kind, _x, _spark), _reductions(_kind, _x, _sql)


@query(f"WITH {EV} SELECT i // 1000 AS chunk, v & 15 AS digit, count(*) AS n FROM ev GROUP BY 1, 2")
def digit_histogram(spark, d):
    return reduce.histogram(_events(spark, d), F.expr("i div 1000"), F.col("v").bitwiseAND(15))


@query(f"WITH {EV} SELECT t, sqrt(CAST(sum(v * v) AS DOUBLE)) AS norm FROM ev GROUP BY t")
def frobenius_norm(spark, d):
    return reduce.frobenius_norm(_events(spark, d), "v", ["t"])


@query(f"WITH {EV} SELECT u, CAST(sum(v) AS BIGINT) AS bytes, CAST(sum(i % 100) AS BIGINT) AS time, count(*) AS transfers FROM ev GROUP BY u")
def transfer_totals(spark, d):
    return reduce.transfer_totals(_events(spark, d).withColumn("s", F.col("i") % 100), "u", "v", "s")


@query(f"WITH {EV} SELECT t, CAST(sum(v) AS DOUBLE) / CAST(sum(i % 100) AS DOUBLE) AS rate FROM ev GROUP BY t")
def execution_rate(spark, d):
    return reduce.execution_rate(_events(spark, d).withColumn("s", F.col("i") % 100), "t", "v", "s")


@query(f"WITH {EV}, a AS (SELECT u % 10 AS machine, t, count(*) AS n FROM ev GROUP BY 1, 2) SELECT machine, t, n AS device_subtasks, CAST(sum(n) OVER (PARTITION BY machine) AS BIGINT) AS machine_subtasks FROM a")
def execution_profile(spark, d):
    return reduce.execution_profile(_events(spark, d).withColumn("machine", F.col("u") % 10), "t", "machine")


@query(f"WITH {EV} SELECT i, v * 3 + 1 AS v FROM ev")
def map_elements(spark, d):
    return elementwise.map_elements(_events(spark, d).select("i", "v"), v=F.col("v") * 3 + 1)


@query(f"WITH {EV} SELECT i, v * 2 + 1 AS v FROM ev")
def map_opaque(spark, d):
    def double(batches):
        for pdf in batches:
            yield pdf.assign(v=pdf["v"] * 2 + 1)

    return elementwise.map_opaque(_events(spark, d).select("i", "v"), double, "i long, v long")


@query(f"WITH {EV} SELECT count(*) FILTER (WHERE v IS DISTINCT FROM i) AS violations FROM ev")
def identity_violations(spark, d):
    return elementwise.identity_violations(_events(spark, d), "i", "v")


@query(f"WITH {EV} SELECT i, v + (i // 1000) * 7 AS v FROM ev")
def add_chunk_offsets(spark, d):
    rows = _events(spark, d).select("i", "v", F.expr("i div 1000").alias("c"))
    return scan.add_offsets(rows, rows.select("c").distinct().withColumn("offset", F.col("c") * 7), "v").select("i", "v")


@query(f"WITH {EV} SELECT i, i % 64 AS at FROM ev")
def local_index(spark, d):
    return _events(spark, d).select("i", elementwise.local_index(F.col("i"), 64).alias("at"))


@query(f"WITH {EV} SELECT i, v FROM ev WHERE i >= 100 AND i < 400")
def fetch_range(spark, d):
    return elementwise.select_range(_events(spark, d).select("i", "v"), "i", 100, 300)


@query(f"WITH {CELLS} SELECT r, CAST(c AS BIGINT) AS c, v FROM cells WHERE r >= 16 AND r < 32 AND c >= 32 AND c < 48")
def fetch_block(spark, d):
    return elementwise.select_blocks(_cells(spark, d), "r", "c", 1, 2, 16)


@query(f"WITH {EV} SELECT i, v % 4 AS v FROM ev WHERE v % 4 <> 0")
def compress_sentinel(spark, d):
    return elementwise.compress(_events(spark, d).select("i", (F.col("v") % 4).alias("v")), "v")


@query(f"WITH {EV} SELECT count(*) FILTER (WHERE v % 4 <> 0) / CAST(count(*) AS DOUBLE) < 0.4 AS compress FROM ev")
def worth_compressing(spark, d):
    return elementwise.worth_compressing(_events(spark, d).select((F.col("v") % 4).alias("v")), "v")


@query("WITH s AS (SELECT l_suppkey AS k, count(*) AS v FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09 GROUP BY 1) SELECT s_suppkey AS k, coalesce(v, 0) AS v FROM supplier LEFT JOIN s ON s_suppkey = k")
def zero_fill(spark, d):
    some = _table(spark, d, "lineitem").where("l_quantity >= 50 AND l_discount > 0.09").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("v"))
    return elementwise.zero_fill(_table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), some, ["k"], "v")


@query(f"WITH {CELLS} SELECT coalesce(bool_or(v = 0), false) AS singular FROM cells WHERE r = c")
def is_singular(spark, d):
    return elementwise.is_singular(_cells(spark, d), "r", "c", "v")


@query(f"WITH {EV} SELECT i, v, row_number() OVER (ORDER BY u % 7, i) - 1 AS pos FROM ev")
def redistribute_rows(spark, d):
    return redistribute.redistribute(_events(spark, d).select("i", "u", "v"), F.col("u") % 7, ["i"]).select("i", "v", "pos")


@query(f'WITH {EV} SELECT u % 7 AS "order", count(*) AS length FROM ev GROUP BY 1')
def redistribution_metadata(spark, d):
    return redistribute.metadata(_events(spark, d), F.col("u") % 7, F.lit(1))


@query(f"WITH {EV}, s AS (SELECT u % 7 AS o, t AS host, count(*) AS length FROM ev GROUP BY 1, 2) SELECT o, host, length, CAST(coalesce(sum(length) OVER (ORDER BY o, host ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM s")
def segment_offsets(spark, d):
    segments = _events(spark, d).groupBy((F.col("u") % 7).alias("o"), F.col("t").alias("host")).agg(F.count("*").alias("length"))
    return scan.segment_offsets(segments, ["o", "host"], "length")


@query(f"WITH {EV} SELECT i, v, row_number() OVER (ORDER BY v & 15, i) - 1 AS pos FROM ev")
def counting_round(spark, d):
    return redistribute.counting_round(_events(spark, d).select("i", "v"), F.col("v").bitwiseAND(15), "i")


@query(f"WITH {EV} SELECT i, v, row_number() OVER (ORDER BY v, i) - 1 AS pos FROM ev")
def radix_sort(spark, d):
    return redistribute.radix_sort(_events(spark, d).select("i", "v"), "v", "i")


@query(SQL["radix_sort"])
def radix_sort_rounds(spark, d):
    return redistribute.radix_rounds(_events(spark, d).select("i", "v"), "v", "i", bits=8, rounds=4)


@query(f"WITH {EV} SELECT i, v, row_number() OVER (ORDER BY v >> 12, i) - 1 AS pos FROM ev")
def msd_round(spark, d):
    return redistribute.msd_round(_events(spark, d).select("i", "v"), "v", "i", bits=20)


@query(f"WITH {EV} SELECT i, v, CAST(sum(v) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM ev")
def prefix_sum(spark, d):
    return scan.prefix_scan(_events(spark, d), "i", "v", chunk=1000)


@query(f"WITH {EV} SELECT i, v, CAST(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM ev")
def prefix_sum_exclusive(spark, d):
    return scan.prefix_scan(_events(spark, d), "i", "v", inclusive=False, chunk=1000)


@query(SQL["prefix_sum"])
def prefix_sum_levels(spark, d):
    return scan.prefix_scan(_events(spark, d), "i", "v", chunk=64, top=20)


@query(f"WITH {EV}, n AS (SELECT t, count(*) AS n FROM ev GROUP BY t) SELECT t, n, CAST(row_number() OVER (ORDER BY n DESC, t) AS INTEGER) AS place FROM n")
def device_ranking(spark, d):
    return redistribute.device_ranking(_events(spark, d).groupBy("t").agg(F.count("*").alias("n")), "n", "t")


@query(f"WITH {EV}, n AS (SELECT u, count(*) AS n FROM ev GROUP BY u) SELECT u AS victim FROM n ORDER BY n DESC, u LIMIT 1")
def steal_victim(spark, d):
    stubs = _events(spark, d).groupBy("u").agg(F.count("*").alias("queued"), F.sum("v").alias("running"))
    return redistribute.steal_victim(stubs, "queued", "running", "u")


@query(f"WITH {EV}, p AS (SELECT u, i, v, row_number() OVER (PARTITION BY u ORDER BY v, i) AS place FROM ev) SELECT u, i, v, CAST(place AS INTEGER) AS place FROM p WHERE place <= 3")
def affinity_pick(spark, d):
    return redistribute.affinity_pick(_events(spark, d).select("u", "i", "v"), "u", "i", "v", 3)


# Both costs less, and not both more, or less on one with the other within a tenth and not so the other way round.
_WINS = """(v < 9000 AND u < 75) OR (NOT (9000 < v AND 75 < u) AND (
(v < 9000 AND 75 - u < 0.1 * 75 AND NOT (75 < u AND v - 9000 < 0.1 * v)) OR (u < 75 AND 9000 - v < 0.1 * 9000 AND NOT (9000 < v AND u - 75 < 0.1 * u))))"""


@query(f"WITH {EV} SELECT i FROM ev WHERE {_WINS}")
def two_criteria(spark, d):
    return _events(spark, d).where(redistribute.better(F.col("v"), F.col("u"), F.lit(9000), F.lit(75))).select("i")


@query(f"WITH {EV}, n AS (SELECT u, count(*) AS n FROM ev GROUP BY u), m AS (SELECT max(u) AS own FROM ev) SELECT (SELECT u FROM n, m WHERE u <> own ORDER BY n DESC, u LIMIT 1) AS victim")
def steal_victim_of_stub(spark, d):
    stubs = _events(spark, d).groupBy("u").agg(F.lit(0).alias("queued"), F.count("*").alias("running"), F.lit(True).alias("multi"), (F.col("u") % 2).alias("kind"))
    own = stubs.agg(F.max("u")).first()[0]
    return redistribute.steal_victim(stubs, "queued", "running", "u", ignore=own, multi="multi", kind="kind")


@query(f"WITH {EV}, b AS (SELECT i // 50 AS s, max(CASE WHEN u % 2 = 0 THEN v END) AS zero, max(CASE WHEN u % 2 = 1 THEN v END) AS one FROM ev GROUP BY 1) SELECT s, one - zero AS gain FROM b WHERE one - zero IS NOT NULL ORDER BY gain DESC, s LIMIT 10")
def affinity_difference(spark, d):
    costs = _events(spark, d).select((F.col("u") % 2).alias("m"), F.expr("i div 50").alias("s"), "v")
    return redistribute.affinity_difference(costs, "m", "s", "v", 0, 1, 10)


@query(f"WITH {EDGES} SELECT src, count(*) AS degree FROM edges GROUP BY src")
def out_degree(spark, d):
    return graph.out_degree(_edges(spark, d))


@query(f"WITH {EDGES} SELECT dst, count(*) AS degree FROM edges GROUP BY dst")
def in_degree(spark, d):
    return graph.in_degree(_edges(spark, d))


@query(f"WITH {EDGES}, o AS (SELECT src, count(*) AS degree FROM edges GROUP BY src) SELECT e.src, dst, count(*) AS n, degree FROM edges e JOIN o ON e.src = o.src GROUP BY e.src, dst, degree")
def invert_links(spark, d):
    return graph.invert(_edges(spark, d)).select("src", "dst", "n", "degree")


_RANKS = f"""WITH {EDGES}, o AS (SELECT src, count(*) AS degree FROM edges GROUP BY src),
p AS (SELECT src AS page FROM edges UNION SELECT dst FROM edges),
r1 AS (SELECT p.page, coalesce(s.x, 0) AS rank FROM p LEFT JOIN (SELECT e.dst, sum(0.85 * CAST(1 AS DOUBLE) / o.degree) AS x FROM edges e JOIN o ON e.src = o.src GROUP BY e.dst) s ON p.page = s.dst),
r2 AS (SELECT p.page, coalesce(s.x, 0) AS rank FROM p LEFT JOIN (SELECT e.dst, sum(0.85 * r1.rank / o.degree) AS x FROM edges e JOIN o ON e.src = o.src JOIN r1 ON r1.page = e.src GROUP BY e.dst) s ON p.page = s.dst)
SELECT page, round(rank, 6) AS rank FROM r2"""


@query(_RANKS)
def pagerank(spark, d):
    return graph.pagerank(_edges(spark, d)).withColumn("rank", F.round("rank", 6))


@query(_RANKS)
def pagerank_inverted(spark, d):
    edges = _edges(spark, d)
    return graph.pagerank_pull(graph.invert(edges), graph.pages_of(edges)).withColumn("rank", F.round("rank", 6))


@query(f"WITH {GRAM} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, v FROM gram")
def matmul(spark, d):
    return _gram(spark, d)


@query(f"WITH {GRAM} SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, v FROM gram WHERE v <> 0")
def matmul_blocks(spark, d):
    a = _cells(spark, d)
    return matrix.matmul_blocks(matrix.transpose(a), a, 128).select("r", "c", F.round("v").cast("long").alias("v")).where("v <> 0")


_SPARSE = """a AS (SELECT l_suppkey AS r, l_partkey AS c, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem WHERE l_discount > 0.05 GROUP BY 1, 2),
b AS (SELECT p_partkey AS r, 0 AS c, CAST(p_size AS BIGINT) AS v FROM part UNION ALL SELECT p_partkey, 1, CAST(floor(p_retailprice) AS BIGINT) FROM part)"""


def _sparse(spark, d):
    a = _table(spark, d, "lineitem").where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("r"), F.col("l_partkey").alias("c")).agg(F.sum(F.col("l_quantity").cast("long")).alias("v"))
    part = _table(spark, d, "part")
    side = lambda k, v: part.select(F.col("p_partkey").alias("r"), F.lit(k).cast("long").alias("c"), v.cast("long").alias("v"))
    return a, side(0, F.col("p_size")).unionByName(side(1, F.floor("p_retailprice")))


@query(f"WITH {_SPARSE}, m AS (SELECT a.r, b.c, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM a JOIN b ON a.c = b.r GROUP BY 1, 2) SELECT s_suppkey AS r, CAST(k.c AS BIGINT) AS c, coalesce(m.v, 0) AS v FROM supplier CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1) k LEFT JOIN m ON m.r = s_suppkey AND m.c = k.c")
def sparse_times_dense(spark, d):
    a, b = _sparse(spark, d)
    return matrix.sparse_times_dense(a, b, _table(spark, d, "supplier").select(F.col("s_suppkey").alias("r")))


@query(f"WITH {_SPARSE}, n AS (SELECT s_suppkey AS r, count(a.c) AS n FROM supplier LEFT JOIN a ON a.r = s_suppkey GROUP BY 1) SELECT r, CAST(coalesce(sum(n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, n FROM n")
def row_pointers(spark, d):
    return matrix.row_pointers(_sparse(spark, d)[0], _table(spark, d, "supplier").select(F.col("s_suppkey").alias("r")))


@query(f"WITH {CELLS} SELECT CAST(c AS BIGINT) AS r, r AS c, v FROM cells")
def transpose(spark, d):
    return matrix.transpose(_cells(spark, d))


def _dominant(spark, d):
    return _gram(spark, d).withColumn("v", F.col("v") + F.when(F.col("r") == F.col("c"), 10_000_000).otherwise(0))


@query(f"WITH {GRAM}, m AS (SELECT r, c, v + CASE WHEN r = c THEN 10000000 ELSE 0 END AS v FROM gram) SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, v FROM m WHERE v <> 0")
def lu_rebuild(spark, d):
    packed = matrix.lu(_dominant(spark, d), 64, 24)
    return matrix.rebuild(packed, 64).select("r", "c", F.round("v").cast("long").alias("v")).where("v <> 0")


_LU = f"""WITH RECURSIVE {GRAM}, m AS (SELECT r, c, CAST(v + CASE WHEN r = c THEN 10000000 ELSE 0 END AS DOUBLE) AS v FROM gram),
lu AS (SELECT 0 AS k, list(v ORDER BY r, c) AS a FROM m UNION ALL
SELECT k + 1, list_transform(a, lambda x, j: CASE WHEN (j - 1) % 64 <= k OR (j - 1) // 64 < k THEN x WHEN (j - 1) // 64 = k THEN x / a[k * 65 + 1] ELSE x - a[(j - 1) // 64 * 64 + k + 1] * (a[k * 64 + (j - 1) % 64 + 1] / a[k * 65 + 1]) END) FROM lu WHERE k < 64),
f AS (SELECT unnest(a) AS v, unnest(range(0, 4096)) AS j FROM lu WHERE k = 64)
SELECT CAST(j // 64 AS BIGINT) AS r, CAST(j % 64 AS BIGINT) AS c, CASE WHEN j // 64 >= j % 64 THEN round(v, 2) ELSE round(v, 8) END + 0.0 AS v FROM f"""


@query(_LU)
def lu_factors(spark, d):
    packed = matrix.lu(_dominant(spark, d), 64, 24)
    return packed.select("r", "c", (F.when(F.col("r") >= F.col("c"), F.round("v", 2)).otherwise(F.round("v", 8)) + 0.0).alias("v"))


_WEIGHTS = ((1, 2, 1), (0, -1, 3), (2, 1, -2))
#: The filter's cells as (dy, dx, w), its rows last first.
_TAPS = ", ".join(f"({i - 1}, {j - 1}, {w})" for i, row in enumerate(_WEIGHTS[::-1]) for j, w in enumerate(row))
_IMAGE = f"{CELLS}, im0 AS (SELECT r AS y, c AS x, ((v + 128) % 256 + 256) % 256 - 128 AS v FROM cells), ends AS (SELECT min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM im0)"


def _pass(k: int, taps: str) -> str:
    return f"im{k + 1} AS (SELECT o.y, o.x, CAST(((sum(n.v * w) + 128) % 256 + 256) % 256 - 128 AS BIGINT) AS v FROM im{k} o CROSS JOIN ends CROSS JOIN (VALUES {taps}) f(dy, dx, w) JOIN im{k} n ON n.y = greatest(y0, least(y1, o.y + dy)) AND n.x = greatest(x0, least(x1, o.x + dx)) GROUP BY 1, 2)"


def _image(spark, d):
    return _cells(spark, d).select(F.col("r").alias("y"), F.col("c").alias("x"), wrap_int8(F.col("v")).alias("v"))


@query(f"WITH {_IMAGE}, {_pass(0, _TAPS)} SELECT y, CAST(x AS BIGINT) AS x, CAST(v AS INTEGER) AS v FROM im1")
def convolve(spark, d):
    return stencil.convolve(_image(spark, d), _WEIGHTS, tile=48)


@query(f"WITH {_IMAGE}, {_pass(0, _TAPS)}, {_pass(1, _TAPS)} SELECT y, CAST(x AS BIGINT) AS x, CAST(v AS INTEGER) AS v FROM im2")
def convolve_rounds(spark, d):
    return stencil.convolve_rounds(_image(spark, d), _WEIGHTS, rounds=2, tile=64)


@query(f"WITH {_IMAGE}, {_pass(0, '(-1, 0, 1), (0, 0, 1), (1, 0, 1)')} SELECT y, CAST(x AS BIGINT) AS x, CAST(v AS INTEGER) AS v FROM im1")
def convolve_elliptical(spark, d):
    import numpy as np

    return stencil.convolve(_image(spark, d), stencil.elliptical(np.ones((3, 3), int), a=0.5, b=1.0))


def _grid(spark, d):
    return _cells(spark, d).select("r", "c", F.col("v").alias("re"), F.lit(0).alias("im"))


def _rounded(f: DataFrame, places: int) -> DataFrame:
    return f.select("r", "c", *((F.round(x, places) + 0.0).alias(x) for x in ("re", "im")))


_DFT_ROWS = "(SELECT r, CAST(k AS BIGINT) AS c, sum(v * cos(2 * pi() * (c * k % 64) / 64)) AS re, -sum(v * sin(2 * pi() * (c * k % 64) / 64)) AS im FROM cells, (SELECT unnest(range(0, 64)) AS k) x GROUP BY 1, 2)"


@query(f"WITH {CELLS} SELECT r, c, round(re, 2) + 0.0 AS re, round(im, 2) + 0.0 AS im FROM {_DFT_ROWS} f")
def fft_rows(spark, d):
    return _rounded(signal.fft_rows(_grid(spark, d)), 2)


@query(f"WITH {CELLS} SELECT r, c, round(re, 2) + 0.0 AS re, round(-im, 2) + 0.0 AS im FROM {_DFT_ROWS} f")
def fft_rows_reverse(spark, d):
    return _rounded(signal.fft_rows(_grid(spark, d), signal.REVERSE), 2)


@query(f"WITH {CELLS}, n AS (SELECT count(*) AS n FROM embeddings) SELECT CAST(k.r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(sum(v * cos(2 * pi() * (cells.r * k.r % n.n) / n.n))) + 0.0 AS re, round(-sum(v * sin(2 * pi() * (cells.r * k.r % n.n) / n.n))) + 0.0 AS im FROM cells, n, (SELECT vec_id AS r FROM embeddings) k GROUP BY 1, 2")
def fft_columns(spark, d):
    return _rounded(signal.fft_columns(_grid(spark, d)), 0)


_DFT_2D = f"""WITH {CELLS}, n AS (SELECT count(*) AS n FROM embeddings), f AS {_DFT_ROWS}, g AS (SELECT k.r, f.c,
sum(f.re * cos(2 * pi() * (f.r * k.r % n.n) / n.n) + f.im * sin(2 * pi() * (f.r * k.r % n.n) / n.n)) AS re, sum(f.im * cos(2 * pi() * (f.r * k.r % n.n) / n.n) - f.re * sin(2 * pi() * (f.r * k.r % n.n) / n.n)) AS im
FROM f, n, (SELECT vec_id AS r FROM embeddings) k GROUP BY 1, 2) SELECT CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, round(re) + 0.0 AS re, round(im) + 0.0 AS im FROM g"""


@query(_DFT_2D)
def fft_2d(spark, d):
    return _rounded(signal.fft_2d(_grid(spark, d)), 0)


@query(_DFT_2D)
def fft_2d_transposed(spark, d):
    return _rounded(signal.fft_2d_transposed(_grid(spark, d)), 0)


def _run_lines(spark, d):
    mode = F.col("i") % 7
    name = F.when(mode == 0, "Serial Task").otherwise(F.concat(F.lit("Parallel Task "), mode.cast("string")))
    return _events(spark, d).select((F.col("u") % 5).alias("run"), F.col("i").alias("sample"), F.concat(name, F.lit(" Execution Time = "), F.col("v").cast("string")).alias("line"))


_TIMES = f"{EV}, times AS (SELECT u % 5 AS run, i AS sample, CAST(i % 7 AS INTEGER) AS mode, CAST(v AS DOUBLE) AS seconds FROM ev)"
_FIRST = f"{_TIMES}, f AS (SELECT run, mode, {_cents('avg(seconds)')} AS mean, {_cents('quantile_cont(seconds, 0.5)')} AS median, count(*) AS samples FROM times GROUP BY 1, 2)"


@query(f"WITH {_TIMES} SELECT run, sample, mode, seconds FROM times")
def parse_run_times(spark, d):
    return logs.run_times(_run_lines(spark, d))


@query(f"WITH {_FIRST}, s AS (SELECT t.run, t.mode, {_cents('sqrt(avg((seconds - mean) * (seconds - mean)))')} AS sd FROM times t JOIN f ON f.run = t.run AND f.mode = t.mode GROUP BY 1, 2) SELECT f.run, f.mode, mean, median, samples, sd FROM f JOIN s ON f.run = s.run AND f.mode = s.mode")
def run_statistics(spark, d):
    return logs.run_statistics(logs.run_times(_run_lines(spark, d)), ["run", "mode"])


@query(f"WITH {_FIRST} SELECT run, " + ", ".join(f"max(mean) FILTER (WHERE mode = {k}) AS mode_{k}" for k in range(7)) + " FROM f GROUP BY run")
def run_report(spark, d):
    return logs.report(logs.run_statistics(logs.run_times(_run_lines(spark, d)), ["run", "mode"]), "run")


def _machine_lines(spark, d):
    n = _events(spark, d).groupBy((F.col("u") % 5).alias("run"), (F.col("i") % 6).alias("m"), (F.col("i") % 2).alias("model")).agg(F.count("*").alias("n"), F.count_if(F.col("v") % 3 == 0).alias("cpu"))
    return n.select("run", "model", F.format_string("Machine %d Subtasks %d CPU-Subtasks %d", "m", "n", "cpu").alias("line"))


_MACHINES = f"{EV}, mc AS (SELECT u % 5 AS run, i % 2 AS model, CAST(i % 6 AS INTEGER) AS machine, count(*) AS subtasks, count(*) FILTER (WHERE v % 3 = 0) AS cpu_subtasks FROM ev GROUP BY 1, 2, 3)"


@query(f"WITH {_MACHINES} SELECT run, model, machine, subtasks, cpu_subtasks FROM mc")
def parse_machine_counts(spark, d):
    return logs.machine_counts(_machine_lines(spark, d))


@query(f"WITH {_MACHINES} SELECT run, machine, CAST(100 AS DOUBLE) * subtasks / sum(subtasks) OVER (PARTITION BY run) AS share, CAST(100 AS DOUBLE) * cpu_subtasks / sum(subtasks) OVER (PARTITION BY run) AS cpu_share, CAST(100 AS DOUBLE) * (subtasks - cpu_subtasks) / sum(subtasks) OVER (PARTITION BY run) AS gpu_share FROM mc")
def distribution_profile(spark, d):
    return logs.distribution(logs.machine_counts(_machine_lines(spark, d)), "run")


@query(f"WITH {_MACHINES} SELECT machine, CAST(sum(subtasks) FILTER (WHERE model = 0) AS BIGINT) AS model_0, CAST(sum(subtasks) FILTER (WHERE model = 1) AS BIGINT) AS model_1 FROM mc GROUP BY machine")
def synthetic_load_profile(spark, d):
    return logs.load_profile(logs.machine_counts(_machine_lines(spark, d)), "model", [0, 1])


@query(f"WITH {EV}, n AS (SELECT u AS run, CAST(i % 4 AS INTEGER) AS device, count(*) AS subtasks FROM ev GROUP BY 1, 2) SELECT run, device, subtasks FROM n")
def parse_device_counts(spark, d):
    n = _events(spark, d).groupBy(F.col("u").alias("run"), (F.col("i") % 4).alias("dev")).agg(F.count("*").alias("n"))
    return logs.device_counts(n.select("run", F.format_string("Device %d Subtasks %d", "dev", "n").alias("line")))


@query(f"WITH {_TIMES}, a AS (SELECT run, mode, sum(seconds) AS s FROM times WHERE sample % 2 = 0 GROUP BY 1, 2), b AS (SELECT run, mode, sum(seconds) AS s FROM times WHERE sample % 2 = 1 GROUP BY 1, 2) SELECT a.run, a.mode, a.s AS dynamic, b.s AS static, a.s - b.s AS overhead FROM a JOIN b ON a.run = b.run AND a.mode = b.mode")
def steal_overhead(spark, d):
    times = logs.run_times(_run_lines(spark, d))
    total = lambda k: times.where(F.col("sample") % 2 == k).groupBy("run", "mode").agg(F.sum("seconds").alias("seconds"))
    return logs.steal_overhead(total(0), total(1), ["run", "mode"])


def _timeline(spark, d):
    number = F.expr("i div 4")
    head = F.format_string("Task [%d, %d]", "u", "number")
    body = F.format_string("Subtask %d%s %d %d", "i", F.when(F.col("v") % 11 == 0, "_Cancelled").otherwise(""), "v", F.col("v") + F.col("u"))
    return _events(spark, d).withColumn("number", number).select((F.col("i") % 4).alias("log"), "number", F.when(F.col("number") % 25 == 0, head).otherwise(body).alias("line"))


_LINES = f"""{EV}, ln AS (SELECT i % 4 AS log, i // 4 AS number, i, u, v FROM ev),
tl AS (SELECT *, last_value(CASE WHEN number % 25 = 0 THEN CAST(u AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY log ORDER BY number ROWS UNBOUNDED PRECEDING) AS host,
last_value(CASE WHEN number % 25 = 0 THEN CAST(number AS INTEGER) END IGNORE NULLS) OVER (PARTITION BY log ORDER BY number ROWS UNBOUNDED PRECEDING) AS task FROM ln),
sub AS (SELECT log, number, host, task, i AS subtask, v % 11 = 0 AS cancelled, CAST(v AS DOUBLE) AS "begin", CAST(v + u AS DOUBLE) AS "end" FROM tl WHERE number % 25 <> 0)"""


@query(f'WITH {_LINES} SELECT log, number, host, task, subtask, cancelled, "begin", "end" FROM sub')
def parse_timeline(spark, d):
    return logs.timeline(_timeline(spark, d), "log", "number")


@query(f'WITH {_LINES} SELECT host, min("begin") AS "begin", max("end") AS "end" FROM sub GROUP BY host')
def timeline_extents(spark, d):
    return logs.extents(logs.timeline(_timeline(spark, d), "log", "number"), ["host"])


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS number FROM customer")
def label_numbers(spark, d):
    return _table(spark, d, "customer").select("c_custkey", logs.number_in("c_name").alias("number"))


@query("SELECT c_custkey, row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_name) - 1 AS pos FROM customer")
def label_order(spark, d):
    return logs.numeric_sort(_table(spark, d, "customer").select("c_custkey", "c_name"), "c_name").select("c_custkey", "pos")


@query(f"WITH {EV} SELECT i, upper(t) AS event, CAST(v AS DOUBLE) AS accumulated, CAST(u AS DOUBLE) AS actual, CAST(v % 7 AS DOUBLE) AS overlapped FROM ev")
def parse_profiles(spark, d):
    line = F.format_string("%s => Accumulated Time: %ds; Actual Time = %ds; Overlapped Time = %ds", F.upper("t"), "v", "u", F.col("v") % 7)
    return logs.profiles(_events(spark, d).select("i", line.alias("line")))


@query(f"""WITH {EV}, e AS (SELECT t AS k, v AS z, 1 AS n FROM ev UNION ALL SELECT t AS k, v + u + 1 AS z, -1 AS n FROM ev), s AS (SELECT k, z, sum(n) AS n FROM e GROUP BY 1, 2),
w AS (SELECT k, sum(n) OVER (PARTITION BY k ORDER BY z ROWS UNBOUNDED PRECEDING) AS n, lead(z) OVER (PARTITION BY k ORDER BY z) - z AS dt FROM s)
SELECT k, CAST(sum(n * dt) AS BIGINT) AS accumulated, CAST(sum(CASE WHEN n > 0 THEN dt ELSE 0 END) AS BIGINT) AS actual, CAST(sum(n * dt) - sum(CASE WHEN n > 0 THEN dt ELSE 0 END) AS BIGINT) AS overlapped FROM w GROUP BY k""")
def overlapped_time(spark, d):
    spans = _events(spark, d).select(F.col("t").alias("k"), F.col("v").alias("b"), (F.col("v") + F.col("u") + 1).alias("e"))
    return logs.overlapped(spans, ["k"], "b", "e")


@query(f"WITH {EV} SELECT i, t FROM ev")
def chart_columns(spark, d):
    return logs.chart_table(_events(spark, d), [0, 1, 2], skip=[1])


@query(f"WITH {_TIMES}, p AS (SELECT *, row_number() OVER (PARTITION BY run, mode ORDER BY seconds, sample) AS p, count(*) OVER (PARTITION BY run, mode) AS n FROM times) SELECT run, sample, mode, seconds FROM p WHERE p = (n + 1) // 2")
def median_samples(spark, d):
    return logs.median_sample(logs.run_times(_run_lines(spark, d)), ["run", "mode"], "seconds", "sample")


_CUBE = f"{_TIMES}, cube AS (SELECT run, mode, sample % 3 AS policy, min(seconds) AS best, avg(seconds) AS mean, count(*) AS samples FROM times GROUP BY 1, 2, 3)"


def _cube(spark, d):
    return logs.result_cube(logs.run_times(_run_lines(spark, d)).withColumn("policy", F.col("sample") % 3), ["run"], ["mode", "policy"], "seconds")


@query(f"WITH {_CUBE} SELECT run, mode, policy, best, mean, samples FROM cube")
def benchmark_cube(spark, d):
    return _cube(spark, d)


@query(f"WITH {_CUBE} SELECT policy, min(best) AS best, max(best) AS worst, count(*) AS settings FROM cube GROUP BY policy")
def report_panel(spark, d):
    return logs.panel(_cube(spark, d), ["policy"])


@query(f"WITH {EV} SELECT i, u, t, v FROM ev")
def place_rows(spark, d):
    return arrays.place(_events(spark, d), "u")


def _random(*numbers: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(numbers)})), 1, 8) AS BIGINT)"


@query(f"""WITH c AS (SELECT CAST(count(*) AS BIGINT) AS n FROM customer), p AS (SELECT unnest(range(1, n + 1)) AS page FROM c),
k AS (SELECT page, unnest(range(1, CAST(floor({_random('1', 'page', '0')} / 4294967296.0::DOUBLE * 21) AS BIGINT) + 1)) AS k FROM p),
u AS (SELECT page, {_random('1', 'page', '1', 'k')} / 4294967296.0::DOUBLE AS kind, {_random('1', 'page', '2', 'k')} / 4294967296.0::DOUBLE AS pick FROM k),
h AS (SELECT page, n, CAST(page - 1 + floor((pick * 2 - 1) * CASE WHEN kind < 0.9 THEN greatest(1, n // 1000) WHEN kind < 0.99 THEN greatest(1, n // 100) ELSE n END) AS BIGINT) AS hit FROM u, c)
SELECT page AS src, (hit % n + n) % n + 1 AS dst FROM h""")
def web_graph(spark, d):
    pages = _table(spark, d, "customer").count()
    return webgraph.edges(webgraph.generate(spark, pages, seed=1))


@query(f"WITH i AS (SELECT unnest(range(0, count(*))) AS i FROM part) SELECT i, {_random('1', 'i')} >> 1 AS v FROM i")
def random_array(spark, d):
    return arrays.random_ints(spark, _table(spark, d, "part").count(), seed=1)


@query(f"WITH i AS (SELECT unnest(range(0, count(*))) AS i FROM supplier) SELECT i // 7 AS r, i % 7 AS c, {_random('3', 'i // 7', 'i % 7')} >> 1 AS v FROM i WHERE i < (SELECT count(*) // 7 * 7 FROM supplier)")
def random_plane(spark, d):
    return arrays.random_plane(spark, _table(spark, d, "supplier").count() // 7, 7, seed=3)


@query("WITH i AS (SELECT unnest(range(0, count(*))) AS i FROM part) SELECT i, i * 3 AS v FROM i")
def create_linear(spark, d):
    """A space made, read whole and released."""
    space = arrays.linear(spark, _table(spark, d, "part").count(), F.col("i") * 3).cache()
    rows = arrays.fetch(space, 1 << 22)
    arrays.release(space)
    return spark.createDataFrame(rows, space.schema)


@query("WITH i AS (SELECT unnest(range(0, count(*) * 4)) AS i FROM nation) SELECT i // 4 AS r, i % 4 AS c, i // 4 * 10 + i % 4 AS v FROM i")
def create_plane(spark, d):
    return arrays.plane(spark, _table(spark, d, "nation").count(), 4, F.col("r") * 10 + F.col("c"))


@query("SELECT n_nationkey AS number, n_name AS content, CAST(octet_length(encode(n_name)) AS BIGINT) AS length FROM nation")
def map_files(spark, d):
    """A file for each nation, written and mapped together."""
    at = f"{durable.scratch_dir(spark)}/nations-{uuid.uuid4().hex}"
    files.write_files(_table(spark, d, "nation").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(".txt")).alias("name"), F.encode("n_name", "UTF-8").alias("content")), at)
    return files.map_files(spark, at, "*.txt").select(F.regexp_extract("path", r"([0-9]+)\.txt$", 1).cast("int").alias("number"), F.decode("content", "UTF-8").alias("content"), "length")


@query("SELECT CAST(s_suppkey AS BIGINT) AS number, s_name AS line FROM supplier")
def map_file(spark, d):
    """One file of all suppliers' lines, mapped and split."""
    at = f"{durable.scratch_dir(spark)}/suppliers-{uuid.uuid4().hex}"
    lines = _table(spark, d, "supplier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda s: F.concat_ws("|", s["s_suppkey"], s["s_name"])), "\n").alias("all"))
    files.write_files(lines.select(F.lit("suppliers.txt").alias("name"), F.encode("all", "UTF-8").alias("content")), at)
    parts = F.split("line", r"\|")
    return files.read_lines(spark, f"{at}/suppliers.txt").select(parts[0].cast("bigint").alias("number"), parts[1].alias("line"))


@query(f"WITH {EDGES}, s AS (SELECT max(src) + 1 AS pages FROM edges) SELECT DISTINCT src + 1 AS src, CAST(dst % pages + 1 AS BIGINT) AS dst FROM edges, s")
def web_dump(spark, d):
    """The links as a dump: a header and files of fixed records, written and read back."""
    edges = _edges(spark, d)
    pages = edges.agg(F.max("src")).first()[0] + 1
    links = edges.select((F.col("src") + 1).alias("src"), (F.col("dst") % pages + 1).alias("dst")).distinct().groupBy(F.col("src").alias("page")).agg(F.array_sort(F.collect_list("dst")).alias("outlinks"))
    at = f"{durable.scratch_dir(spark)}/web-{uuid.uuid4().hex}"
    webgraph.write_dump(links, at, pages, 100)
    found = webgraph.read_metadata(spark, f"{at}/metadata")
    return webgraph.edges(webgraph.read_pages(spark, f"{at}/pages", found)).select("src", "dst")


@query(f"WITH {CELLS} SELECT CAST(r AS BIGINT) AS y, CAST(c // 3 AS BIGINT) AS x, CAST(c % 3 AS INTEGER) AS channel, CAST(((v + 128) % 256 + 256) % 256 - 128 AS INTEGER) AS v FROM cells WHERE c < 63")
def bitmap(spark, d):
    """Vectors as the pixels of bitmaps of 64 rows, written and read back."""
    pixels = _cells(spark, d).where("c < 63").select(F.col("r").alias("y"), F.expr("c div 3").alias("x"), (F.col("c") % 3).alias("k"), wrap_int8(F.col("v")).alias("v"))
    at = f"{durable.scratch_dir(spark)}/images-{uuid.uuid4().hex}"
    images.write_bmp(pixels.groupBy("y", "x").agg(*(F.max(F.when(F.col("k") == i, F.col("v"))).alias(n) for i, n in enumerate("rgb"))), at, 64)
    found = images.read_bmp(spark, at).withColumn("y", F.col("y") + 64 * F.regexp_extract("path", r"([0-9]+)\.bmp$", 1).cast("bigint"))
    return found.select("y", "x", F.posexplode(F.array("r", "g", "b")).alias("channel", "v")).select("y", "x", "channel", F.col("v").cast("int").alias("v"))


@query(f"WITH {EV} SELECT t, CAST(sum(2 * v) AS BIGINT) AS v, CAST(row_number() OVER (ORDER BY t) - 1 AS BIGINT) AS pos FROM ev WHERE u < 900 GROUP BY t")
def submit_task(spark, d):
    """A task with every callback: its rows chosen, mapped, reduced and redistributed; registered,
    submitted, waited for, timed and released."""
    done = []
    key = tasks.register(f"double-{uuid.uuid4().hex}", tasks.Callbacks(
        data_distribution=lambda df: df.where("u < 900"), subtask=lambda df: df.select("t", (F.col("v") * 2).alias("v")),
        data_reduction=lambda df: reduce.reduce(df, ["t"], "v", "add"), data_redistribution=lambda df: redistribute.positions(df, ["t"]),
        completion=lambda df, user: done.append((user, df.count()))))
    task = tasks.submit(key, _events(spark, d), user_data="done", timeout=3600)
    out = task.result()
    tasks.release(key)
    assert done and done[0][0] == "done" and task.seconds > 0 and tasks.hosts(spark) >= 1
    return out
