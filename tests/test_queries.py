"""Every array, matrix, graph and log query against its SQL."""

import datetime
import math

import duckdb
import pytest

from meshframe import queries

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v.isoformat() if isinstance(v, datetime.date) else v


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sql, name):
    got = queries.QUERIES[name](spark, SMALL)
    want = sql.sql(queries.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["radix_sort_rounds", "msd_round"])
def test_sorts_of_all_32_bits(spark, tmp_path, name):
    r = spark.read.parquet(f"{SMALL}/events.parquet")
    r.withColumn("value", r["value"] * 50_000).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), c.sql(queries.SQL[name])
    assert c.sql("SELECT max(value) FROM events").fetchall()[0][0] * 100 > 1 << 24
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
