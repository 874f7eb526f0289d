"""Every query with an oracle gives the rows that DuckDB gives for its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from proofloom.plans import registry

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6g}"
    return str(value)


#: Queries that SQL cannot express, and the test that holds their results against a plain version or a golden case.
OTHERWISE = {
    "vector_digests": "test_digests_reproduce", "bootstrap_ci": "tests/test_golden.py",
}


#: Queries without rows on the smallest tables: facts and phrases that no text has, and checks that find nothing wrong.
EMPTY = {
    "composite_topk", "context_packing", "cover_density", "cumulative_facts", "lexical_match_phrase", "null_controls", "ranking_competitors", "reply_problems", "stemmed_match_phrase", "version_violations",
}


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(ORACLES) == set(OTHERWISE)


def test_digests_reproduce(spark):
    import hashlib
    import struct

    import pyarrow.parquet as pq

    rows = pq.read_table(f"{DATA}/embeddings.parquet").to_pylist()
    got = {r["vec_id"]: r["vector_sha256"] for r in QUERIES["vector_digests"](spark, DATA).collect()}
    assert got == {r["vec_id"]: hashlib.sha256(struct.pack(f"<{len(r['embedding'])}f", *r["embedding"])).hexdigest() for r in rows}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert bool(got) is (name not in EMPTY)
    assert got == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall())
