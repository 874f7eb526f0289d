"""The metric index against every pair, its pruning, scopes, ties and odd vectors."""

import math
import random

import numpy as np
import pytest

from proofloom.operators import dense, metric_index


def plain(queries, vectors, k):
    """(query_id, vec_id, rank) over all pairs: cosine added up in order, nulls last, ties to the smaller id."""

    def cosine(a, b):
        if a is None or b is None:
            return None
        dot = x = y = 0.0
        for p, q in zip(a, b):
            dot, x, y = dot + p * q, x + p * p, y + q * q
        return dot / (math.sqrt(x) * math.sqrt(y)) if x > 0 and y > 0 else None

    out = []
    for i, scope, q in queries:
        own = [(cosine(v, q), j) for j, s, v in vectors if s == scope]
        own.sort(key=lambda c: (c[0] is None, -(c[0] or 0), c[1]))
        out += [(i, j, rank) for rank, (_, j) in enumerate(own[:k], 1)]
    return sorted(out)


def tables(spark, queries, vectors):
    kind = "long, scope string, embedding array<double>"
    return spark.createDataFrame(queries, f"query_id {kind}"), spark.createDataFrame(vectors, f"vec_id {kind}")


def search(spark, queries, vectors, k, **settings):
    asked, own = tables(spark, queries, vectors)
    index = metric_index.build(own, ["vec_id"], "scope", **settings)
    return sorted((r["query_id"], r["vec_id"], r["rank"]) for r in metric_index.nearest(asked, index, k, "scope").collect())


def clustered(seed, n, dims=6, clusters=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, dims))
    return [list(map(float, centres[k % clusters] + rng.normal(size=dims) * 0.05)) for k in range(n)]


@pytest.mark.parametrize("k", [1, 5, 40])
@pytest.mark.parametrize("settings", [{}, {"pivots": 1}, {"pivots": 30, "chunk": 7}])
def test_against_every_pair(spark, k, settings):
    rows = clustered(1, 300)
    vectors = [(i, f"s{i % 3}", v) for i, v in enumerate(rows)]
    queries = [(1000 + i, f"s{i % 4}", v) for i, v in enumerate(clustered(2, 24))]  # scope s3 has no vectors
    assert search(spark, queries, vectors, k, **settings) == plain(queries, vectors, k)


def test_ties_repeats_and_vectors_without_direction(spark):
    rng = random.Random(3)
    base = [[1.0, 0.0, 0.5], [0.0, 1.0, 0.0], [0.3, 0.3, 0.3]]
    vectors = [(i, "a", rng.choice(base)) for i in range(90)] + [(900, "a", [0.0] * 3), (901, "a", None), (902, "b", [0.0] * 3), (903, "b", [2.0, 0.0, 1.0]), (904, "b", None)]
    queries = [(1, "a", base[0]), (2, "b", base[0]), (3, "a", [0.0] * 3), (4, "b", None), (5, "none", base[1])]
    for settings in ({}, {"pivots": 3, "chunk": 4}):
        assert search(spark, queries, vectors, 4, **settings) == plain(queries, vectors, 4)


def test_empty_tables(spark):
    assert search(spark, [(1, "a", [1.0])], [], 3) == []
    assert search(spark, [], [(1, "a", [1.0])], 3) == []


def test_convenience_and_other_columns(spark):
    own = spark.createDataFrame([(1, "x", [1.0, 0.0]), (2, "y", [0.0, 1.0])], "vec_id long, label string, embedding array<float>")
    asked = spark.createDataFrame([(7, [0.9, 0.1])], "query_id long, embedding array<float>")
    got = dense.nearest(asked, own, 5, ["vec_id"]).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["label"], r["rank"]) for r in got] == [(7, 1, "x", 1), (7, 2, "y", 2)]


def compared(spark, n):
    """Vectors that both passes compare with the queries, by the cells they ask."""
    asked, own = tables(spark, [(k, "a", v) for k, v in enumerate(clustered(5, 20))], [(k, "a", v) for k, v in enumerate(clustered(5, n, clusters=n // 50))])
    index = metric_index.build(own, ["vec_id"], "scope")
    from pyspark.sql import functions as F

    first, second, _ = metric_index.routes(asked.select("query_id", "embedding", F.col("scope").alias("__scope")), index, 5)
    sizes = index.chunks.groupBy("__scope", "__cell").agg(F.sum(F.size("__rows")).alias("n"))
    return first.unionByName(second).join(sizes, ["__scope", "__cell"]).agg(F.sum("n")).first()[0]


def test_whole_cells_are_skipped(spark):
    """Far fewer than all pairs are compared, and eight times the vectors take less than four times the comparisons."""
    small, large = compared(spark, 1000), compared(spark, 8000)
    assert small < 0.5 * 20 * 1000
    assert large < 0.2 * 20 * 8000
    assert large < 4 * small


def test_cells_meet_by_an_equi_join(spark):
    asked, own = tables(spark, [(1, "a", [1.0, 0.0])], [(k, "a", [1.0, float(k)]) for k in range(50)])
    plan = metric_index.nearest(asked, metric_index.build(own, ["vec_id"], "scope"), 3, "scope")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
