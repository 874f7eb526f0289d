"""Tiled whitening against numpy on the whole table, and odd rows."""

from fractions import Fraction

import numpy as np
import pytest

from proofloom.llm import whitening


def plain(vectors, count=16):
    """n, exact deviations of the rows, e, absolute whitened values and trace, all from one matrix in extended precision."""
    x = [tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v) for v in vectors]
    fit = sorted(set(x))
    n = len(fit)
    sums = [sum(c) for c in zip(*fit)]
    deviations = [sum((n * a - s) ** 2 for a, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in fit])
    values, found = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:count]
    rows = np.array([[float(Fraction(n * a - s, n)) for a, s in zip(v, sums)] for v in x])
    return n, deviations, values[order], rows @ found[:, order], float(np.trace(centred.T @ centred / n))


def table(spark, vectors):
    return spark.createDataFrame([(i, [None if c is None else float(c) for c in v] if v is not None else None, 1.0) for i, v in vectors], "vec_id long, embedding array<float>, n double")


@pytest.mark.parametrize("dims,tile", [(5, 2), (20, 32), (20, 7), (33, 16)])
def test_against_numpy(spark, dims, tile):
    rng = np.random.default_rng(dims)
    base = rng.normal(size=(400, dims)) * rng.uniform(0.1, 3, dims)
    vectors = list(enumerate(np.concatenate([base, base[:60], base[:1].repeat(200, axis=0)]).astype(np.float32)))
    got = whitening.whiten(table(spark, vectors).repartition(3), tile=tile).collect()
    n, deviations, values, projected, trace = plain([v for _, v in vectors])
    count = min(16, dims)
    assert len(got) == len(vectors) * count
    by = {}
    for r in got:
        by.setdefault(r["component"], {})[r["vec_id"]] = r
    for k in range(1, count + 1):
        own = by[k]
        assert {r["n"] for r in own.values()} == {n}
        assert [own[i]["deviation"] for i, _ in vectors] == deviations
        assert all(abs(r["explained"] - values[k - 1] / trace) < 1e-9 for r in own.values())
        want, have = projected[:, k - 1] / np.sqrt(values[k - 1]), np.array([own[i]["whitened"] for i, _ in vectors])
        assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7  # one sign for all rows
    assert len({r["identity_error"] for r in got}) == 1
    assert got[0]["identity_error"] < 1e-9


def test_dropped_rows(spark):
    rng = np.random.default_rng(1)
    good = [(k, rng.normal(size=3)) for k in range(50)]
    bad = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [1.0, 2.0]), (105, [])]
    got = whitening.whiten(table(spark, good + bad + [(None, good[0][1]), (0, good[0][1])])).collect()
    assert {r["vec_id"] for r in got} == {None, *range(50)}
    assert len(got) == 52 * 3
    assert {r["n"] for r in got} == {50}


def test_without_variance(spark):
    one = whitening.whiten(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one] == [(1, 0, None, None, None)] * 4
    flat = whitening.whiten(table(spark, [(k, [float(k), 5.0, 2.0 * k]) for k in range(9)])).collect()
    by = {(r["vec_id"], r["component"]): r for r in flat}
    assert all(by[k, 1]["whitened"] is not None and by[k, 2]["whitened"] is None and by[k, 3]["whitened"] is None for k in range(9))
    assert by[0, 1]["identity_error"] < 1e-9
    assert abs(by[0, 1]["explained"] - 1) < 1e-12
    assert whitening.whiten(table(spark, [(1, None)])).collect() == []
    assert whitening.whiten(table(spark, [(1, [1.0])]).limit(0)).collect() == []


def test_large_entries(spark):
    """Sums and deviations stay exact where 64 bits do not hold them; a deviation beyond them is null."""
    vectors = [(1, [1e15, 0.0]), (2, [-3e15, 1.0]), (3, [3e38, 0.0]), (4, [-3e38, 0.5]), (5, [0.0, 0.25])]
    got = whitening.whiten(table(spark, vectors)).collect()
    assert {r["deviation"] for r in got} == {None}
    some = [(k, [float(1 << 20) * k, 1.0]) for k in range(3)]
    assert {(r["vec_id"], r["deviation"]) for r in whitening.whiten(table(spark, some)).collect()} == set(enumerate(plain([v for _, v in some])[1]))


def test_row_blocks(spark):
    """Many small row blocks give the same components as one."""
    rng = np.random.default_rng(4)
    vectors = list(enumerate(rng.normal(size=(300, 12))))
    first = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(table(spark, vectors)).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        second = {(r["vec_id"], r["component"]): abs(r["whitened"]) for r in whitening.whiten(table(spark, vectors)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert first.keys() == second.keys()
    assert max(abs(first[k] - second[k]) for k in first) < 1e-9
