"""Dominance between items: comparisons, summaries, and skylines of any block size against a plain loop."""

import random

import pytest

from proofloom.operators import dominance

S = ["a", "b", "c"]


def plain(rows):
    beats = lambda x, y: all(p >= q for p, q in zip(x, y)) and any(p > q for p, q in zip(x, y))
    return sorted((g, i) for g, i, *v in rows if not any(h == g and beats(w, v) for h, _, *w in rows))


@pytest.mark.parametrize("block", [4, 25, 1000])
def test_skyline(spark, block):
    draw = random.Random(block)
    rows = [(n % 3 if n % 2 else 0, n, *(float(draw.randrange(6)) for _ in S)) for n in range(150)]  # one group has most rows; ties abound
    df = spark.createDataFrame(rows, "g int, i int, a double, b double, c double")
    assert sorted(map(tuple, dominance.skyline(df, "g", "i", S, block).collect())) == plain(rows)


def test_skyline_of_odd_rows(spark):
    schema = "g int, i int, a double, b double, c double"
    assert dominance.skyline(spark.createDataFrame([], schema), "g", "i", S).count() == 0
    rows = [(1, 1, None, 1.0, 1.0), (1, 2, 0.0, 1.0, 1.0), (1, 3, None, 2.0, 1.0), (2, 4, 1.0, 1.0, 1.0), (2, 5, 1.0, 1.0, 1.0)]
    got = sorted(map(tuple, dominance.skyline(spark.createDataFrame(rows, schema), "g", "i", S).collect()))
    assert got == [(1, 2), (1, 3), (2, 4), (2, 5)]


def test_comparisons(spark):
    schema = "question_id int, item string, rank int, score double, a double, b double, c double"
    items = [(1, "x", 1, 9.0, 0.9, 0.5, 0.2), (1, "y", 2, 8.0, 0.1, 0.9, 0.3), (1, "t", 3, 5.0, 0.1, 0.5, 0.4), (2, "x", 1, 9.0, 0.9, 0.5, 0.4 - 1e-12), (2, "t", 2, 5.0, 0.9, 0.5, 0.4), (2, "z", 3, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(items, schema)
    rows = dominance.compare(df.filter("item = 't'"), df, S)
    assert {(r["question_id"], r["item"]): (r["favours"], r["dominated"], r["score_gap"]) for r in rows.collect()} == {(1, "x"): (4, False, 4.0), (1, "y"): (4, False, 3.0), (2, "x"): (0, True, 4.0)}
    got = {r["question_id"]: (r["n_competitors"], r["n_dominating"], r["common_signals"], r["diagnosis"]) for r in dominance.summary(rows, S).collect()}
    assert got == {1: (2, 0, "c", "reweightable"), 2: (1, 1, "", "insufficient_signals")}
