"""The prefix-filter join against every pair, its plan on a common word, and leaks between splits."""

import random

import pytest
from pyspark.sql import functions as F

from proofloom.operators import set_join


def rows_of(seed, n):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randrange(1, 14)) for _ in range(n // 3)]
    out = [(k, ["the", *(f"w{w}" for w in b)]) for k, b in enumerate(base)]
    for k, b in enumerate(base):
        changed = [w for w in b if rng.random() < 0.8] + [rng.randrange(60)]
        out += [(1000 + k, ["the", *(f"w{w}" for w in changed)]), (2000 + k, out[k][1][::-1] + ["the"])]
    return out + [(5000, []), (5001, []), (5002, None), (5003, [None, "the"])]


def plain(rows, threshold):
    classes = {}
    for k, words in rows:
        if words is not None:
            classes.setdefault(frozenset(w for w in words if w is not None), []).append(k)
    named = sorted((min(ids), own) for own, ids in classes.items())
    return {(i, j): len(a & b) / len(a | b) for i, a in named for j, b in named if i < j and a | b and len(a & b) / len(a | b) >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_against_every_pair(spark, threshold):
    rows = rows_of(3, 150)
    df = spark.createDataFrame(rows, "question_id long, words array<string>")
    distinct = set_join.classes(df, "question_id", "words").select("class", "words").distinct()
    got = {(r["class_a"], r["class_b"]): r["jaccard"] for r in set_join.similar_classes(distinct, threshold).collect()}
    assert got == pytest.approx(plain(rows, threshold))


def test_a_common_word_pairs_nothing(spark):
    """400 sets share one word and nothing else: no two of them meet."""
    df = spark.createDataFrame([(k, ["the", *(f"x{k}-{j}" for j in range(9))]) for k in range(400)], "class long, words array<string>")
    first = set_join.prefixes(df, 0.5)
    assert first.filter(F.col("word") == "the").count() == 0
    assert set_join.candidates(first, 0.5).count() == 0


def test_leaks(spark):
    rows = [(1, "DEV", ["a", "b"]), (2, "HELD_OUT", ["b", "a"]), (3, "DEV", ["x", "y", "z"]), (4, "DEV", ["x", "y", "q"]), (5, "HELD_OUT", ["x", "y"]), (6, "HELD_OUT", ["m"])]
    df = spark.createDataFrame(rows, "question_id long, split string, words array<string>")
    got = sorted((r["class_a"], r["class_b"], round(r["jaccard"], 3), r["n_a"], r["n_b"]) for r in set_join.leaks(df, 0.5).collect())
    assert got == [(1, 1, 1.0, 2, 2), (3, 5, 0.667, 1, 1), (4, 5, 0.667, 1, 1)]


def test_thresholds(spark):
    df = spark.createDataFrame([(1, ["a"])], "class long, words array<string>")
    for wrong in (0, 1.5):
        with pytest.raises(ValueError):
            set_join.similar_classes(df, wrong)
