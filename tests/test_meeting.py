"""Joins on the rarest word, the query language and cover density against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from proofloom.operators import diagnostics, retrieval
from proofloom.operators.meeting import rarest_meetings

WORDS = ["alpha", "beta", "gamma", "delta", "the", "of"]


def texts_of(seed, n):
    rng = random.Random(seed)
    return [(k, [rng.choice(WORDS) for _ in range(rng.randrange(0, 9))]) for k in range(n)]


def test_rarest_word_loses_no_pair(spark):
    texts, needles = texts_of(1, 60), texts_of(2, 20)
    a = spark.createDataFrame(needles, "needle long, words array<string>")
    b = spark.createDataFrame(texts, "id long, words array<string>")
    met = {(r["needle"], r["id"]) for r in rarest_meetings(a, ["needle"], b, ["id"]).collect()}
    whole = {(i, j) for i, x in needles for j, y in texts if x and set(x) <= set(y)}
    assert whole <= met
    assert all(set(dict(needles)[i]) & set(dict(texts)[j]) for i, j in met)


def plain_match(query, words):
    """Conjunction of groups of alternatives; units are (negated, phrase)."""
    return all(any((any(words[k : k + len(p)] == p for k in range(len(words) - len(p) + 1))) != no for no, p in group) for group in query)


QUERIES = [
    ("alpha beta", [[(False, ["alpha"])], [(False, ["beta"])]]),
    ("alpha or beta", [[(False, ["alpha"]), (False, ["beta"])]]),
    ('"alpha beta"', [[(False, ["alpha", "beta"])]]),
    ("alpha -the", [[(False, ["alpha"])], [(True, ["the"])]]),
    ("-the", [[(True, ["the"])]]),
    ('gamma or "of the" -delta', [[(False, ["gamma"]), (False, ["of", "the"])], [(True, ["delta"])]]),
    ("alpha or -beta", [[(False, ["alpha"]), (True, ["beta"])]]),
    ("missing", [[(False, ["missing"])]]),
]


def test_matches_equal_plain_reading(spark):
    texts = texts_of(3, 80)
    chunks = spark.createDataFrame([(k, k, 0, "i", "en", w) for k, w in texts], "chunk_id long, document_id long, chunk_index int, institution_id string, language string, words array<string>")
    asked = spark.createDataFrame([(q, 0, "i", "en", text) for q, (text, _) in enumerate(QUERIES)], "question_id long, turn int, institution_id string, language string, input string")
    got = sorted((r["question_id"], r["chunk_id"]) for r in retrieval.match_candidates(asked, chunks).collect())
    assert got == sorted((q, k) for q, (_, units) in enumerate(QUERIES) for k, w in texts if plain_match(units, w))


def plain_density(terms, words):
    """Shortest stretches that hold all terms, each a tenth over one more than its other words."""
    found = []
    for i in range(len(words)):
        for j in range(i, len(words)):
            if set(terms) <= set(words[i : j + 1]):
                found.append((i, j))
                break
    shortest = [(i, j) for i, j in found if not any((i, j) != (a, b) and i <= a and b <= j for a, b in found)]
    return sum(0.1 / (1 + sum(w not in terms for w in words[i : j + 1])) for i, j in shortest)


def test_cover_density_equals_plain_search(spark):
    texts = texts_of(4, 60)
    asked = [(0, ["alpha"]), (1, ["alpha", "beta"]), (2, ["gamma", "the", "of"])]
    chunks = spark.createDataFrame([(k, "i", "en", w, list(range(len(w)))) for k, w in texts], "chunk_id long, institution_id string, language string, keys array<string>, positions array<int>")
    questions = spark.createDataFrame([(q, "i", "en", t) for q, t in asked], "question_id long, institution_id string, language string, terms array<string>")
    got = {(r["question_id"], r["chunk_id"]): r["raw_score"] for r in retrieval.cover_worth(retrieval.places_of_terms(retrieval.joint_pairs(questions, chunks), questions, chunks), questions).collect()}
    want = {(q, k): plain_density(t, w) for q, t in asked for k, w in texts if set(t) <= set(w)}
    assert got.keys() == want.keys()
    assert all(got[key] == pytest.approx(want[key]) for key in want)


def test_places_overlap_and_stay_within_words(spark):
    texts = spark.createDataFrame([(1, "a b a b a xa b")], "document_id long, normalized string")
    facts = spark.createDataFrame([(1, "F1", "a b a", 1), (1, "F2", "b", 1)], "question_id long, fact string, needle string, document_id long")
    rows = diagnostics.occurrences(facts, texts).orderBy("fact", "start").select("fact", "start").collect()
    assert [tuple(r) for r in rows] == [("F1", 0), ("F1", 4), ("F2", 2), ("F2", 6), ("F2", 13)]


def test_covering_sets_have_no_cap(spark):
    rows = [(1, 1, k, "F1") for k in range(40)] + [(1, 1, 50, "F2")]
    presence = spark.createDataFrame(rows, "question_id long, document_id long, chunk_index int, fact string")
    facts = spark.createDataFrame([(1, "F1"), (1, "F2")], "question_id long, fact string")
    found = diagnostics.covering_sets(presence, facts).first()
    assert found["complete"] and found["sets"] == [[0, 50]]
    assert presence.select(F.count(F.lit(1))).first()[0] == 41
