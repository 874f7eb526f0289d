"""Lexemes, posting lists and the pruned top-k of alternatives against plain versions."""

import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from proofloom.functions import stems
from proofloom.operators import postings, retrieval


def texts(seed, n):
    rng = random.Random(seed)
    common = ["running", "the", "house", "of"]
    return [(k, [rng.choice(common) if rng.random() < 0.6 else f"word{rng.randrange(60)}s" for _ in range(rng.randrange(1, 40))]) for k in range(n)]


def tables(spark, rows, asked):
    chunks = spark.createDataFrame([(k, k // 3, k % 3, f"i{k % 2}", "en", w) for k, w in rows], "chunk_id long, document_id long, chunk_index int, institution_id string, language string, words array<string>")
    questions = spark.createDataFrame([(q, f"i{q % 2}", "en", w) for q, w in asked], "question_id long, institution_id string, language string, lexemes array<string>")
    return chunks, postings.with_lexemes(questions, "lexemes")


def plain_top(rows, asked, k):
    out = []
    for q, words in asked:
        wanted = {stems.lexeme(w, "english") for w in words} - {""}
        found = [(-sum(stems.lexeme(w, "english") in wanted for w in own), i // 3, i % 3, i) for i, own in rows if i % 2 == q % 2]
        out += [(q, i, -worth, rank) for rank, (worth, _, _, i) in enumerate(sorted(f for f in found if f[0])[:k], 1)]
    return sorted(out)


ASKED = [(0, ["runs", "word3", "word59"]), (1, ["house", "houses", "running"]), (2, ["the", "of"]), (3, ["nowhere"]), (4, ["word1", "word2", "word5", "house", "run"]), (5, ["word7"])]


@pytest.mark.parametrize("block", [postings.BLOCK, 4])
@pytest.mark.parametrize("k", [1, 8])
def test_top_alternatives(spark, block, k):
    rows = texts(1, 200)
    chunks, asked = tables(spark, rows, ASKED)
    got = postings.top_alternatives(asked, postings.build(chunks, block), k)
    assert sorted((r["question_id"], r["chunk_id"], r["worth"], r["rank"]) for r in got.collect()) == plain_top(rows, ASKED, k)


def test_frequent_words_are_not_read(spark):
    """A rare word with high impact makes the long list of a frequent one needless: its postings are never read, the answer is the same."""
    rows = [(k, ["house"]) for k in range(0, 4000, 2)] + [(k, ["rare"] * 9) for k in range(4000, 4040, 2)]
    chunks, asked = tables(spark, rows, [(0, ["house", "rare"])])
    index = postings.build(chunks)
    every, read = postings.levels(asked, index, 8)
    assert every.agg(F.sum("n")).first()[0] == 2020
    assert read.agg(F.sum("n")).first()[0] == 20
    got = postings.top_alternatives(asked, index, 8)
    assert sorted((r["question_id"], r["chunk_id"], r["worth"], r["rank"]) for r in got.collect()) == plain_top(rows, [(0, ["house", "rare"])], 8)


def test_left_out_levels_stay_below_reach():
    rows = pd.DataFrame({"question_id": 1, "institution_id": "i", "language": "en", "lexeme": list("aaabb"), "impact": [1, 2, 3, 1, 2], "n": [100, 10, 1, 50, 5], "most": [1, 2, 3, 1, 2], "reach": 4})
    kept = postings.levels_to_read(rows)
    gone = rows.merge(kept, how="left", on=["lexeme", "impact"], indicator=True).query("_merge == 'left_only'")
    assert gone.groupby("lexeme")["most"].max().sum() < 4
    assert set(map(tuple, gone[["lexeme", "impact"]].to_numpy())) >= {("a", 1), ("b", 1)}
    assert len(postings.levels_to_read(rows.assign(reach=0))) == 5


def test_posting_lists(spark):
    chunks, _ = tables(spark, [(0, ["the", "runs", "house", "running"]), (2, ["run"]), (1, ["run"])], ASKED)
    blocks = postings.build(chunks).blocks.collect()
    found = {(r["institution_id"], r["lexeme"], r["impact"], e["chunk_id"], tuple(e["places"])) for r in blocks for e in r["entries"]}
    assert found == {("i0", "run", 2, 0, (1, 3)), ("i0", "hous", 1, 0, (2,)), ("i0", "run", 1, 2, (0,)), ("i1", "run", 1, 1, (0,))}
    assert Counter(r["n"] for r in blocks) == Counter({1: 4})


@pytest.mark.parametrize(("query", "text", "want"), [
    ("running houses", "a house that runs", True), ("running -houses", "house run", False), ('"houses running"', "the house runs", True), ('"house of running"', "house for runs", True),
    ('"house of running"', "house runs", False), ("the of", "the of", False), ('"the house"', "old houses", True), ("nothing or runs", "they run", True), ("the -runs", "a house", True), ("the -runs", "a run", False),
])
def test_matching_by_lexemes(spark, query, text, want):
    """Stems meet, words without content are no condition, and within a phrase they stand for any word."""
    chunks, _ = tables(spark, [(0, text.split())], ASKED)
    variants = spark.createDataFrame([(0, 0, "i0", "en", query)], "question_id long, turn int, institution_id string, language string, input string")
    found = retrieval.match_candidates(postings.lexeme_units(variants), postings.with_lexemes(chunks, "words"))
    assert (found.count() == 1) is want
