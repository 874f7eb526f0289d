"""Search in blocks against plain loops, with blocks and slices so small that every question meets several."""

import random

import pytest

from proofloom.functions import stems
from proofloom.operators import blocks, set_join
from proofloom.plans import registry

WORDS = "running runs the rooms room halls hall of floors floor dying or skies sky 7 42 é été".split()


def lexemes(text):
    return [stems.lexeme(w, "english") for w in blocks.tx.words(blocks.plain(text))]


def texts(rng, n):
    return [" ".join(rng.choices(WORDS, k=rng.choice([0, 1, 2, 5, 9, 800]))).title() for _ in range(n)]


def holds(own, query):
    """Whether lexemes satisfy the lines of a query; alternatives bind closer than conjunction."""
    groups = []
    for line in query.split("\n"):
        phrase = line[2:].split(" ")
        hit = any(all(p in ("", w) for p, w in zip(phrase, own[i:])) for i in range(len(own) - len(phrase) + 1)) != (line[1] == "-")
        if line[0] == "|" and groups:
            groups[-1] |= hit
        else:
            groups.append(hit)
    return all(groups)


@pytest.fixture
def tables(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 18_000)
    monkeypatch.setattr(blocks, "SLICE", 12)
    rng = random.Random(5)
    rows = [(f"i{i % 2}", "en", 1000 - i, i // 3, i % 3, t) for i, t in enumerate(texts(rng, 150))]
    chunks = spark.createDataFrame(rows, "institution_id string, language string, chunk_id long, document_id long, chunk_index int, content string")
    return rng, rows, blocks.build(chunks)


def test_counts_equal_a_plain_loop(spark, tables):
    rng, rows, held = tables
    assert held.count() > 4
    made = ["running or halls", "skies -rooms", '"running room"', '"hall of floors"', "-sky", '-"rooms halls" or floors', "the", '"the"', "nowhere", "nowhere or sky", "room floor sky", "-nowhere"]
    inputs = made + [" ".join(rng.choice(["", "-"]) + rng.choice([*WORDS, '"room the hall"', '"sky sky"']) for _ in range(rng.randint(1, 5))) for _ in range(40)]
    asked = [(q, f"i{q % 2}", "en", text) for q, text in enumerate(inputs)]
    got = blocks.match_counts(spark.createDataFrame(asked, "question_id long, institution_id string, language string, input string"), held)
    want = []
    for q, place, _, text in asked:
        if query := blocks.lexeme_query(text, "english"):
            met = [r[2] for r in rows if r[0] == place and holds(lexemes(r[5]), query)]
            want += [(q, len(met), min(met))] if met else []
    assert len(want) > 25 and sorted(map(tuple, got.select("question_id", "n_chunks", "first_chunk").collect())) == want


def test_best_equal_a_plain_loop(spark, tables):
    rng, rows, held = tables
    asked = [(q, f"i{q % 2}", "en", [stems.lexeme(w, "english") for w in rng.sample(WORDS, rng.randint(1, 6))]) for q in range(40)]
    got = blocks.top_alternatives(spark.createDataFrame(asked, "question_id long, institution_id string, language string, lexemes array<string>"), held, 4)
    want = []
    for q, place, _, own in asked:
        wanted = {w for w in own if w}
        worth = [(-sum(w in wanted for w in lexemes(r[5])), r[3], r[4], r[2]) for r in rows if r[0] == place]
        want += [(q, c, -less, k) for k, (less, _, _, c) in enumerate(sorted(w for w in worth if w[0])[:4], 1)]
    assert sorted(map(tuple, got.select("question_id", "chunk_id", "worth", "rank").collect())) == sorted(want)
    assert max(w[2] for w in want) > 255


@pytest.mark.parametrize("name", ["stemmed_match_or", "stemmed_match_phrase", "stemmed_match_not", "stemmed_top_alternatives"])
def test_no_pair_of_question_and_chunk_is_shuffled(spark, name):
    plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan


def test_similar_sets_in_many_blocks(spark, monkeypatch):
    """Sets of common words: all pairs that reach the similarity, and no join on a word."""
    monkeypatch.setattr(set_join, "BLOCK", 13)
    monkeypatch.setattr(set_join, "SLICE", 9)
    rng = random.Random(7)
    sets = {i: set(rng.sample([*WORDS, "", "two words", "a\nline"], rng.randint(1, 9))) for i in range(70)}
    df = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "class long, words array<string>")
    got = set_join.similar_classes(df, 0.3)
    plan = got._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "SortMergeJoin" not in plan
    alike = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(r["class_a"], r["class_b"]): r["jaccard"] for r in got.collect()} == {p: j for p, j in alike.items() if j >= 0.3 - 1e-9}
