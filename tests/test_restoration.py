"""Pairs with restored diacritics: alignment and claims."""

from proofloom.operators import restoration

PAIRS = "question_id int, original string, restored string, claims array<struct<plain: string, accented: string>>"


def test_alignment(spark):
    rows = [(1, "ate o fim, ate", "até o fim, até", None), (2, "same", "same", []), (3, "ate o fim", "até ao fim", []), (4, None, None, None), (5, "Agua", "Água", None)]
    got = {r["question_id"]: (r["reworded"], [tuple(w) for w in r["marked"]]) for r in restoration.paired(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {1: (False, [(0, "ate", "até"), (3, "ate", "até")]), 2: (False, []), 3: (True, []), 4: (False, []), 5: (False, [(0, "Agua", "Água")])}
    words = {tuple(r) for r in restoration.restored_words(spark.createDataFrame(rows, PAIRS)).collect()}
    assert words == {("ate", "até", 2, 1), ("Agua", "Água", 1, 1)}


def test_claims(spark):
    rows = [
        (1, "ate o fim", "até o fim", [("ate", "até")]), (2, "ate a agua", "até a água", [("ate", "até"), ("ate", "até")]), (3, "ate o fim", "até o fim", [("ato", "até"), ("fim", "fim"), ("mal", "mál")]),
        (4, "x", "y", [("x", "ý")]), (5, "ate", "até", None), (6, "a", "a", [(None, None)]), (7, "", "", []),
    ]
    got = {tuple(r) for r in restoration.claim_problems(spark.createDataFrame(rows, PAIRS)).collect()}
    assert got == {
        (2, "undeclared", "água"), (3, "not_a_restoration", "até"), (3, "nothing_restored", "fim"), (3, "not_in_text", "mál"), (4, "reworded", None), (5, "undeclared", "até"),
        (6, "nothing_restored", None), (6, "not_in_text", None),
    }
    assert restoration.claim_problems(spark.createDataFrame([], PAIRS)).count() == 0
