"""Work of the suffix operator: texts of a batch are cut into runs together, and pieces have numbers that rows' order leaves alone."""

import random

import numpy as np

from proofloom.llm import suffixes


def some_texts():
    rng = random.Random(3)
    common = " ".join(f"c{k}" for k in range(60))
    own = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    texts = [f"{own(rng.randrange(20))} {common} {own(rng.randrange(20))}" for _ in range(60)] + ["", "short", "x" * 49, "x" * 50, "ab" * 80, common, ""]
    return [t.encode() for t in texts]


def test_runs_of_a_batch_are_hashed_together(monkeypatch):
    texts, calls, mixed = some_texts(), [], suffixes._mixed
    monkeypatch.setattr(suffixes, "_mixed", lambda *x: calls.append(1) or mixed(*x))
    found = {r.text: r for r in suffixes.runs(texts)}
    assert len(calls) <= 2
    assert sorted(found) == [i for i, t in enumerate(texts) if len(t) >= suffixes.MATCH]
    for i, own in found.items():  # as if the text were alone
        (alone,) = suffixes.runs([texts[i]])
        assert [x.tolist() for x in own[1:4]] == [x.tolist() for x in alone[1:4]]
        assert own.first[0] == 0 and own.end[-1] == len(texts[i]) - suffixes.MATCH + 1 and (own.first[1:] == own.end[:-1]).all()
        grams = [texts[i][a : a + suffixes.GRAM] for a in own.anchors.tolist()]
        assert grams == [texts[i][a : a + suffixes.GRAM] for a in alone.anchors.tolist()]
        assert all(a <= k and k + suffixes.GRAM <= b + suffixes.MATCH - 1 for a, b, k in zip(own.first, own.end, own.anchors))


def test_numbers_of_pieces_stay_when_rows_are_reordered():
    texts, ranges = some_texts(), suffixes.Ranges(0)
    known = np.unique(np.concatenate([ranges.token(r.tokens) for r in suffixes.runs(texts)]))
    hot = np.arange(len(known)) % 3 == 0
    ids, turn = np.arange(len(texts)) // 2, np.random.default_rng(2).permutation(len(texts))
    uses, pieces = suffixes._pieces(texts, ids, known, hot, ranges, True)
    others, same = suffixes._pieces([texts[k] for k in turn], ids[turn], known, hot, ranges, True)
    assert same.numbers == pieces.numbers and same.least == pieces.least and same.leads == pieces.leads
    assert others == [uses[k] for k in turn]


def test_order_of_keys_with_ties():
    rng = np.random.default_rng(1)
    for n, values in ((0, 1), (1, 1), (500, 3), (9000, 4), (9000, 10**6)):
        keys = [rng.integers(0, values, n).astype(np.uint64) for _ in range(4)]
        order = suffixes.multikey_order(keys)
        assert sorted(order.tolist()) == list(range(n))
        rows = [tuple(int(k[i]) for k in keys) for i in order]
        assert rows == sorted(rows)
