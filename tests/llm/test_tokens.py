"""The tokenization automaton: against merging pair by pair, against the library, and over every code point."""

import random

import pytest

from proofloom.llm import bpe, registry


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(registry.TOKENIZER)
    known.no_truncation()
    known.no_padding()
    return known


def plain_merges(symbols, merges):
    """Byte pair encoding as defined: the merge of lowest rank, leftmost first, until none applies."""
    parts = list(symbols)
    while True:
        ranked = [(merges[pair], k) for k, pair in enumerate(zip(parts, parts[1:])) if pair in merges]
        if not ranked:
            return parts
        _, k = min(ranked)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


@pytest.mark.parametrize("seed", range(8))
def test_automaton_accepts_what_merging_makes(seed):
    rng = random.Random(seed)
    symbols = list("abc")
    merges, known = [], list(symbols)
    while len(merges) < 25:
        a, b = rng.choice(known), rng.choice(known)
        if a + b not in known and len(a + b) <= 6:
            merges.append((a, b))
            known.append(a + b)
    automaton = bpe.MergeAutomaton({s: i for i, s in enumerate(known)}, merges, "")
    ranks = {pair: k for k, pair in enumerate(merges)}
    for _ in range(400):
        word = [rng.choice(symbols) for _ in range(rng.randrange(1, 14))]
        ids = automaton.encode_symbols(word)
        assert [known[i] for i in ids] == plain_merges(word, ranks)
        assert all(automaton.step(a, b) for a, b in zip(ids, ids[1:]))


def test_transitions_are_those_of_merged_pairs():
    """An arc exists exactly where merging the two spellings together leaves the two tokens."""
    merges = [("a", "b"), ("b", "a"), ("ab", "ab"), ("a", "a"), ("ba", "b"), ("aa", "ab")]
    known = ["a", "b", *(a + b for a, b in merges)]
    automaton = bpe.MergeAutomaton({s: i for i, s in enumerate(known)}, merges, "")
    ranks = {pair: k for k, pair in enumerate(merges)}
    live = [s for s in known if plain_merges(s, ranks) == [s]]
    for u in live:
        for x in live:
            assert automaton.step(known.index(u), known.index(x)) == (plain_merges(u + x, ranks) == [u, x]), (u, x)


def test_every_code_point(library):
    coder = bpe.tokenizer(registry.TOKENIZER)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c} " for c in points[k : k + 512]) for k in range(0, len(points), 512)]
    for k, (text, known) in enumerate(zip(texts, library.encode_batch(texts, add_special_tokens=False))):
        assert coder.encode(text) == known.ids, hex(ord(points[512 * k]))


def test_odd_texts(library):
    rng = random.Random(3)
    texts = ["", " ", "x" * 5000, "don't've <|startoftext|>a<|endoftext|>", "Á é ẛ̣", "ΑΣ ΣΑΣ", "İı", "a\x00b​c﻿"]
    texts += ["".join(rng.choice("abcdefgh tion'sé日1-") for _ in range(300)) for _ in range(50)]
    coder = bpe.tokenizer(registry.TOKENIZER)
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert coder.encode(text) == ids
        assert coder.decode(ids) == library.decode(ids, skip_special_tokens=False)
