"""Byte-level BPE by tree reduction: against the definition, against the library, over every code point, odd rows."""

import hashlib
import random

import public_tokenizers
import pytest

from proofloom.llm import byte_bpe, registry


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.coder(registry.RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})


def plain_merges(data, ranks):
    """The definition: of all neighbours the pair of lowest rank, leftmost first, until none has one."""
    parts = [data[k : k + 1] for k in range(len(data))]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        _, k = min(found)
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def small_coder(seed):
    """A vocabulary of random merges over three letters."""
    rng = random.Random(seed)
    ranks = {bytes([b]): b for b in range(256)}
    known = [b"a", b"b", b"c"]
    while len(known) < 40:
        token = rng.choice(known) + rng.choice(known)
        if token not in ranks and len(token) <= 7:
            ranks[token] = len(ranks)
            known.append(token)
    return byte_bpe.Coder(ranks, public_tokenizers.PATTERN)


@pytest.mark.parametrize("seed", range(6))
def test_tree_equals_definition(seed, monkeypatch):
    monkeypatch.setattr(byte_bpe, "LEAF", 2)
    own, rng = small_coder(seed), random.Random(seed)
    for _ in range(300):
        data = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 60)))
        ids = own.reduce(data)
        assert ids == plain_merges(data, own.ranks)
        assert own._merge_long(data) == ids
        assert all(own.stable(a, b) for a, b in zip(ids, ids[1:]))
        cut = rng.randrange(len(data) + 1)
        assert own.join(own.reduce(data[:cut]) if cut else [], own.reduce(data[cut:]) if cut < len(data) else []) == ids


@pytest.mark.parametrize("seed", range(3))
def test_stable_neighbours_are_an_encoding(seed):
    """The fact that a join rests on: a sequence is the encoding of its bytes exactly if each pair of neighbours is stable."""
    own, rng = small_coder(seed), random.Random(seed)
    tokens = [i for t, i in own.ranks.items() if set(t) <= set(b"abc") and plain_merges(t, own.ranks) == [i]]
    for _ in range(3000):
        ids = [rng.choice(tokens) for _ in range(rng.randrange(2, 6))]
        whole = plain_merges(b"".join(own.labels[i] for i in ids), own.ranks) == ids
        assert whole == all(own.stable(a, b) for a, b in zip(ids, ids[1:]))


def test_tokens_encode_as_themselves(coder):
    assert all(coder.reduce(token) == [rank] for token, rank in coder.ranks.items())


def test_every_code_point(coder, library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(points), 64):
        text = "".join(f"a{c}a 1{c}1 '{c} {c}\n{c}{c}.{c} " for c in points[k : k + 64])
        assert coder.encode(text) == library.encode_ordinary(text), hex(ord(points[k]))


def test_odd_texts(coder, library):
    rng = random.Random(3)
    texts = ["", " ", "  \n \t ", "a" * 9001, " " * 5000, "-" * 7001, "ab" * 4000, "日" * 3000, "don't I'LL 've's", "\x1c\x1f\x85\xa0　x", "<|endoftext|>", "é\U0001f642\U0001f643"]
    for letters in ("ab", "aA b\n", "é日本語한 ٣1", "abcdefghijklmnopqrstuvwxyz", "-=_", "\U0001f642 a"):
        texts += ["".join(rng.choice(letters) for _ in range(n)) for n in (3, 50, 700, 3000)]
    for text in texts:
        ids = coder.encode(text)
        assert ids == library.encode_ordinary(text), text[:30]
        assert coder.decode(ids) == text.encode()


def test_memory_of_pieces_is_bounded(coder, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED_PIECES", 5)
    monkeypatch.setattr(byte_bpe, "REMEMBERED_PAIRS", 5)
    text = " ".join(f"word{k} other" for k in range(200))
    assert coder.encode(text) == library.encode_ordinary(text)
    assert len(coder._known) <= 5


def test_rows(spark, library):
    """Nulls, empty and long texts, repeated rows, clashing columns, an empty table, output in several batches."""
    long = "many words, some of them new: " + " ".join(map(str, range(150_000)))
    rows = [(1, "a text", 9), (1, "a text", 8), (None, None, 7), (2, "", None), (3, long, 5), (4, long + "!", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = sorted(map(tuple, byte_bpe.digests(docs, registry.RANKS, public_tokenizers.PATTERN).collect()), key=repr)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, text, _ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(text or "")))
    assert got == sorted(want, key=repr)
    assert byte_bpe.digests(docs.limit(0), registry.RANKS, public_tokenizers.PATTERN).collect() == []


def test_bytes_without_token_are_refused():
    with pytest.raises(ValueError, match="no token"):
        byte_bpe.Coder({b"a": 0}, public_tokenizers.PATTERN)
