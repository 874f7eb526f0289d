"""BPE as a deterministic automaton over tokens, compiled from the merge list by successive merge gadgets.

A state is the token read last, and the arc for token x leads to state x, so the automaton is deterministic
by construction; what has to be compiled is which arcs each state has. It starts with every base symbol after
every base symbol. The gadget of merge (a, b) adds a state for the merged token c, which gets the arcs that
the state of b has at that moment, then takes arc b, and all arcs of tokens that grow from b later, away from
state a; tokens that grow from a get c among them as an arc wherever a has one. After the last merge the
automaton accepts exactly the sequences that the merge procedure produces.

Tokens are numbered so that those grown from one token by later merges form an interval that ends with the
token itself. What a gadget takes away is such an interval, intervals of one state are disjoint or nested, and
nested ones are dropped. The transition table is the sorted missing intervals of all states in one array: a
transition is one binary search in the row of its state.

A word is encoded by transitions from left to right: a trie gives the tokens that may be read at a position,
the longest with an arc in the present state first. Decoding emits the arc labels of the ids.

Nulls and empty texts have no tokens. Rows are independent; repeated rows repeat, a null id is kept, an empty
table gives an empty table, and other columns are not read. A text of any length is one list of ids.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import batches, strings

#: Words in each of two generations whose ids a Python worker remembers, and the letters of the longest of them.
REMEMBERED_WORDS = 80_000
REMEMBERED_LENGTH = 64
_ROOT = -1
_SHIFT = 32
_LOW = (1 << _SHIFT) - 1


# Letters and numbers of Unicode 17, which the tokenizer's classes (Unicode 16) do not have, in hexadecimal.
_NEWER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20
18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2
1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_FIRST_NEWER = chr(int(_NEWER.split()[0].partition("-")[0], 16))
# Capitals of Unicode 16 and 17 with their small letters, which the tokenizer lowers and Python 3.13 does not, in hexadecimal.
_NEWER_CAPITALS = """
1C89:1C8A A7CB:264 A7CC:A7CD A7CE:A7CF A7D2:A7D3 A7D4:A7D5 A7DA:A7DB A7DC:19B 10D50-10D65:10D70 16EA0-16EB8:16EBB
"""


def _span(text: str) -> range:
    first, _, last = text.partition("-")
    return range(int(first, 16), int(last or first, 16) + 1)


def newer_points() -> frozenset[int]:
    """Code points that are letters or numbers only since Unicode 17."""
    return frozenset(itertools.chain.from_iterable(map(_span, _NEWER.split())))


def splitter(pattern: str, newer: str):
    """``findall`` of a tokenizer file's word pattern, for which ``newer`` letters and numbers are neither."""
    known = pattern
    if newer:
        without = "".join(f"\\U{s[0]:08X}-\\U{s[-1]:08X}" for s in map(_span, newer.split()))
        known = known.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{without}]]")
        known = known.replace(r"[\p{L}]", rf"[\p{{L}}--[{without}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{without}]]")
    return regex.compile(known.replace(r"\s", r"\p{White_Space}"), regex.V1).findall


def _capitals() -> dict[int, int]:
    pairs = (part.split(":") for part in _NEWER_CAPITALS.split())
    return {c: int(small, 16) + k for span, small in pairs for k, c in enumerate(_span(span))}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeAutomaton:
    """Token automaton of a merge list. ``step`` is its transition test, ``encode_symbols`` reads a word."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str):
        self.labels = {i: s for s, i in vocab.items()}
        grown: dict[int, tuple[int, int]] = {}  # token -> the two it is merged from, in order of the merges
        for a, b in merges:
            grown.setdefault(vocab[a + b], (vocab[a], vocab[b]))
        self._compile(grown)
        self._tries: list[dict[str, int]] = [{}]
        self._tokens: list[int | None] = [None]
        for i in self._live:
            node = 0
            for symbol in self._spelling(self.labels[i], end):
                node = self._tries[node].setdefault(symbol, len(self._tries))
                if node == len(self._tries):
                    self._tries.append({})
                    self._tokens.append(None)
            self._tokens[node] = i

    @staticmethod
    def _spelling(label: str, end: str) -> list[str]:
        """Base symbols of a label: characters, the last one with the word end if the label has it."""
        if end and label.endswith(end):
            plain = label[: -len(end)]
            return [*plain[:-1], plain[-1:] + end]
        return list(label)

    def _number(self, grown: dict[int, tuple[int, int]]) -> tuple[dict[int, int], dict[int, list[tuple[int, int]]]]:
        """The first number of each token's interval, and (merge, token) of those that grow from it, by merge."""
        kids: dict[int, list[tuple[int, int]]] = {i: [] for i in self.labels}
        for t, (c, (a, _)) in enumerate(grown.items()):
            kids[a].append((t, c))
        first: dict[int, int] = {}
        self._numbers: dict[int, int] = {}
        for root in (i for i in self.labels if i not in grown):
            stack = [(root, 0)]
            while stack:
                token, k = stack.pop()
                first.setdefault(token, len(self._numbers))
                if k < len(kids[token]):
                    stack += [(token, k + 1), (kids[token][k][1], 0)]
                else:
                    self._numbers[token] = len(self._numbers)
        return first, kids

    def _compile(self, grown: dict[int, tuple[int, int]]) -> None:
        first, kids = self._number(grown)
        rows = {i: array("Q") for i in self.labels}
        self._live = {i for i in self.labels if i not in grown}
        for t, (c, (a, b)) in enumerate(grown.items()):
            number = self._numbers[b]
            if a not in self._live or b not in self._live or not self._free(rows[a], number, 0, len(rows[a])):
                continue  # this merge can never apply
            self._live.add(c)
            rows[c] = rows[b][:]
            later = bisect_left(kids[b], (t, -1))
            start = first[kids[b][later][1]] if later < len(kids[b]) else number
            row = rows[a]
            inner = slice(bisect_left(row, start << _SHIFT), bisect_left(row, number + 1 << _SHIFT))
            row[inner] = array("Q", [start << _SHIFT | number])
        self._table = array("Q")
        self._rows = array("Q", [0])
        states = sorted(self._live)
        self._state = {i: k for k, i in enumerate(states)}
        for i in states:
            self._table += rows[i]
            self._rows.append(len(self._table))

    @staticmethod
    def _free(table: array, number: int, lo: int, hi: int) -> bool:
        """Whether no missing interval of a row contains the number."""
        k = bisect_right(table, number << _SHIFT | _LOW, lo, hi) - 1
        return k < lo or table[k] & _LOW < number

    def step(self, u: int, x: int) -> bool:
        """Whether state u has an arc for token x."""
        if u == _ROOT:
            return True
        state = self._state[u]
        return self._free(self._table, self._numbers[x], self._rows[state], self._rows[state + 1])

    def encode_symbols(self, symbols: list[str]) -> list[int]:
        """Ids of a word given as base symbols: the one path through the automaton that spells it.

        The longest token with an arc is tried first. A prefix is reached by one path at most, so one that the
        rest of the word does not follow on from is never tried again.
        """
        tries, tokens, n = self._tries, self._tokens, len(symbols)
        table, rows, states, numbers = self._table, self._rows, self._state, self._numbers
        out: list[int] = []
        open_: list[tuple[int, list[tuple[int, int]]]] = []  # place and untried tokens before each id
        dead: set[int] = set()
        at, lo, hi, found = 0, 0, 0, None
        while at < n:
            if found is None:
                found, node, i = [], 0, at
                while i < n:
                    node = tries[node].get(symbols[i])
                    if node is None:
                        break
                    i += 1
                    if (token := tokens[node]) is not None:
                        found.append((token, i))
                if out:
                    state = states[out[-1]]
                    lo, hi = rows[state], rows[state + 1]
                else:
                    lo = hi = 0
            while found:
                token, end = found.pop()
                if end not in dead:
                    number = numbers[token]
                    k = bisect_right(table, number << _SHIFT | _LOW, lo, hi) - 1
                    if k < lo or table[k] & _LOW < number:
                        open_.append((at, found))
                        out.append(token)
                        at, found = end, None
                        break
            else:
                if not open_:
                    raise ValueError("a base symbol is missing from the vocabulary")
                dead.add(at)
                at, found = open_.pop()
                out.pop()
                lo = hi = 0
                if out:
                    state = states[out[-1]]
                    lo, hi = rows[state], rows[state + 1]
        return out


class Tokenizer:
    """A ``tokenizers`` JSON file of the lower-casing word BPE kind: normaliser, splitter, automaton, decoder."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m if isinstance(m, list) else m.split(" ", 1)) for m in model["merges"]]
        self.end = model["end_of_word_suffix"] or ""
        self.automaton = MergeAutomaton(model["vocab"], merges, self.end)
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.automaton.labels | {i: s for s, i in self.added.items()}
        self._split_added = regex.compile("(" + "|".join(map(regex.escape, self.added)) + ")") if self.added else None
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self._words = splitter(pattern, "")
        self._newer_words = splitter(pattern, _NEWER)
        self._capitals = _capitals()
        self._symbols = byte_symbols()
        self._known: dict[str, list[int]] = {}
        self._before: dict[str, list[int]] = {}

    def normalize(self, text: str) -> str:
        """Canonical composition and lower case letter by letter. White space only separates words, so stays."""
        if text.isascii():
            return text.lower()
        lowered = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return lowered.translate(self._capitals) if max(lowered) > "\u1c88" else lowered

    def word(self, word: str) -> list[int]:
        """Ids of a word that the present generation does not have; one that the generation before has is taken over."""
        ids = self._before.get(word)
        if ids is None:
            symbols = list(map(self._symbols.__getitem__, word.encode()))
            symbols[-1] += self.end
            ids = self.automaton.encode_symbols(symbols)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self._known) >= REMEMBERED_WORDS:
                self._before, self._known = self._known, {}
            self._known[word] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self._split_added.split(text) if self._split_added and "<|" in text else [text]
        for piece in pieces:
            if piece in self.added:
                out.append(self.added[piece])
                continue
            lowered = self.normalize(piece)
            words = (self._words if lowered.isascii() or max(lowered) < _FIRST_NEWER else self._newer_words)(lowered)
            found = list(map(self._known.get, words))
            if None in found:
                found = [self.word(w) if ids is None else ids for w, ids in zip(words, found)]
            out += itertools.chain.from_iterable(found)
        return out

    def decode(self, ids: list[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int>, decoded string: every whole text encoded, and its ids decoded again.

    ``path`` is the tokenizer file, the same on every worker.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokenizer(path)

        def rows(part):
            for i, text in zip(part.column(0).to_pylist(), strings(part.column(1))):
                ids = coder.encode(text)
                decoded = coder.decode(ids)
                yield 4 * len(ids) + len(decoded), i, ids, decoded

        for part in parts:
            yield from batches(rows(part), TOKENS)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    coded = encode_decode(docs, path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
