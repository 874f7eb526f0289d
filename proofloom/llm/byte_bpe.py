"""Byte-level BPE from a rank file, by monoid tree reduction: encoded halves are joined, tokens are concatenated.

The encodings of byte strings are a monoid: ``join`` takes the encodings of two strings to that of the strings put
together. A piece of text is cut in halves down to ``LEAF`` bytes, leaves are merged directly, and neighbours are
joined up the tree. A join re-encodes a window of tokens around the boundary, none at first and four times as many each
time, until the tokens outside are known to stay.

They stay when the two pairs at the window's ends are stable, a pair (t, u) being stable if the bytes of t and u
put together encode as t, u. For a sequence of tokens in which each pair of neighbours is stable is the encoding of
its bytes: suppose that merging crosses a boundary between tokens, and take the first merge that does. Up to then
the merges within the two tokens beside it are those, in the same order, that the two tokens alone undergo, so the
two alone would be merged across as well, and the pair would not be stable. Pairs inside an encoding are stable by
the same argument, so only the pairs at the window's ends have to be looked at. A window that reaches both ends is
the whole string, so a join always ends.

Text is first split by the vocabulary's pattern, and each match is encoded on its own; a match that is a token as a
whole is that token. The splitter knows letters and numbers by Unicode 16. Decoding concatenates the bytes of the
tokens up a tree.

Nulls and empty texts have no tokens. Rows are independent; repeated rows repeat, a null id is kept, an empty table
gives an empty table, and other columns are not read. A text of any length is one list of ids.
"""

from __future__ import annotations

import base64
import functools
import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.bpe import newer_points
from proofloom.llm.common import FLUSH_BYTES, strings

#: Bytes of a piece that are merged without cutting it further.
LEAF = 64
#: Ids that are decoded without cutting the list further.
LEAF_IDS = 4096
#: Pieces in each of two generations whose ids a Python worker remembers, the letters of the longest of them, and the pairs remembered as stable or not.
REMEMBERED_PIECES = 250_000
REMEMBERED_LENGTH = 48
REMEMBERED_PAIRS = 500_000
_NONE = 1 << 40


def _ranges(kind: str, top: int, without: frozenset[int]) -> str:
    """Members of a Unicode property below ``top`` as the inside of a character class."""
    points = [c for c in map(ord, regex.findall(rf"\p{{{kind}}}", "".join(map(chr, (*range(min(top, 0xD800)), *range(0xE000, top)))))) if c not in without]
    edges = np.flatnonzero(np.diff(points) > 1) + 1 if points else []
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in np.split(points, edges) if len(run))


def splitter(pattern: str, top: int):
    """``findall`` of a split pattern with Unicode properties, for texts whose characters are all below ``top``."""
    newer = newer_points()
    sets = {r"\p{L}": _ranges("L", top, newer), r"\p{N}": _ranges("N", top, newer), r"\s": _ranges("White_Space", top, frozenset())}

    def spelled(found: re.Match) -> str:
        part = found[0]
        if part == r"\S":
            return f"[^{sets[r'\s']}]"
        if part.startswith("["):
            return functools.reduce(lambda text, name: text.replace(name, sets[name]), sets, part)
        return f"[{sets[part]}]"

    return re.compile(re.sub(r"\[\^?[^\]]*\]|\\p\{\w+\}|\\[sS]", spelled, pattern)).findall


class Coder:
    """Ranks of byte strings, and the pattern that splits text before them."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the vocabulary has no token for the bytes {missing}")
        self.ranks = ranks
        self.labels = {i: token for token, i in ranks.items()}
        self._spelled = np.empty(max(self.labels) + 1, object)
        self._spelled[list(self.labels)] = list(self.labels.values())
        self._stable: dict[tuple[int, int], bool] = {}
        self._split = [(chr(top - 1), splitter(pattern, top)) for top in (0x80, 0x10000, 0x110000)]
        self._known = _Known(self)

    def merge(self, data: bytes) -> list[int]:
        """Ids by definition: the two neighbours whose joined bytes have the lowest rank become one, leftmost first."""
        ranks = self.ranks
        if len(data) > LEAF:
            return self._merge_long(data)
        parts = [data[k : k + 1] for k in range(len(data))]
        found = [ranks.get(data[k : k + 2], _NONE) for k in range(len(data) - 1)]
        while found:
            least = min(found)
            if least == _NONE:
                break
            k = found.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del found[k]
            if k:
                found[k - 1] = ranks.get(parts[k - 1] + parts[k], _NONE)
            if k < len(found):
                found[k] = ranks.get(parts[k] + parts[k + 1], _NONE)
        return [ranks[p] for p in parts]

    def _merge_long(self, data: bytes) -> list[int]:
        """The same with a queue of pairs, for windows that had to grow."""
        ranks, n = self.ranks, len(data)
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        queue = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(data[k : k + 2])) is not None]
        heapq.heapify(queue)
        while queue:
            _, k, end = heapq.heappop(queue)
            middle = ends[k]
            if middle < 0 or middle >= end or middle == n or ends[middle] != end:
                continue  # one of the two has grown or is gone
            ends[k], ends[middle] = end, -1
            if end < n:
                before[end] = k
                if (r := ranks.get(data[k : ends[end]])) is not None:
                    heapq.heappush(queue, (r, k, ends[end]))
            if k and (r := ranks.get(data[before[k] : end])) is not None:
                heapq.heappush(queue, (r, before[k], end))
        out, k = [], 0
        while k < n:
            out.append(ranks[data[k : ends[k]]])
            k = ends[k]
        return out

    def stable(self, t: int, u: int) -> bool:
        """Whether the bytes of two tokens put together encode as just these two."""
        known = self._stable.get((t, u))
        if known is None:
            if len(self._stable) >= REMEMBERED_PAIRS:
                self._stable.clear()
            known = self._stable[t, u] = self.merge(self.labels[t] + self.labels[u]) == [t, u]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two strings put together, from their encodings."""
        if not left or not right or self.stable(left[-1], right[0]):
            return left + right
        reach = 1
        while True:
            start, end = max(0, len(left) - reach), min(len(right), reach)
            window = self.merge(b"".join(map(self.labels.__getitem__, left[start:] + right[:end])))
            if (start == 0 or self.stable(left[start - 1], window[0])) and (end == len(right) or self.stable(window[-1], right[end])):
                return left[:start] + window + right[end:]
            reach *= 4

    def reduce(self, data: bytes) -> list[int]:
        """Ids of a byte string: its halves are encoded and joined."""
        if len(data) <= LEAF:
            return self.merge(data)
        half = len(data) // 2
        return self.join(self.reduce(data[:half]), self.reduce(data[half:]))

    def piece(self, data: bytes) -> list[int]:
        """Ids of one match of the pattern."""
        whole = self.ranks.get(data)
        return self.reduce(data) if whole is None else [whole]

    def cells(self, text: str) -> bytes:
        """Ids of a text as 32-bit cells."""
        top = max(text, default="")
        return b"".join(map(self._known.__getitem__, next(split for last, split in self._split if top <= last)(text)))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.cells(text), np.int32).tolist()

    def decode(self, ids: list[int] | np.ndarray) -> bytes:
        """Bytes of a list of ids: those of its halves, one after the other."""
        if len(ids) <= LEAF_IDS:
            return b"".join(self._spelled[np.asarray(ids, np.int32)].tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class _Known(dict):
    """Pieces of text with their ids as cells; short ones are remembered, and those of the generation before that come again."""

    def __init__(self, coder: Coder):
        super().__init__()
        self._coder = coder
        self._before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        cells = self._before.get(piece)
        if cells is None:
            cells = array("i", self._coder.piece(piece.encode())).tobytes()
        if len(piece) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED_PIECES:
                self._before = dict(self)
                self.clear()
            self[piece] = cells
        return cells


@functools.lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> Coder:
    """From a rank file: lines of a token in base64 and its rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}
    return Coder(ranks, pattern)


TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])


def _token_batch(ids: list, cells: list[bytes], decoded: list[bytes]) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(c) // 4 for c in cells)], dtype=np.int32)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(cells), np.int32)))
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists, pa.array(decoded, pa.binary())], schema=TOKENS)


def encode_decode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids array<int>, decoded binary: every whole text encoded, and its ids decoded again.

    ``path`` is the rank file, the same on every worker.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path, pattern)
        ids, cells, decoded, held = [], [], [], 0
        for part in parts:
            for i, text in zip(part.column(0).to_pylist(), strings(part.column(1))):
                ids.append(i)
                cells.append(own.cells(text))
                decoded.append(own.decode(np.frombuffer(cells[-1], np.int32)))
                held += len(cells[-1]) + len(decoded[-1]) + 64
                if held >= FLUSH_BYTES:
                    yield _token_batch(ids, cells, decoded)
                    ids, cells, decoded, held = [], [], [], 0
        if ids:
            yield _token_batch(ids, cells, decoded)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text."""
    coded = encode_decode(docs, path, pattern)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
