"""Suffix-array dedup: bytes covered by a 50-byte string that a smaller document also has are removed.

Moving every suffix of a corpus with its 50 bytes would move each byte fifty times, so the suffixes that are
moved are a sample that every string is sure to have: the anchor of a 50-byte string is the position of the
16-byte gram with the smallest hash among its grams. Equal strings have their anchors at the same place, and
neighbouring positions mostly share one, so a document is cut into runs of positions with one anchor each.

1. Documents are dealt into blocks of bounded size. Each block sends a hash of each distinct anchor gram, by
   uniform ranges, and learns which grams more than one document has.
2. The suffix at each shared anchor is range-partitioned by its leading token, the 16 bytes of the gram, with
   splitters sampled from all anchors. It takes along the text of its run, each distinct text once for each
   block with its smallest document. A splitter never stands between equal leading tokens and strings with
   one anchor gram share that token, so no group of equal strings crosses a boundary and there is nothing
   left to compare across it. A gram that very many documents have is sent as its single 50-byte strings
   instead, each under its own leading token, so no bucket gathers the surroundings of a very common passage.
   A bucket sorts all suffixes of its runs by multikey quicksort on eight-byte keys. Neighbours in the order
   that agree on 50 bytes form a group, whose smallest document is returned to the blocks.
3. Each block compares that smallest document with its own and removes what is covered.

Documents that share a gram with no other are never sent. Null and empty texts have no strings. A null id
counts as larger than any other; rows with the same id do not shorten each other, so repeated rows stay
alike. A very long text is one block by itself. An empty table gives an empty table. Other columns are kept
by ``deduplicate`` as they are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from proofloom.llm.common import utf8

MATCH = 50
GRAM = 16
#: Text bytes in a block of documents, and text bytes whose suffixes make a bucket, on average.
BLOCK_BYTES = 4_000_000
BUCKET_BYTES = 18_000_000
#: Buckets at most (their splitters go to all tasks), and leading tokens sampled for each.
MAX_BUCKETS = 1 << 20
SAMPLED = 16
SAMPLED_OF_DOC = 50
#: Documents that have a gram beyond which it is sent string by string.
HOT_DOCS = 20_000
#: Suffixes sorted at once, and rows below which a part of the sort is finished by a plain sort.
SORT_ROWS = 400_000
_LEAF = 2048
_NO_DOC = np.iinfo(np.int64).max
_CONCAT = 1 << 18
_BLOCK = "__block"
#: Odd multipliers of the gram hash (fixed values).
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)]


_PLACE = np.uint64(63)
_PLACE_OFF = ~_PLACE


def _mixed(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    h = high * _MIX[0] ^ low * _MIX[1]
    h ^= h >> np.uint64(29)
    h *= _MIX[2]
    return h ^ h >> np.uint64(32)


def _words(data: np.ndarray, at: np.ndarray | slice) -> np.ndarray:
    """The eight bytes from each position as an integer that orders like the bytes."""
    two = data[:-1].astype(np.uint16) << np.uint16(8) | data[1:]
    four = two[:-2].astype(np.uint32) << np.uint32(16) | two[2:]
    return (four[:-4].astype(np.uint64) << np.uint64(32) | four[4:])[at]


def _leading(data: np.ndarray) -> np.ndarray:
    """For each position with MATCH bytes ahead, the smallest gram hash among those bytes, with the gram's place in the last six bits."""
    words = _words(data, slice(None))
    least = _mixed(words[: -(GRAM - 8)], words[GRAM - 8 :])
    least = (least & _PLACE_OFF) | (np.arange(len(least), dtype=np.uint64) & _PLACE)
    width, step = MATCH - GRAM + 1, 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[:-rest], least[rest:]) if rest else least


class Runs(NamedTuple):
    """The runs of one text: first and end positions, a uniform hash of the anchor gram, and the place of the gram."""

    text: int
    first: np.ndarray
    end: np.ndarray
    tokens: np.ndarray
    anchors: np.ndarray


def runs(texts: list[bytes]) -> Iterator[Runs]:
    """For each text that has a string of MATCH bytes."""
    start = 0
    while start < len(texts):
        stop, size = start, 0
        while stop < len(texts) and (stop == start or size + len(texts[stop]) <= _CONCAT):
            size += len(texts[stop])
            stop += 1
        if size >= MATCH:
            least = _leading(np.frombuffer(b"".join(texts[start:stop]), np.uint8))
            hashes = least & _PLACE_OFF
            lengths = np.array([len(t) for t in texts[start:stop]])
            begins, counts = np.cumsum(lengths) - lengths, lengths - MATCH + 1
            new = np.append(True, hashes[1:] != hashes[:-1])
            edges = np.concatenate([begins, (begins + counts)[counts > 0]])
            new[edges[edges < len(new)]] = True
            at = np.flatnonzero(new)
            text = np.searchsorted(begins, at, side="right") - 1
            ends = np.append(at[1:], len(new))
            inside = at - begins[text] < counts[text]
            at, text, ends = at[inside], text[inside], ends[inside]
            first, end = at - begins[text], ends - begins[text]
            anchors = first + ((least[at] & _PLACE).astype(np.int64) - at & 63)
            tokens = _mixed(hashes[at], hashes[at])
            cuts = np.searchsorted(text, np.arange(len(lengths) + 1)).tolist()
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
                if a < b:
                    yield Runs(start + i, first[a:b], end[a:b], tokens[a:b], anchors[a:b])
        start = stop


class Ranges(NamedTuple):
    """Uniform ranges of gram hashes, each 32 bits wide: 2 ** ``power`` of them."""

    power: int

    def token(self, hashes: np.ndarray) -> np.ndarray:
        return hashes >> np.uint64(32 - self.power)


def _lead(text: bytes, at: int) -> bytes:
    return text[at : at + GRAM]


class Splitters:
    """Ordered ranges of leading tokens. Equal tokens are always in one range."""

    def __init__(self, sample: list[bytes], buckets: int):
        ordered = np.sort(np.array(sample, f"S{GRAM}"))
        self.edges = np.unique(ordered[len(ordered) * np.arange(1, buckets) // buckets]) if len(ordered) else ordered

    def place(self, leads: list[bytes]) -> np.ndarray:
        return np.searchsorted(self.edges, np.array(leads, f"S{GRAM}"), side="right")


def _sample(docs: DataFrame, rows: int, wanted: int) -> list[bytes]:
    """About ``wanted`` leading tokens of anchors."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, leads = utf8(part.column(0)), []
            for own in runs(texts):
                some = own.anchors[:: -(-len(own.anchors) // SAMPLED_OF_DOC)]
                leads += [_lead(texts[own.text], a) for a in some.tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(leads, pa.binary())], names=["lead"])

    fraction = min(1.0, max(1000, wanted // 8) / max(1, rows))
    taken = docs.select("text").sample(fraction=fraction, seed=7).mapInArrow(run, "lead binary").toPandas()
    return [bytes(x) for x in taken["lead"]]


def _ids(table: pa.Table) -> np.ndarray:
    return np.array([_NO_DOC if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)


def _texts(table: pa.Table) -> list[bytes]:
    return utf8(table.column("text").combine_chunks())


def _table(kind: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kind)] if rows else [pa.array([], f.type) for f in kind], schema=kind)


SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary())])
SHARED = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("tokens", pa.binary()), ("hot", pa.binary())])
PIECES = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("packed", pa.binary())])


def _send_tokens(ranges: Ranges):
    def run(table: pa.Table) -> pa.Table:
        found = [np.unique(ranges.token(own.tokens)) for own in runs(_texts(table))]
        if not found:
            return _table(SENT, [])
        tokens, counts = np.unique(np.concatenate(found), return_counts=True)
        places = tokens >> np.uint64(32)
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1]))
        block, rows = table.column(_BLOCK)[0].as_py(), []
        low, docs = tokens.astype("<u4"), np.minimum(counts, 255).astype(np.uint8)
        for a, b in zip(starts, np.append(starts[1:], len(tokens))):
            rows.append((int(places[a]), block, low[a:b].tobytes(), docs[a:b].tobytes()))
        return _table(SENT, rows)

    return run


def _find_shared(hot_docs: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = table.column("block").to_pylist()
        lists = [np.frombuffer(t, "<u4") for t in table.column("tokens").to_pylist()]
        docs = np.concatenate([np.frombuffer(d, np.uint8) for d in table.column("docs").to_pylist()])
        distinct, where = np.unique(np.concatenate(lists), return_inverse=True)
        counts = np.bincount(where, docs, len(distinct))
        rows, at = [], 0
        bucket = table.column("bucket")[0].as_py()
        for block, tokens in zip(blocks, lists):
            own = where[at : at + len(tokens)]
            own = own[counts[own] > 1]
            at += len(tokens)
            if len(own):
                rows.append((block, bucket, distinct[own].tobytes(), np.packbits(counts[own] > hot_docs).tobytes()))
        return _table(SHARED, rows)

    return run


def _known(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Shared tokens of a block in order, and which of them are hot."""
    tokens, hot = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for bucket, low, marks in zip(*(table.column(c).to_pylist() for c in ("bucket", "tokens", "hot"))):
        own = np.frombuffer(low, "<u4")
        tokens.append(own + np.uint64(bucket << 32))
        hot.append(np.unpackbits(np.frombuffer(marks, np.uint8), count=len(own)))
    tokens, hot = np.concatenate(tokens), np.concatenate(hot)
    order = np.argsort(tokens)
    return tokens[order], hot[order] > 0


class Pieces:
    """Distinct pieces of a block by number: text, token, smallest document and, if asked for, leading token.

    A text has one anchor gram, and so one token; a piece of MATCH bytes under a hot gram is always sent by itself.
    """

    def __init__(self, leading: bool):
        self.leading = leading
        self.numbers: dict[bytes, int] = {}
        self.tokens: list[int] = []
        self.least: list[int] = []
        self.leads: list[bytes] = []

    def add(self, piece: bytes, token: int, doc: int, lead: int) -> int:
        """The number of a piece of a document whose leading token starts at ``lead``."""
        n = self.numbers.setdefault(piece, len(self.least))
        if n == len(self.least):
            self.tokens.append(token)
            self.least.append(doc)
            if self.leading:
                self.leads.append(piece[lead : lead + GRAM])
        elif doc < self.least[n]:
            self.least[n] = doc
        return n


def _pieces(texts: list[bytes], ids: np.ndarray, known: np.ndarray, hot: np.ndarray, ranges: Ranges, leading: bool) -> tuple[list[list[tuple[int, int, int]]], Pieces]:
    """Uses of pieces by text, as (first position, positions, number of the piece), and the pieces.

    Numbers depend on the texts and ids alone, not on the order of the rows. Hot tokens give one piece of MATCH
    bytes for each position, whose token is the hash of its own ends and whose leading token are its own first bytes.
    """
    uses: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    pieces = Pieces(leading)
    if not len(known):
        return uses, pieces
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i]))
    add = pieces.add
    for own in runs([texts[i] for i in order]):
        tokens = ranges.token(own.tokens)
        at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
        hit = np.flatnonzero(known[at] == tokens)
        if not len(hit):
            continue
        row = order[own.text]
        text, doc, mine = texts[row], int(ids[row]), uses[row]
        for a, b, token, anchor, single in zip(*(x[hit].tolist() for x in (own.first, own.end, tokens, own.anchors, hot[at]))):
            if not single:
                mine.append((a, b - a, add(text[a : b + MATCH - 1], token, doc, anchor - a)))
                continue
            words = _words(np.frombuffer(text, np.uint8, b - a + MATCH - 1, a), slice(None))[: b - a + MATCH - 8]
            singles = ranges.token(_mixed(words[: b - a], words[MATCH - 8 :]))
            for p, t in zip(range(a, b), singles.tolist()):
                mine.append((p, 1, add(text[p : p + MATCH], t, doc, 0)))
    return uses, pieces


def _pack(tokens: np.ndarray, docs: np.ndarray, numbers: np.ndarray, pieces: list[bytes]) -> bytes:
    """What one block sends to one bucket: tokens, documents, piece numbers and lengths, then the texts, compressed."""
    sizes = np.array([len(p) for p in pieces], "<i4")
    head = np.array([len(pieces)], "<i8").tobytes()
    return zstandard.compress(b"".join([head, tokens.astype("<u8").tobytes(), docs.astype("<i8").tobytes(), numbers.astype("<i4").tobytes(), sizes.tobytes(), *pieces]))


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    data = zstandard.decompress(packed)
    n = int(np.frombuffer(data, "<i8", 1)[0])
    tokens, docs = np.frombuffer(data, "<u8", n, 8), np.frombuffer(data, "<i8", n, 8 + 8 * n)
    numbers, sizes = np.frombuffer(data, "<i4", n, 8 + 16 * n), np.frombuffer(data, "<i4", n, 8 + 20 * n)
    ends = (8 + 24 * n + np.cumsum(sizes)).tolist()
    return tokens, docs, numbers, [data[e - k : e] for e, k in zip(ends, sizes.tolist())]


def _send_pieces(ranges: Ranges, splitters: Splitters):
    def run(docs: pa.Table, shared: pa.Table) -> pa.Table:
        if not docs.num_rows or not shared.num_rows:
            return _table(PIECES, [])
        _, found = _pieces(_texts(docs), _ids(docs), *_known(shared), ranges, True)
        keys = list(found.numbers)
        if not keys:
            return _table(PIECES, [])
        places = splitters.place(found.leads)
        numbers = np.argsort(places, kind="stable")
        tokens = np.array(found.tokens, np.uint64)[numbers]
        owners = np.array(found.least, np.int64)[numbers]
        places = places[numbers]
        block = docs.column(_BLOCK)[0].as_py()
        starts = np.flatnonzero(np.append(True, places[1:] != places[:-1])).tolist()
        rows = []
        for a, b in zip(starts, [*starts[1:], len(keys)]):
            rows.append((int(places[a]), block, _pack(tokens[a:b], owners[a:b], numbers[a:b], [keys[n] for n in numbers[a:b].tolist()])))
        return _table(PIECES, rows)

    return run


def _leaf(rows: np.ndarray, depth: int, keys: list[np.ndarray]) -> np.ndarray:
    """A few rows in order: sorted by one key, and only those that it leaves equal by all the others."""
    own = keys[depth][rows]
    by = np.argsort(own)
    rows, own = rows[by], own[by]
    tied = np.append(False, own[1:] == own[:-1])
    if depth + 1 < len(keys) and tied.any():
        tied[:-1] |= tied[1:]
        at = np.flatnonzero(tied)
        some = rows[at]
        rows[at] = some[np.lexsort([*(k[some] for k in keys[depth + 1 :][::-1]), own[at]])]
    return rows


def multikey_order(keys: list[np.ndarray]) -> np.ndarray:
    """Order of rows by several keys: three-way partition on one key, equal rows go on with the next.

    Parts of a few rows are finished by a plain sort, as quicksort commonly does.
    """
    order = np.empty(len(keys[0]), np.int64)
    filled, stack = 0, [(np.arange(len(order)), 0)]
    while stack:
        rows, depth = stack.pop()
        if depth == len(keys) or len(rows) <= _LEAF:
            if depth < len(keys) and len(rows) > 1:
                rows = _leaf(rows, depth, keys)
            order[filled : filled + len(rows)] = rows
            filled += len(rows)
            continue
        own = keys[depth][rows]
        pivot = np.sort(own[:: max(1, len(own) // 9)])[4]
        stack += [(rows[own > pivot], depth), (rows[own == pivot], depth + 1), (rows[own < pivot], depth)]
    return order


def _least_by_string(pieces: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each position of each piece, the smallest document among equal strings of MATCH bytes."""
    lengths = np.array([len(p) for p in pieces])
    counts = lengths - MATCH + 1
    data = np.frombuffer(b"".join(pieces), np.uint8)
    begins = np.cumsum(lengths) - lengths
    inner = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    at = np.repeat(begins, counts) + inner
    words = _words(data, slice(None))
    keys = [words[at + k] for k in (*range(0, MATCH - 8, 8), MATCH - 8)]
    del words
    order = multikey_order(keys)
    new = np.ones(len(order), bool)
    new[1:] = False
    for k in keys:
        own = k[order]
        new[1:] |= own[1:] != own[:-1]
    owner = np.repeat(docs, counts)
    least = np.minimum.reduceat(owner[order], np.flatnonzero(new))
    out = np.empty(len(order), np.int64)
    out[order] = least[np.cumsum(new) - 1]
    return np.split(out, np.cumsum(counts)[:-1])


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Per block the pieces some of whose strings have a smaller document elsewhere: numbers, runs of smallest documents.

    The rows have the columns of shared tokens, with minus the number of pieces for a bucket.
    """
    parts = [_unpack(p) for p in table.column("packed").to_pylist()]
    tokens, docs, numbers = (np.concatenate([p[k] for p in parts]) for k in range(3))
    blocks = np.repeat(table.column("block").to_numpy(), [len(p[0]) for p in parts])
    pieces = [piece for p in parts for piece in p[3]]
    del parts
    distinct: dict[bytes, int] = {}
    which = np.array([distinct.setdefault(p, len(distinct)) for p in pieces])
    texts = list(distinct)
    least = np.full(len(texts), _NO_DOC)
    np.minimum.at(least, which, docs)
    token = np.zeros(len(texts), np.uint64)
    token[which] = tokens
    order = np.argsort(token, kind="stable")
    edges = np.append(np.flatnonzero(np.append(True, token[order][1:] != token[order][:-1])), len(order))
    found: dict[int, np.ndarray] = {}
    batch: list[int] = []
    weight = 0
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a > 1:  # pieces of one token that differ
            batch += order[a:b].tolist()
            weight += sum(len(texts[i]) - MATCH + 1 for i in order[a:b])
        if batch and (weight > SORT_ROWS or b == len(order)):
            found.update(zip(batch, _least_by_string([texts[i] for i in batch], least[batch])))
            batch, weight = [], 0
    out: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
    for row in range(len(pieces)):
        i = int(which[row])
        per = found.get(i)
        if per is None:
            if least[i] < docs[row]:
                out.setdefault(int(blocks[row]), []).append((int(numbers[row]), np.array([len(texts[i]) - MATCH + 1]), least[i : i + 1]))
        elif (per < docs[row]).any():
            new = np.flatnonzero(np.append(True, per[1:] != per[:-1]))
            out.setdefault(int(blocks[row]), []).append((int(numbers[row]), np.diff(np.append(new, len(per))), per[new]))
    rows = []
    for block, items in out.items():
        head = np.array([(n, len(r)) for n, r, _ in items], "<i4")
        body = [np.concatenate([x[k] for x in items]) for k in (1, 2)]
        rows.append((block, -len(items), head.tobytes() + body[0].astype("<i4").tobytes(), body[1].astype("<i8").tobytes()))
    return _table(SHARED, rows)


def _read_verdicts(table: pa.Table) -> dict[int, np.ndarray]:
    """Piece number -> smallest document for each position."""
    out = {}
    for n, runs_, docs in zip(*(table.column(c).to_pylist() for c in ("bucket", "tokens", "hot"))):
        numbers = np.frombuffer(runs_, "<i4")
        head, lengths, least = numbers[: -2 * n].reshape(-1, 2), numbers[-2 * n :], np.frombuffer(docs, "<i8")
        at = 0
        for number, k in head.tolist():
            out[number] = np.repeat(least[at : at + k], lengths[at : at + k])
            at += k
    return out


def covered(dups: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings that start where ``dups`` is set."""
    marks = np.flatnonzero(dups)
    if not len(marks):
        return []
    gap = np.flatnonzero(np.diff(marks) > MATCH)
    starts = np.append(marks[0], marks[gap + 1])
    ends = np.append(marks[gap], marks[-1]) + MATCH
    return list(zip(starts.tolist(), ends.tolist()))


def _remove(ranges: Ranges, kind: pa.Schema):
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = _texts(docs), _ids(docs)
        answers = answers.select(["block", "bucket", "tokens", "hot"])
        sign = answers.column("bucket").to_numpy() >= 0 if answers.num_rows else np.zeros(0, bool)
        shared, verdicts = answers.filter(pa.array(sign)), _read_verdicts(answers.filter(pa.array(~sign)))
        uses, found = _pieces(texts, ids, *_known(shared), ranges, False)
        least = found.least
        all_spans, kept = [], []
        for text, doc, own in zip(texts, ids.tolist(), uses):
            dups = np.zeros(max(0, len(text) - MATCH + 1), bool)
            for at, size, number in own:
                if least[number] < doc:
                    dups[at : at + size] = True
                elif (per := verdicts.get(number)) is not None:
                    dups[at : at + size] = per < doc
            spans = covered(dups)
            all_spans.append([{"start": a, "end": b} for a, b in spans])
            bounds = [0, *(x for s in spans for x in s), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(bounds[::2], bounds[1::2])) if spans else text)
        columns = [docs.column(c) for c in docs.column_names if c not in (_BLOCK, "n_bytes", "spans", "kept")]
        columns += [pa.array([len(t) for t in texts], pa.int64()), pa.array(all_spans, kind.field("spans").type), pa.array([k.decode(errors="ignore") for k in kept] if pa.types.is_string(kind.field("kept").type) else kept)]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, kind)], schema=kind)

    return run


def removals(docs: DataFrame, block_bytes=BLOCK_BYTES, bucket_bytes=BUCKET_BYTES, hot_docs=HOT_DOCS, whole=False) -> DataFrame:
    """The columns of ``docs`` (among them doc_id and text) and n_bytes, spans (removed byte ranges), kept.

    ``kept`` has the remaining bytes, or with ``whole`` a text, in which a character that lost some bytes is
    missing. Columns of these names are replaced.
    """
    docs = docs.drop("n_bytes", "spans", "kept").withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    rows, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // block_bytes))
    buckets = min(MAX_BUCKETS, max(1, -(-size // bucket_bytes)))
    ranges = Ranges(min(31, math.ceil(math.log2(buckets))))
    splitters = Splitters(_sample(docs, rows, SAMPLED * buckets), buckets)
    dealt = docs.withColumn(_BLOCK, F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))
    by_block = dealt.groupBy(_BLOCK)  # one shuffle of the texts serves all three steps
    sent = by_block.applyInArrow(_send_tokens(ranges), "bucket int, block long, tokens binary, docs binary")
    shared = sent.groupBy("bucket").applyInArrow(_find_shared(hot_docs), "block long, bucket int, tokens binary, hot binary")
    pieces = by_block.cogroup(shared.groupBy("block")).applyInArrow(_send_pieces(ranges, splitters), "bucket int, block long, packed binary")
    verdicts = pieces.groupBy("bucket").applyInArrow(_sort_bucket, "block long, bucket int, tokens binary, hot binary")
    nothing = F.expr("cast(array() as array<struct<start:long,end:long>>)")
    out = docs.withColumns({"n_bytes": F.lit(0).cast("long"), "spans": nothing, "kept": F.lit("" if whole else b"")})
    kind = to_arrow_schema(out.schema)
    return by_block.cogroup(shared.unionByName(verdicts).groupBy("block")).applyInArrow(_remove(ranges, kind), out.schema)


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the remaining text of each document, and n_chars, if there, of that."""
    aside = {c: f"__{c}" for c in docs.columns if c in ("n_bytes", "spans", "kept")}
    found = removals(docs.withColumnsRenamed(aside), whole=True, **settings)
    changes = {"text": F.col("kept")} | {c: F.col(a) for c, a in aside.items()}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.length("kept").cast(docs.schema["n_chars"].dataType)
    return found.select(*(changes.get(c, F.col(c)).alias(c) for c in docs.columns))


def digests(docs: DataFrame) -> DataFrame:
    found = removals(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
