"""SimHash near-duplicates: exact Hamming neighbours through vantage-point trees over overlapping shards.

A fingerprint has one bit for each bit position that is set in over half of the shingle hashes. Equal
fingerprints are one class from the start, so a group of exact copies costs one row.

A vantage-point tree halves the classes by their Hamming distance to a vantage point: near within a bound,
far beyond it. By the triangle inequality a class just beyond the bound can still have a neighbour within
it, so the near side is widened by the radius, and classes between the two bounds go to both sides. Any two
neighbours then meet on at least one side, whatever the bound. Measured over all 64 bits the widening would
take in a large part of the classes, for distances lie close together there. So there are two trees, one
for each half of the bits: neighbours within the radius are within half the radius in one of the halves,
and that is all its tree widens by. Where a half cannot split what it has, all bits are measured.

The upper part of the trees is grown on a sample of bounded size and sent to all tasks; its leaves are the
shards, and every class is sent to each shard that it, or a neighbour across a boundary, may lie in. Within
a shard the tree goes on down to leaves that are compared pair by pair. A leaf that no bound can split is
compared in full, so the result is exact for every input.

Links found in a shard leave it as a star per connected set (class -> smallest class), never as all
pairs. Components spread by taking the smallest label among neighbours, with pointer jumping, through
written tables until nothing changes.

Null and empty texts have fingerprint zero and link like any other. Repeated rows share a class. A row
whose doc_id is null takes part, but is never the smallest id unless its whole component has none; a very
long text is hashed in slices; an empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.llm.common import cut, discard, utf8

RADIUS = 3
SHINGLE = 3
SEED = 42
BITS = 64
#: Bits of the two halves.
HALVES = ((1 << 32) - 1, ((1 << 32) - 1) << 32)
WHOLE = (1 << 64) - 1
#: Classes in a shard, about, as long as there are no more shards of a tree than this; sampled classes for each shard.
SHARD = 4096
MAX_SHARDS = 8192
SAMPLED = 16
#: Leaves of a tree that are compared pair by pair, and the share of the classes that a side of a split may keep.
LEAF = 128
_ROWS = 128
_TINY = 24
PROGRESS = 0.85
#: Classes that are sent to their shards together.
TOGETHER = 200_000
_BLANK = bytes.maketrans(bytes(range(9, 14)), b" " * 5)
_SLICE = 1 << 16


def shingles(text: bytes, size: int = SHINGLE) -> list[bytes]:
    words = [w for w in text.lower().translate(_BLANK).split(b" ") if w]
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return [b" ".join(s) for s in zip(*(words[i:] for i in range(size)))]


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The unsigned fingerprint of a text in UTF-8."""
    return majority(shingles(text, size))


def majority(parts: list[bytes]) -> int:
    """The unsigned fingerprint of shingles."""
    ones = np.zeros(BITS, np.int64)
    digest = xxhash.xxh64_digest
    for start in range(0, len(parts), _SLICE):
        hashes = b"".join([digest(s, SEED) for s in parts[start : start + _SLICE]])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(parts)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp long (the 64 bits, signed) of every whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([fingerprint(t) for t in utf8(part.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class Split(NamedTuple):
    """Near: within ``bound`` of the vantage point in the bits of ``mask``, widened by ``slack``; far: beyond the bound."""

    vantage: int
    mask: int
    bound: int
    slack: int

    def sides(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        away = _hamming(points & np.uint64(self.mask), np.uint64(self.vantage & self.mask))
        return np.flatnonzero(away <= self.bound + self.slack), np.flatnonzero(away > self.bound)


def split(points: np.ndarray, half: int, radius: int = RADIUS) -> Split | None:
    """The most even split by the first point in one half of the bits, or else in all bits."""
    for mask, slack in ((half, radius if half == WHOLE else radius // 2), (WHOLE, radius)):
        vantage = int(points[0])
        within = np.cumsum(np.bincount(_hamming(points & np.uint64(mask), np.uint64(vantage & mask)), minlength=BITS + radius + 1))
        larger = np.maximum(within[slack : BITS + slack + 1], within[-1] - within[: BITS + 1])
        bound = int(larger.argmin())
        if larger[bound] <= PROGRESS * len(points):
            return Split(vantage, mask, bound, slack)
    return None


class Tree(NamedTuple):
    """Inner nodes as (split, near child, far child); a child below zero is shard -1 - child."""

    nodes: list[tuple[Split, int, int]]
    shards: int

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, positions of the points that may have a neighbour there)."""
        stack = [(0 if self.nodes else -1, np.arange(len(points)))]
        while stack:
            node, own = stack.pop()
            if not len(own):
                continue
            if node < 0:
                yield -1 - node, own
                continue
            cut_, *children = self.nodes[node]
            stack += [(child, own[side]) for child, side in zip(children, cut_.sides(points[own]))]


def grow(sample: np.ndarray, half: int, leaf: int, radius: int = RADIUS) -> Tree:
    """A tree whose leaves hold at most ``leaf`` of the sampled points, unless those cannot be split."""
    nodes: list[tuple[Split, int, int]] = []
    shards = 0
    stack = [(sample, -1, 0)]
    while stack:
        points, parent, side = stack.pop()
        found = split(points, half, radius) if len(points) > leaf else None
        if found is None:
            place, shards = -1 - shards, shards + 1
        else:
            place = len(nodes)
            nodes.append((found, 0, 0))
            near, far = found.sides(points)
            stack += [(points[near], place, 1), (points[far], place, 2)]
        if parent >= 0:
            nodes[parent] = tuple(place if k == side else old for k, old in enumerate(nodes[parent]))
    return Tree(nodes, shards)


def near_pairs(points: np.ndarray, half: int = WHOLE, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) that cover every pair of ``points`` within the radius, by vantage splits down to small leaves."""
    stack = [np.arange(len(points))]
    while stack:
        side = stack.pop()
        own = points[side]
        found = split(own, half, radius) if len(side) > LEAF else None
        if found is not None:
            stack += [side[k] for k in found.sides(own)]
            continue
        for at in range(0, len(side), _ROWS):
            left, right = np.nonzero(_hamming(own[at : at + _ROWS, None], own[None, at:]) <= radius)
            ahead = left < right
            if ahead.any():
                yield side[at + left[ahead]], side[at + right[ahead]]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n points the smallest point it is connected with."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for left, right in pairs:
        for a, b in zip(left.tolist(), right.tolist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    return np.array([find(x) for x in range(n)], np.int64)


def _linked(keys: np.ndarray, points: np.ndarray, radius: int) -> pa.RecordBatch:
    """Stars of the shards in (keys, points), which are sorted by key; keys below zero are of the second half."""
    tails, heads = [], []
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    small = sizes <= _TINY
    inside = np.repeat(sizes, sizes)
    for step in range(1, int(sizes[small].max(initial=1))):  # all tiny shards at once, by distance in the order
        at = np.flatnonzero((keys[step:] == keys[:-step]) & (inside[step:] <= _TINY))
        hit = at[_hamming(points[at], points[at + step]) <= radius]
        tails.append(points[hit + step])
        heads.append(points[hit])
    for start, size in zip(starts[~small].tolist(), sizes[~small].tolist()):
        own = points[start : start + size]
        root = _roots(size, near_pairs(own, HALVES[int(keys[start] < 0)], radius))
        moved = np.flatnonzero(root != np.arange(size))
        tails.append(own[moved])
        heads.append(own[root[moved]])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(join(x).view(np.int64)) for x in (tails, heads)], names=["u", "v"])


def _shards(radius: int):
    """Search complete shards of a partition that is sorted by key; the last one waits for its rest."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, points = [], []
        for part in parts:
            own, new = part.column(0).to_numpy(), part.column(1).to_numpy().view(np.uint64)
            if len(own) and keys and keys[0][0] != own[-1] and sum(map(len, keys)) > 20_000:
                done = int(np.searchsorted(own, own[-1]))
                yield _linked(np.concatenate([*keys, own[:done]]), np.concatenate([*points, new[:done]]), radius)
                keys, points, own, new = [], [], own[done:], new[done:]
            keys.append(own)
            points.append(new)
        if keys:
            yield _linked(np.concatenate(keys), np.concatenate(points), radius)

    return run


def trees(classes: DataFrame, shard: int = SHARD, radius: int = RADIUS) -> list[Tree]:
    """One tree for each half, grown on a sample of at most ``SAMPLED * MAX_SHARDS`` classes, about."""
    total = classes.count()
    wanted = min(MAX_SHARDS, max(1, total // shard))
    fraction = min(1.0, SAMPLED * wanted / max(1, total))
    sample = np.sort(classes.select("fp").sample(fraction=fraction, seed=SEED).toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    mixed = np.random.default_rng(SEED).permutation(sample)
    return [grow(mixed, half, SAMPLED, radius) if wanted > 1 else Tree([], 1) for half in HALVES]


def _sent(forest: list[Tree]):
    """(shard, fp): each class to every shard of both trees that it may have a neighbour in."""

    def routed(points: np.ndarray) -> Iterator[pa.RecordBatch]:
        for tree, sign in zip(forest, (1, -1)):
            for shard, own in tree.route(points):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), sign * (shard + 1), np.int32)), pa.array(points[own].view(np.int64))], names=["shard", "fp"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for part in parts:
            held.append(part.column(0).to_numpy().view(np.uint64))
            if sum(map(len, held)) >= TOGETHER:
                yield from routed(np.concatenate(held))
                held = []
        if held:
            yield from routed(np.concatenate(held))

    return run


def links(classes: DataFrame, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between classes (column fp) that connect exactly what lies within the radius."""
    sent = classes.select("fp").mapInArrow(_sent(trees(classes, shard, radius)), "shard int, fp long")
    return sent.repartition("shard").sortWithinPartitions("shard").mapInArrow(_shards(radius), "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): every node of ``edges`` (u, v) with the smallest node it is connected with."""
    edges = cut(edges.distinct())
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels.node == near.u, "left").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        after = cut(spread.join(up, "label", "left").select("node", "was", F.least("label", "up").alias("label")))
        changed = not after.filter("was <> label").isEmpty()
        discard(labels)
        labels = after.select("node", "label")
        labels.proofloom_path = after.proofloom_path
        if not changed:
            discard(edges)
            return labels


def _named(marked: DataFrame, shard: int, radius: int) -> DataFrame:
    """fp, label (of the component), component_id for the distinct fingerprints of ``marked`` (doc_id, fp)."""
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(distinct, shard, radius))
    grouped = distinct.join(labels, distinct.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    smallest = grouped.groupBy("label").agg(F.min("least").alias("component_id"))
    named = cut(grouped.join(smallest, "label").select("fp", "label", "component_id"))
    discard(distinct, labels)
    return named


def classes(docs: DataFrame, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id for every row of ``docs``."""
    marked = cut(fingerprints(docs))
    return marked.join(_named(marked, shard, radius), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, shard: int = SHARD, radius: int = RADIUS) -> DataFrame:
    """One row of each component, with the columns of ``docs``: the one with the smallest id, the first of repeated ones."""
    marked = cut(_with_fingerprint(docs))
    named = _named(marked.select(F.col("doc_id").cast("long"), F.col("__own").alias("fp")), shard, radius)
    keep = named.select(F.col("fp").alias("__fp"), F.col("component_id").alias("__component_id"), F.col("label").alias("__label"))
    first = marked.join(keep, F.col("__own") == F.col("__fp")).filter(F.col("doc_id").cast("long").eqNullSafe(F.col("__component_id")))
    return first.dropDuplicates(["__label"]).select(*docs.columns)


def _with_fingerprint(docs: DataFrame) -> DataFrame:
    out = docs.withColumn("__own", F.lit(0).cast("long"))
    at = docs.columns.index("text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.array([fingerprint(t) for t in utf8(part.column(at).cast(pa.string()))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(found)], schema=part.schema)

    return out.mapInArrow(run, out.schema)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return classes(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
