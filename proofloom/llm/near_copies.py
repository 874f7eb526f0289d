"""Near copies by SimHash: vantage-point search over fingerprints, banded candidates beyond its radius, an exact check.

Texts with the same set of shingles are one class. The vantage-point trees of ``simhash`` find all classes whose
fingerprints differ in at most ``LINKED`` bits. No tree halves 64 bits at the ten or so in which texts of similarity
0.8 differ, so farther ones are sought in shards of the shingles besides: a class is dealt to ``BANDS`` shards, each keyed by
``ROWS`` minima of seeded hashes over its shingles: two classes of similarity s meet with probability
1 - (1 - s ** ROWS) ** BANDS, which is 0.9996 at 0.8. Classes that meet there are a candidate where their
fingerprints differ in at most ``RADIUS`` bits, those within ``LINKED`` bits always are, and a candidate
counts only where the shingle sets themselves reach the similarity.

A class goes if a class with a smaller least id reaches the similarity, whether that one stays or not; so what
stays depends on the texts and ids alone, no two classes that stay were found similar, and the smallest of a chain
of similar texts always stays. Classes that are connected through near fingerprints or shared shards make a group, every candidate lies
within one, and the group only says which classes have to meet. It is dealt by a hash into blocks of about ``BLOCK``
bytes of text. A block is read in the order of the least ids: each class is held against those before it, up to the
first that is similar, so pairs are never rows and a task holds one block. What is left of a group of several blocks
is then dealt into blocks of its own, and each of them meets each other block of the group. Copies of one text fall
to the first of their block, so what is left of a large group is small; only where most of a large group is in no
way similar does every block meet every other.

Null and empty texts are one class. Of repeated rows one stays. A null id is larger than all others. A very
long text is hashed in slices, and only where it may have a near copy is it compared; an empty table gives an
empty table. Other columns stay; those that begin with two underscores are this module's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofloom.llm import simhash
from proofloom.llm.common import cut, utf8
from proofloom.llm.simhash import SEED, components, majority, shingles

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
#: Differing bits within which the vantage-point trees find every pair.
LINKED = simhash.RADIUS
BANDS, ROWS = 20, 5
#: Bytes of text that meet in one task, but for a single longer text.
BLOCK = 8_000_000
_MASK = (1 << 64) - 1
_SLICE = 4096
_LAST = (1 << 63) - 1


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (2, BANDS * ROWS, 1), dtype=np.uint64)
    return draw[0], draw[1] * np.uint64(2) + np.uint64(1)


def signature(text: bytes, size: int, seeds: tuple[np.ndarray, np.ndarray]) -> tuple[int, int, list[int]]:
    """Class, SimHash and band keys (signed) of a text; a text without words has no bands."""
    parts = shingles(text, size)
    sets = np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in parts]), np.uint64))
    signed = lambda digest: int.from_bytes(digest, "big", signed=True)
    own = signed(xxhash.xxh64_digest(sets.tobytes(), SEED))
    fp = majority(parts)
    if not len(sets):
        return own, fp, []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(sets), _SLICE):
        least = np.minimum(least, ((sets[start : start + _SLICE] ^ seeds[0]) * seeds[1]).min(axis=1))
    keys = [signed(xxhash.xxh64_digest(band.tobytes(), k)) for k, band in enumerate(least.reshape(BANDS, ROWS))]
    return own, fp - (1 << 64) if fp >> 63 else fp, keys


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """``docs`` with __class, __fp and __bands."""
    at = docs.columns.index("text")
    added = [T.StructField("__class", T.LongType()), T.StructField("__fp", T.LongType()), T.StructField("__bands", T.ArrayType(T.LongType()))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds()
        for part in parts:
            own, fps, bands = zip(*(signature(t, size, seeds) for t in utf8(part.column(at).cast(pa.string())))) if part.num_rows else ((), (), ())
            more = [pa.array(own, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "__class", "__fp", "__bands"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


def _linked(live: DataFrame, linked: int) -> DataFrame:
    """Edges (u, v) that connect the classes whose fingerprints differ in at most ``linked`` bits."""
    firsts = cut(live.groupBy("fp").agg(F.min("class").alias("first")))
    same = live.join(firsts, "fp").filter("class <> first").select(F.col("class").alias("u"), F.col("first").alias("v"))
    near = simhash.links(firsts, radius=linked).distinct()
    for end in ("u", "v"):
        near = near.join(firsts.select(F.col("fp").alias(end), F.col("first").alias(f"first_{end}")), end)
    return same.unionByName(near.select(F.col("first_u").alias("u"), F.col("first_v").alias("v")))


def _connected(live: DataFrame, linked: int) -> DataFrame:
    """node (class), label (of its group) of the classes that have a near fingerprint or share a shard with another.

    A class is linked to the smallest of the first classes of its shards, and so are those first classes: one link a class, not one a shard.
    """
    keys = live.select(F.explode("bands").alias("key"), "class")
    firsts = keys.groupBy("key").agg(F.min("class").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    met = keys.join(firsts, "key").filter("class <> first").groupBy("class").agg(F.min("first").alias("v"), F.collect_set("first").alias("firsts"))
    between = met.select(F.explode("firsts").alias("u"), "v").filter("u <> v").distinct()
    return components(met.select(F.col("class").alias("u"), "v").unionByName(between).unionByName(_linked(live, linked)))


def shingle_set(text: bytes, size: int) -> frozenset[bytes]:
    """Hashes of 64 bits of a text's shingles."""
    return frozenset(xxhash.xxh64_digest(s, SEED) for s in shingles(text, size))


def _read_blocks(size: int, similarity: float, radius: int, linked: int):
    """class of those that go; the rows (label, turn, part, asks, answers, class, fp, bands, text) come sorted by the first three and least id.

    A row that asks is held against the rows before it that answer and have a fingerprint within ``linked`` bits, or within the radius and a band with it.
    """

    def similar(a: frozenset, b: frozenset) -> bool:
        if min(len(a), len(b)) < similarity * max(len(a), len(b)):
            return False
        common = len(a & b)
        return common >= similarity * (len(a) + len(b) - common)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, fps, sets, holders = None, np.zeros(1024, np.uint64), [], {}
        for part in parts:
            gone = []
            columns = [part.column(k).to_pylist() for k in range(8)]
            for label, turn, other, asks, answers, own, fp, keys, text in zip(*columns, utf8(part.column(8))):
                if (label, turn, other) != block:
                    block, sets, holders = (label, turn, other), [], {}
                mine, own_fp = shingle_set(text, size), np.uint64(fp & _MASK)
                if asks:
                    away = np.bitwise_count(fps[: len(sets)] ^ own_fp)
                    met = {k for key in keys for k in holders.get(key, ()) if away[k] <= radius}
                    if any(similar(sets[k], mine) for k in sorted(met.union(np.flatnonzero(away <= linked).tolist()))):
                        gone.append(own)
                if answers:
                    for key in keys:
                        holders.setdefault(key, []).append(len(sets))
                    if len(sets) == len(fps):
                        fps = np.append(fps, np.zeros_like(fps))
                    fps[len(sets)] = own_fp
                    sets.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(gone, pa.int64())], names=["class"])

    return run


def _blocks(rows: DataFrame, name: str, block: int) -> DataFrame:
    """label and the number of blocks that its rows fill."""
    return rows.groupBy("label").agg(F.ceil(F.sum(F.octet_length("text") + 64) / F.lit(block)).alias(name))


def kept(signed: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """class, least (id), rows with that id of the classes of ``signed`` that stay."""
    sized = signed.groupBy("__class", "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.first("__fp").alias("fp"), F.first("__bands").alias("bands"))
    sized = sized.withColumn("least", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    live = sized.groupBy(F.col("__class").alias("class")).agg(F.min_by(F.struct("doc_id", "rows", "least"), "least").alias("id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    live = cut(live.select("class", "id.doc_id", "id.rows", "id.least", "fp", "bands"))
    linked = min(LINKED, radius)
    labels = _connected(live, linked)
    texts = signed.select("__class", F.col("text").cast("string").alias("text")).join(labels, F.col("__class") == F.col("node"), "left_semi")
    texts = texts.groupBy("__class").agg(F.min("text").alias("text"))
    members = live.join(labels, F.col("class") == F.col("node")).join(texts, F.col("class") == F.col("__class"))
    members = cut(members.select("label", "class", "least", "fp", "bands", "text"))
    dealt = members.join(_blocks(members, "parts", block), "label").withColumn("part", F.pmod(F.xxhash64("class"), F.col("parts")))
    place = ["label", "turn", "part"]
    fields = [*place, "asks", "answers", "class", "fp", "bands", "text"]

    def read(rows: DataFrame) -> DataFrame:
        ordered = rows.select(*fields, "least").repartition(*place).sortWithinPartitions(*place, "least", "class")
        return cut(ordered.select(*fields).mapInArrow(_read_blocks(size, similarity, radius, linked), "class long"))

    yes, no = F.lit(True), F.lit(False)
    went = read(dealt.withColumns({"turn": F.lit(0).cast("long"), "asks": yes, "answers": yes}))
    wide = dealt.filter("parts > 1")
    if not wide.isEmpty():
        left = wide.join(went, "class", "left_anti")
        turns = _blocks(left, "turns", block)
        others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda k: k != F.col("part")))
        asking = left.join(turns, "label").withColumns({"turn": F.pmod(F.xxhash64("class", F.lit(2)), F.col("turns")), "asks": yes, "answers": no})
        asking = asking.withColumn("other", others).drop("part").withColumnRenamed("other", "part")
        answering = wide.join(turns, "label").withColumns({"turn": F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)), "asks": no, "answers": yes})
        went = went.unionByName(read(asking.select(*fields, "least").unionByName(answering.select(*fields, "least"))))
    return live.join(went.distinct(), "class", "left_anti").select("class", "doc_id", "rows")


def deduplicate(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns."""
    signed = cut(_signed(docs, size))
    keep = kept(signed, size, similarity, radius).select(*(F.col(c).alias(f"__{new}") for c, new in (("class", "own"), ("doc_id", "least"), ("rows", "rows"))))
    found = signed.join(keep, (F.col("__class") == F.col("__own")) & F.col("doc_id").eqNullSafe(F.col("__least")))
    once = found.filter("__rows = 1").select(*docs.columns)
    return once.unionByName(found.filter("__rows > 1").dropDuplicates(["__class"]).select(*docs.columns))
