"""Exact nearest neighbours by cosine with a metric index: pivots, distance bounds for each cell, and two passes.

A vector belongs to the cell of the pivot with the smallest angle to it; the index stores cells in chunks of about
``CHUNK`` vectors, and knows for each cell how many vectors it has and the range of their angles to the pivot. Angles
obey the triangle inequality, so no vector of a cell lies nearer to a query than the query's angle to the pivot is
outside that range. The first pass asks the nearest cells that have k vectors between them, which gives each query
an angle within which its k neighbours lie. The second pass asks those other cells that may hold a vector within it. Cells
that neither pass asks are never joined with the query.

``scope`` splits the vectors: a query sees those of its own scope only, so a filter by tenant is inside the search.
Pivots are a bounded sample and decide the speed, not the result. Vectors without a direction (null, zero or non-finite)
have no similarity and come after all others in the order of ties; a query without a direction gets the first k rows so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofloom.sources.stored import stored

MAX_PIVOTS = 2048
#: Rows of bounds (scopes times cells) that the driver holds and tasks get.
MAX_BOUNDS = 200_000
CHUNK = 1024
#: Queries of a cell that meet a chunk in one product.
PACK = 256
#: Angles closer than this are not told apart by the bounds.
SLACK = 1e-6


@dataclass
class MetricIndex:
    """Pivots, bounds by (scope, cell): number of vectors and least and largest angle; chunks as a stored table."""

    pivots: np.ndarray
    bounds: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    chunks: DataFrame
    loose: DataFrame
    ties: list[str]
    columns: list[str]


def _directed(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce((norm > 0) & (norm < F.lit(float("inf"))), F.lit(False))


def _units(cells: pa.Array) -> np.ndarray:
    a = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(cells), -1)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def _assign(pivots: np.ndarray, at: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            angles = _angles(_units(part.column(at)), pivots) if part.num_rows else np.zeros((0, len(pivots)))
            cell = angles.argmin(axis=1) if part.num_rows else np.zeros(0, np.int64)
            near = angles[np.arange(part.num_rows), cell]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(near, pa.float64())], names=[*part.schema.names, "__cell", "__angle"])

    return run


def build(vectors: DataFrame, ties: list[str], scope: str | None = None, pivots: int | None = None, chunk: int = CHUNK) -> MetricIndex:
    """The index of ``vectors`` (embedding and other columns). ``ties`` order equal similarities; ``scope`` is a string column."""
    columns = [c for c in vectors.columns if c not in ("embedding", scope)]
    own = vectors.select(F.coalesce(F.col(scope), F.lit("")).alias("__scope") if scope else F.lit("").alias("__scope"), *columns, "embedding")
    usable = own.filter(_directed(F.col("embedding")))
    total, scopes = usable.agg(F.count(F.lit(1)), F.count_distinct("__scope")).first()
    wanted = pivots or max(1, min(MAX_PIVOTS, math.isqrt(total), MAX_BOUNDS // max(1, scopes)))
    sample = usable.select("embedding").orderBy(F.xxhash64(*ties), *ties).limit(wanted).toArrow()
    found = _units(sample.column(0).combine_chunks()) if sample.num_rows else np.zeros((1, 1))
    kinds = T.StructType([*usable.schema.fields, T.StructField("__cell", T.IntegerType()), T.StructField("__angle", T.DoubleType())])
    placed = stored(usable.mapInArrow(_assign(found, len(columns) + 1), kinds))
    cells = placed.groupBy("__scope", "__cell").agg(F.count(F.lit(1)).alias("n"), F.min("__angle").alias("least"), F.max("__angle").alias("most"))
    bounds: dict[str, tuple] = {}
    if len(found) > 1:  # with one pivot a scope is one cell, and there is nothing to choose
        table = cells.toPandas().sort_values(["__scope", "__cell"])
        bounds = {s: tuple(g[c].to_numpy() for c in ("__cell", "n", "least", "most")) for s, g in table.groupby("__scope")}
    sized = cells.select("__scope", "__cell", F.ceil(F.col("n") / F.lit(chunk)).alias("__parts"))
    dealt = placed.join(sized, ["__scope", "__cell"]).withColumn("__part", F.pmod(F.xxhash64(*ties), F.col("__parts")))
    row = F.struct(*ties, *(c for c in columns if c not in ties), "embedding")
    chunks = stored(dealt.groupBy("__scope", "__cell", "__part").agg(F.array_sort(F.collect_list(row)).alias("__rows")))
    return MetricIndex(found, bounds, chunks, own.filter(~_directed(F.col("embedding"))).drop("embedding"), ties, columns)


def _route(index: MetricIndex, k: int, second: bool):
    """(query_id, scope, embedding, cell) of the first pass, or of the second for queries with the angle that is still of interest."""
    pivots, bounds = index.pivots, index.bounds

    def cells(scope: str, angles: np.ndarray, reach: float | None) -> np.ndarray:
        if len(pivots) == 1:
            return np.zeros(0 if second else 1, np.int64)
        if scope not in bounds:
            return np.zeros(0, np.int64)
        own, n, least, most = bounds[scope]
        away = angles[own]
        order = np.argsort(away, kind="stable")
        first = order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]
        if not second:
            return own[first]
        rest = np.setdiff1d(np.arange(len(own)), first)
        if reach is None:
            return own[rest]
        low = np.maximum(away[rest] - most[rest], least[rest] - away[rest])
        return own[rest[low <= reach + SLACK]]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if not part.num_rows:
                continue
            angles = _angles(_units(part.column(2)), pivots) if pivots.shape[1] > 1 or len(pivots) > 1 else np.zeros((part.num_rows, 1))
            reach = part.column(3).to_pylist()
            found = [cells(s, a, r) for s, a, r in zip(part.column(1).to_pylist(), angles, reach)]
            at = pa.array(np.repeat(np.arange(part.num_rows), [len(f) for f in found]))
            cell = pa.array(np.concatenate(found).astype(np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), cell], names=["query_id", "__scope", "embedding", "__cell"])

    return run


def similarities(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines, added up one dimension after the other: equal vectors have equal cosines wherever they lie."""

    def added(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros((a.shape[1], b.shape[1]))
        for x, y in zip(a, b):
            out += x[:, None] * y[None, :]
        return out

    a, b = np.ascontiguousarray(rows.T), np.ascontiguousarray(queries.T)
    squares = [np.sqrt(sum((x * x for x in m), np.zeros(m.shape[1]))) for m in (a, b)]
    return added(a, b) / (squares[0][:, None] * squares[1][None, :])


def _compare(k: int):
    """(query_id, row, similarity) of the k best rows of a chunk for each query of a pack."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for rows, asked in zip(part.column(0), part.column(1)):
                own, queries = rows.values, asked.values
                matrix = lambda s: s.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(s), -1)
                cosines = similarities(matrix(own), matrix(queries))
                best = np.argsort(-cosines, axis=0, kind="stable")[:k]  # rows lie in the order of ties
                at, of = best.T.ravel(), np.repeat(np.arange(len(queries)), len(best))
                names = [f.name for f in own.type if f.name != "embedding"]
                kept = pa.StructArray.from_arrays([own.field(n).take(pa.array(at)) for n in names], names=names)
                yield pa.RecordBatch.from_arrays([queries.field("query_id").take(pa.array(of)), kept, pa.array(cosines[at, of])], names=["query_id", "row", "similarity"])

    return run


def _asked(routed: DataFrame, index: MetricIndex, k: int) -> DataFrame:
    """The best rows of each cell for the queries that ask it."""
    sized = routed.groupBy("__scope", "__cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PACK)).alias("__packs"))
    dealt = routed.join(sized, ["__scope", "__cell"]).withColumn("__pack", F.pmod(F.xxhash64("query_id"), F.col("__packs")))
    packs = dealt.groupBy("__scope", "__cell", "__pack").agg(F.collect_list(F.struct("query_id", "embedding")).alias("__asked"))
    pairs = index.chunks.join(packs, ["__scope", "__cell"]).select("__rows", "__asked")
    row = T.StructType([f for f in index.chunks.schema["__rows"].dataType.elementType if f.name != "embedding"])
    kinds = T.StructType([routed.schema["query_id"], T.StructField("row", row), T.StructField("similarity", T.DoubleType())])
    return pairs.mapInArrow(_compare(k), kinds)


def _first(rows: DataFrame, k: int, order: list[Column]) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("similarity"), *order)))
    return ranked.filter(F.col("rank") <= k)


def routes(queries: DataFrame, index: MetricIndex, k: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cells that the first and the second pass ask, and what the first finds. ``queries``: query_id, embedding, __scope."""
    kinds = T.StructType([queries.schema["query_id"], T.StructField("__scope", T.StringType()), queries.schema["embedding"], T.StructField("__cell", T.IntegerType())])
    plain = queries.select("query_id", "__scope", "embedding", F.lit(None).cast("double").alias("__reach"))
    first = plain.mapInArrow(_route(index, k, False), kinds)
    order = [F.col(f"row.{t}") for t in index.ties]
    near = stored(_first(_asked(first, index, k), k, order).drop("rank"))
    reach = near.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("similarity").alias("s"))
    known = reach.select("query_id", F.when(F.col("n") >= k, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("s"))))).alias("__reach"))
    second = queries.join(known, "query_id", "left").select("query_id", "__scope", "embedding", "__reach").mapInArrow(_route(index, k, True), kinds)
    return first, second, near


def nearest(queries: DataFrame, index: MetricIndex, k: int, scope: str | None = None) -> DataFrame:
    """query_id, the index's columns, similarity, rank of the k nearest vectors. No threshold: neighbours always come back."""
    own = queries.select("query_id", "embedding", F.coalesce(F.col(scope), F.lit("")).alias("__scope") if scope else F.lit("").alias("__scope"))
    led = own.filter(_directed(F.col("embedding")))
    _, second, near = routes(led, index, k)
    order = [F.col(f"row.{t}") for t in index.ties]
    found = near.unionByName(_asked(second, index, k))
    row = found.schema["row"].dataType
    # rows without a direction: the first k of a scope, for queries that have fewer neighbours or no direction themselves
    names = [f.name for f in row]
    by_ties = Window.partitionBy("__scope").orderBy(*index.ties)
    heads = lambda rows: rows.withColumn("__r", F.row_number().over(by_ties)).filter(F.col("__r") <= k)
    none = F.lit(None).cast("double").alias("similarity")
    loose = led.join(heads(index.loose), "__scope").select("query_id", F.struct(*names).alias("row"), none)
    stray = own.filter(~_directed(F.col("embedding")))
    inside = index.chunks.select("__scope", F.explode(F.slice("__rows", 1, k)).alias("__r")).select("__scope", *(F.col(f"__r.{n}").alias(n) for n in names))
    every = heads(index.loose.select("__scope", *names).unionByName(inside))
    aimless = stray.join(every, "__scope").select("query_id", F.struct(*names).alias("row"), none)
    whole = _first(found.unionByName(loose).unionByName(aimless), k, order)
    return whole.select("query_id", *(F.col(f"row.{c}").alias(c) for c in index.columns), "similarity", "rank")
