"""Whitening of embeddings by a tiled covariance.

The vectors are scaled to whole numbers, and each distinct one counts once: the fit list, a written table. Its sums by
dimension are exact. For the covariance the list is read in row blocks; a block is split into column blocks of ``TILE``
dimensions, these are shuffled by their row block, and each pair of them is centred and multiplied: a product for the
tile of that pair of dimension ranges. Products are summed per tile, within tasks first. The tiles are put together
into one matrix, as large as the dimensions and not the rows make it, whose eigenvectors are the components. Vectors
are centred, projected and scaled row by row; the covariance of the whitened fit list is worked out in tiles as well.

Vectors that are null, or hold null or non-finite entries, are dropped, and so are those whose length is not that of
most vectors (of the longer ones in a tie). Entries beyond +-2^62 count as that. A component without variance, as of
fewer distinct vectors than dimensions, has null as whitened value, and ``identity_error`` is over the others; with
none it is null, and ``explained`` is null where nothing varies. A deviation beyond 64 bits is null. Rows that repeat
are rows of the result each, a null id is kept, an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proofloom.llm.common import cut, discard

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
#: Dimensions of a column block.
TILE = 32
#: Share of the whole variance from which a component counts as one.
LEAST_SHARE = 1e-12
_LARGE = 1 << 62
_LONG = (1 << 63) - 1


def usable(rows: DataFrame, column: str) -> DataFrame:
    """The rows with a whole, finite vector of the common length."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    whole = rows.filter(F.col(column).isNotNull() & finite)
    common = whole.groupBy(F.size(column).alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("length")).limit(1).first()
    return whole.filter(F.size(column) == (common["length"] if common else 0))


def scaled(vector: Column) -> Column:
    """Each entry as a whole number."""
    large = float(_LARGE)
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * F.lit(float(SCALE)), F.lit(-large)), F.lit(large))) + F.lit(OFFSET))


def matrix(part: pa.RecordBatch, column: int = 0) -> np.ndarray:
    cells = part.column(column).flatten().to_numpy()
    return cells.reshape(part.num_rows, -1)


def _sums(a: np.ndarray) -> np.ndarray:
    """Sums of columns, exact for whole numbers."""
    if a.dtype.kind == "i" and len(a) and int(np.abs(a).max()) > (1 << 40):
        a = a.astype(object)
    return a.sum(axis=0)


def totals(cells: DataFrame) -> tuple[int, list]:
    """Number of vectors and their sums by dimension; of whole numbers the sums are exact."""
    whole = isinstance(cells.schema[0].dataType.elementType, T.LongType)
    kind, arrow = ("decimal(38,0)", pa.decimal128(38, 0)) if whole else ("double", pa.float64())
    as_value = (lambda v: Decimal(int(v))) if whole else float

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for part in parts:
            if part.num_rows:
                own = _sums(matrix(part))
                own = own.astype(object) if whole else own
                n, sums = n + part.num_rows, own if sums is None else sums + own
        if n:
            dims = pa.array(range(len(sums)), pa.int32())
            yield pa.RecordBatch.from_arrays([dims, pa.array([n] * len(sums), pa.int64()), pa.array(list(map(as_value, sums)), arrow)], names=["dim", "n", "total"])

    found = cells.mapInArrow(run, f"dim int, n long, total {kind}").groupBy("dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).orderBy("dim").collect()
    return (found[0]["n"] if found else 0), [int(r["total"]) if whole else r["total"] for r in found]


def _smallest(a: np.ndarray) -> np.ndarray:
    """Whole numbers in the smallest type that holds them."""
    if a.dtype.kind != "i" or not a.size:
        return a
    return a.astype(np.result_type(np.min_scalar_type(int(a.min())), np.min_scalar_type(int(a.max())), np.int8))


def column_blocks(cells: DataFrame, base: np.ndarray, tile: int) -> DataFrame:
    """row_block, block (of columns), n, kind, cells: the vectors less ``base``, in pieces of ``tile`` dimensions."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for k, part in enumerate(parts):
            if not part.num_rows:
                continue
            a = matrix(part) - base
            pieces = [_smallest(a[:, c : c + tile]) for c in range(0, a.shape[1], tile)]
            count = len(pieces)
            yield pa.RecordBatch.from_arrays(
                [pa.array([task << 32 | k] * count, pa.int64()), pa.array(range(count), pa.int32()), pa.array([part.num_rows] * count, pa.int64()),
                 pa.array([p.dtype.str for p in pieces]), pa.array([p.tobytes() for p in pieces], pa.binary())],
                names=["row_block", "block", "n", "kind", "cells"],
            )

    return cells.mapInArrow(run, "row_block long, block int, n long, kind string, cells binary")


def _products(rest: np.ndarray, tile: int):
    """(i, j, cells) from pairs of column blocks: the sums of products that a task has found for each tile."""

    def read(kind: str, cells: bytes, n: int, block: int) -> np.ndarray:
        return np.frombuffer(cells, np.dtype(kind)).reshape(n, -1).astype(np.float64) - rest[block * tile : (block + 1) * tile]

    def given(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        i, j = zip(*sums)
        return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([v.ravel() for v in sums.values()], pa.list_(pa.float64()))], names=["i", "j", "cells"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for part in parts:
            for i, j, n, kind, cells, other_kind, other in zip(*(part.column(k).to_pylist() for k in range(7))):
                product = read(kind, cells, n, i).T @ read(other_kind, other, n, j)
                sums[i, j] = sums[i, j] + product if (i, j) in sums else product
                if len(sums) >= 1024:
                    yield given(sums)
                    sums = {}
        if sums:
            yield given(sums)

    return run


def covariance(cells: DataFrame, n: int, sums: list, tile: int = TILE) -> np.ndarray:
    """Covariance of vectors (one array column, read the same way each time), centred before multiplying, divisor n."""
    if isinstance(sums[0], int):
        base, rest = np.array([s // n for s in sums]), np.array([s % n / n for s in sums])
    else:
        base, rest = np.zeros(len(sums)), np.array(sums) / n
    pieces = column_blocks(cells, base, tile)
    left, right = (pieces.select("row_block", F.col("block").alias(name), "n", F.col("kind").alias(f"kind_{name}"), F.col("cells").alias(f"cells_{name}")) for name in "ij")
    pairs = left.join(right.drop("n"), "row_block").filter("i <= j").select("i", "j", "n", "kind_i", "cells_i", "kind_j", "cells_j")
    tiles = pairs.mapInArrow(_products(rest, tile), "i int, j int, cells array<double>").select("i", "j", F.posexplode("cells").alias("at", "cell"))
    found = tiles.groupBy("i", "j", "at").agg(F.sum("cell").alias("cell")).toPandas()
    whole = np.zeros((len(sums), len(sums)))
    wide = np.minimum(tile, len(sums) - found["j"].to_numpy() * tile)
    row = found["i"].to_numpy() * tile + found["at"].to_numpy() // wide
    column = found["j"].to_numpy() * tile + found["at"].to_numpy() % wide
    whole[row, column] = whole[column, row] = found["cell"].to_numpy() / n
    return whole


@dataclass
class Whitener:
    """Sums of the fit list and its leading components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def varies(self) -> np.ndarray:
        """Which components have variance."""
        return self.values > LEAST_SHARE * self.trace

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened values; those of components without variance are zero."""
        base, rest = np.array([s // self.n for s in self.sums]), np.array([s % self.n / self.n for s in self.sums])
        scale = np.where(self.varies, 1 / np.sqrt(np.where(self.varies, self.values, 1.0)), 0.0)
        return ((x - base) - rest) @ (self.vectors * scale)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums over dimensions of (n x - sum) squared, exact."""
        base, left = np.array([s // self.n for s in self.sums]), np.array([s % self.n for s in self.sums])
        near = x - base
        most = int(np.abs(near).max(initial=0)) * self.n + self.n
        if most * most * x.shape[1] > _LONG:
            near = near.astype(object)
        found = ((near * self.n - left) ** 2).sum(axis=1).tolist()
        return [v if v <= _LONG else None for v in found]


def fit(vectors: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Whitener | None:
    """From distinct vectors (column x, a written table); None without any."""
    n, sums = totals(vectors)
    if not n:
        return None
    whole = covariance(vectors, n, sums, tile)
    values, found = np.linalg.eigh(whole)
    order = np.argsort(-values, kind="stable")[:components]
    return Whitener(n, sums, values[order], found[:, order], float(np.trace(whole)))


def mapped(rows: DataFrame, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The vectors of a one-column table through a function of a matrix."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            if part.num_rows:
                out = function(matrix(part))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([lists], names=["w"])

    return rows.mapInArrow(run, "w array<double>")


def identity_error(vectors: DataFrame, model: Whitener, tile: int = TILE) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list less the identity."""
    kept = np.flatnonzero(model.varies)
    if not len(kept):
        return None
    whitened = mapped(vectors, lambda x: model.project(x)[:, kept])
    n, sums = totals(whitened)
    return float(np.abs(covariance(whitened, n, sums, tile) - np.eye(len(kept))).max())


OUTPUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, column: str = "embedding", components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component."""
    x = usable(rows, column).select(F.col("vec_id").cast("long"), scaled(F.col(column)).alias("x"))
    vectors = cut(x.select("x").distinct())
    model = fit(vectors, components, tile)
    if model is None:
        discard(vectors)
        return rows.sparkSession.createDataFrame([], OUTPUT)
    error = identity_error(vectors, model, tile)
    discard(vectors)
    names = OUTPUT.replace(",", "").split()[::2]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, varies = len(model.values), model.varies
        explained = [float(v / model.trace) if model.trace > 0 else None for v in model.values]
        for part in parts:
            if not part.num_rows:
                continue
            cells = matrix(part, 1)
            n = part.num_rows * count
            values = pa.array(model.project(cells).ravel(), mask=~np.tile(varies, part.num_rows))
            each = pa.array(np.repeat(np.arange(part.num_rows), count))
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(each), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(n, model.n)),
                 pa.array(model.deviations(cells), pa.int64()).take(each), values, pa.array(explained * part.num_rows, pa.float64()), pa.array([error] * n, pa.float64())],
                names=names,
            )

    return x.mapInArrow(run, OUTPUT)
