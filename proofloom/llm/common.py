"""Small helpers shared by the corpus operators: table access, written cut points and Arrow output."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An output batch is handed to Spark once its variable-length values pass this many bytes.
FLUSH_BYTES = 8_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder for written intermediates. Only a session without executors elsewhere may go without one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = _own_folder()
    return f"{shared}/proofloom-{spark.sparkContext.applicationId}"


@functools.lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="spark-")


_SCOPE = ["queries"]


@contextlib.contextmanager
def scratch(spark: SparkSession, name: str) -> Iterator[None]:
    """What is cut within goes to a folder of this name, and what its last use left there is deleted first.

    For steps that follow each other and each read only the stored result of the one before.
    """
    _delete(spark, f"{work_dir(spark)}/{name}")
    before, _SCOPE[0] = _SCOPE[0], name
    try:
        yield
    finally:
        _SCOPE[0] = before


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors.

    ``discard`` deletes it early; the rest of a session goes by ``discard_all``.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{_SCOPE[0]}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.proofloom_path = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete what ``cut`` wrote, once no later plan reads it."""
    for df in tables:
        _delete(df.sparkSession, df.proofloom_path)


def discard_all(spark: SparkSession) -> None:
    """Delete everything that ``cut`` wrote in this application, once its results are stored."""
    _delete(spark, work_dir(spark))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size from (weight in bytes, *values) tuples."""
    kept: list[tuple] = []
    held = 0
    for weight, *values in rows:
        kept.append(tuple(values))
        held += weight + 64
        if held >= FLUSH_BYTES:
            yield _batch(kept, schema)
            kept, held = [], 0
    if kept:
        yield _batch(kept, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The values of a string column as UTF-8 bytes; null is empty."""
    return [v if v is not None else b"" for v in column.cast(pa.binary()).to_pylist()]


def strings(column: pa.Array) -> list[str]:
    """The values of a string column; null is empty."""
    return [v if v is not None else "" for v in column.to_pylist()]


def row_key(df: DataFrame) -> Column:
    """Two hashes of all columns of a row, nulls told from values: one of 64 bits is shared by some rows of a very large table."""
    own = [x for c, kind in df.dtypes for x in (F.col(c).isNull(), F.to_json(c) if "map<" in kind else F.col(c))]
    return F.struct(F.xxhash64(*own).alias("a"), F.xxhash64(F.lit("second"), *own).alias("b"))


def fold_bucket(column: str, modulus: int):
    """crc32 of the id's decimal text, modulo: the fold a document belongs to. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % modulus, F.lit(0))


def fit_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, rows: int) -> DataFrame:
    """doc_id, text, label of about ``rows`` labelled documents outside the held-out fold.

    Ids are picked by a hash, so the picked labels stay bounded whatever the size of the tables and can be
    broadcast. Each id counts once, with its smallest label and its smallest text, so reruns agree. Rows
    without an id or a label teach nothing.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).dropna()
    usable = usable.filter(fold_bucket("doc_id", modulus) != held)
    share = min(1.0, rows / max(1, usable.count()))
    picked = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20))).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")
