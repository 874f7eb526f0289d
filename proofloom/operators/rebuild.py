"""Chunks of versions as a stored table: replacement, deletion, ordered listing, and rebuilding from persisted text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partitions of a stored chunk table: a replacement rewrites only those of its versions.
SHELVES = 256


def replaced(stored: DataFrame, fresh: DataFrame, versions: DataFrame) -> DataFrame:
    """The chunk table after the chunks of ``versions`` (version_id) gave way to ``fresh``; no fresh ones means deletion."""
    kept = stored.join(versions.select("version_id").distinct(), "version_id", "left_anti")
    return kept.unionByName(fresh.join(versions.select("version_id").distinct(), "version_id", "left_semi"))


def listed(chunks: DataFrame) -> DataFrame:
    return chunks.orderBy("version_id", "chunk_index")


def shelved(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("shelf", F.pmod(F.xxhash64("version_id"), F.lit(SHELVES)).cast("int"))


def store(chunks: DataFrame, path: str) -> None:
    """Write a whole chunk table, partitioned for later replacement."""
    shelved(chunks).repartition("shelf").write.partitionBy("shelf").mode("overwrite").parquet(path)


def replace_stored(path: str, fresh: DataFrame, versions: DataFrame) -> None:
    """Replace the chunks of ``versions`` on disk. Only their partitions are rewritten, each as a whole.

    The new partitions are written beside the table first, for a table cannot be read and overwritten at once.
    """
    spark = fresh.sparkSession
    touched = shelved(versions.select("version_id").distinct()).select("shelf").distinct()
    old = spark.read.parquet(path).join(touched, "shelf", "left_semi").drop("shelf")
    aside = f"{path}.replacement"
    shelved(replaced(old, fresh, versions)).write.mode("overwrite").parquet(aside)
    ready = spark.read.parquet(aside)
    emptied = [r["shelf"] for r in touched.join(ready.select("shelf").distinct(), "shelf", "left_anti").collect()]  # at most SHELVES numbers
    ready.repartition("shelf").write.partitionBy("shelf").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    for shelf in emptied:
        place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shelf={shelf}")
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def rebuild_outcomes(versions: DataFrame, cited: DataFrame) -> DataFrame:
    """Adds outcome: skipped_cited, skipped_unprocessed, skipped_blank or rebuilt. ``versions``: version_id, processing_status, text."""
    marks = cited.select("version_id", F.lit(True).alias("__cited")).distinct()
    outcome = (
        F.when(F.col("__cited"), "skipped_cited")
        .when(F.col("processing_status") != "processed", "skipped_unprocessed")
        .when(F.trim(F.coalesce("text", F.lit(""))) == "", "skipped_blank")
        .otherwise("rebuilt")
    )
    return versions.join(marks, "version_id", "left").withColumn("outcome", outcome).drop("__cited")


def rebuild(versions: DataFrame, cited: DataFrame, chunker: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(fresh chunks, versions with outcomes): chunks are made of the texts of versions that may be rebuilt."""
    decided = rebuild_outcomes(versions, cited)
    return chunker(decided.filter("outcome = 'rebuilt'")), decided


def rebuild_counts(decided: DataFrame, fresh: DataFrame) -> DataFrame:
    """outcome, n_versions, n_chunks."""
    chunks = fresh.groupBy("version_id").agg(F.count(F.lit(1)).alias("__n"))
    rows = decided.select("version_id", "outcome").join(chunks, "version_id", "left")
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("n_versions"), F.coalesce(F.sum("__n"), F.lit(0)).alias("n_chunks"))
