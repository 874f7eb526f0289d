"""Incremental ingest of documents as a stream of files. An addition: each batch is validated and chunked on its own, without state.

A batch writes one folder named by its number, so a batch that runs again after a failure overwrites its own output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from proofloom.operators.chunking import chunk_documents


def read_documents(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(documents: DataFrame, out: str, checkpoint: str, size: int = 1200, overlap: int = 150) -> StreamingQuery:
    """Chunks of the documents with text to ``out``/chunks, the rest with a reason to ``out``/rejected; ends when no file is left."""

    def write(batch: DataFrame, number: int) -> None:
        blank = F.trim(F.coalesce("text", F.lit(""))) == ""
        good = batch.filter(~blank).select("document_id", "text").dropDuplicates(["document_id"])
        chunk_documents(good, size=size, overlap=overlap).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        rejected = batch.filter(blank).select("document_id", F.lit("blank_text").alias("reason"))
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
