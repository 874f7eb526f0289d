"""The evidence tables as views of the bundled star-schema tables, and plain scans of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions.lexical import informative_terms
from proofloom.functions.text import normalize_text
from proofloom.operators.meeting import rarest_meetings


def scan(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(days: Column) -> Column:
    return F.date_add(F.lit("2024-01-01").cast("date"), days.cast("int"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document; the first line is the title, attributes follow from the id."""
    i = F.col("doc_id")
    return scan(spark, sf_dir, "documents").select(
        i.alias("document_id"),
        F.concat(F.lit("i"), (i % 2).cast("string")).alias("institution_id"),
        F.col("lang").alias("language"),
        "source",
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        (i % 3 != 0).alias("official_source"),
        (i % 17 != 0).alias("is_active"),
        F.when(i % 5 != 0, _day(i % 700 - 350)).alias("valid_from"),
        F.when(i % 7 != 0, _day(i % 900 - 150)).alias("valid_until"),
        "text",
    )


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One version a document, and a second for every fourth; the status follows from id and number."""
    i, n = F.col("doc_id"), F.col("version_number")
    numbers = F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    status = F.when((i + n) % 10 == 9, "failed").when((i + n) % 10 == 4, "pending").otherwise("processed")
    rows = scan(spark, sf_dir, "documents").select("doc_id", "text", F.explode(numbers).alias("version_number"))
    return rows.select(
        (i * 10 + n).alias("version_id"),
        i.alias("document_id"),
        F.concat(F.lit("i"), (i % 2).cast("string")).alias("institution_id"),
        "version_number",
        status.alias("processing_status"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.sha2("text", 256).alias("checksum_sha256"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that are not blank of each document, as chunks of all its versions."""
    i = F.col("doc_id")
    lines = scan(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    numbers = F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = lines.withColumn("content", F.trim("line")).filter("content <> ''").withColumn("n", F.explode(numbers))
    version = i * 10 + F.col("n")
    return rows.select(
        (version * 1_000_000 + F.col("chunk_index")).alias("chunk_id"),
        version.alias("version_id"),
        i.alias("document_id"),
        F.concat(F.lit("i"), (i % 2).cast("string")).alias("institution_id"),
        F.col("lang").alias("language"),
        "chunk_index",
        "content",
        F.when(F.col("content").contains(" | "), "table_row").otherwise("paragraph").alias("structure_type"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, chunk_index, content: the lines that are not blank of each document, once."""
    flat = scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "line"))
    return flat.select("document_id", "chunk_index", F.trim("line").alias("content")).filter("content <> ''")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark passage, asked whole in English of one institution."""
    normal = normalize_text(F.col("text"))
    return scan(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("question_id"),
        F.concat(F.lit("i"), (F.col("item_id") % 2).cast("string")).alias("institution_id"),
        F.lit("en").alias("language"),
        normal.alias("query"),
        "text",
    )


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question_id, document_id, grade: 2 where a document has the passage, 1 where it has all words with content of the question.

    Both grades meet documents on one word, the rarest of the passage's inner words or of the question's.
    """
    word = F.lit(r"(?U)([^\W_]+)")
    asked = question_terms(spark, sf_dir)
    bodies = scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")
    inner = asked.withColumn("words", F.regexp_extract_all("text", word, F.lit(1))).withColumn("words", F.slice("words", 2, F.greatest(F.size("words") - 2, F.lit(0))))
    met = rarest_meetings(inner, ["question_id"], bodies.withColumn("words", F.regexp_extract_all("text", word, F.lit(1))), ["document_id"])
    passages = asked.select("question_id", F.col("text").alias("passage"))
    whole = met.join(passages, "question_id").join(bodies, "document_id").filter(F.col("text").contains(F.col("passage"))).select("question_id", "document_id", F.lit(2).alias("grade"))
    plain = bodies.select("document_id", F.regexp_extract_all(normalize_text(F.col("text")), word, F.lit(1)).alias("words"))
    terms = asked.select("question_id", F.col("terms").alias("words")).filter(F.size("words") > 0)
    near = rarest_meetings(terms, ["question_id"], plain, ["document_id"]).join(terms.withColumnRenamed("words", "terms"), "question_id").join(plain, "document_id")
    some = near.filter(F.size(F.array_except("terms", "words")) == 0).select("question_id", "document_id", F.lit(1).alias("grade"))
    return whole.unionByName(some).groupBy("question_id", "document_id").agg(F.max("grade").alias("grade"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 10_000 + F.col("turn")).alias("message_id"),
        F.col("conv_id").alias("conversation_id"),
        "turn",
        "role",
        F.col("text").alias("content"),
        F.when(F.col("role") == "assistant", F.col("conv_id") * 10_000 + F.col("turn") - 1).alias("reply_to_message_id"),
    )


def question_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = questions(spark, sf_dir)
    return rows.withColumn("terms", informative_terms(F.col("query"), F.col("language")))
