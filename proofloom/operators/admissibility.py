"""Named conditions under which a chunk may serve as evidence, each one Column, used to filter or to explain.

Expected columns: chunk_institution, document_institution, version_institution, processing_status, version_id,
latest_version_id, is_active, document_language, chunk_language, valid_from, valid_until, official_source, and
of the context ctx_institution, ctx_language, reference_date, official_only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def conditions() -> dict[str, Column]:
    c = F.col
    return {
        "chunk_belongs_to_institution": c("chunk_institution") == c("ctx_institution"),
        "document_belongs_to_institution": c("document_institution") == c("ctx_institution"),
        "version_belongs_to_institution": c("version_institution") == c("ctx_institution"),
        "version_processed": c("processing_status") == "processed",
        "version_is_highest_processed": c("version_id").eqNullSafe(c("latest_version_id")),
        "document_active": c("is_active").eqNullSafe(True),
        "language_compatible": c("document_language") == c("ctx_language"),
        "chunk_language_compatible": c("chunk_language") == c("ctx_language"),
        "valid_from_compatible": c("valid_from").isNull() | (c("valid_from") <= c("reference_date")),
        "valid_until_compatible": c("valid_until").isNull() | (c("valid_until") >= c("reference_date")),
        "official_source_compatible": ~c("official_only") | c("official_source"),
    }


RETRIEVAL = (
    "chunk_belongs_to_institution", "document_belongs_to_institution", "version_belongs_to_institution", "version_processed", "version_is_highest_processed", "document_active",
    "language_compatible", "chunk_language_compatible", "valid_from_compatible", "valid_until_compatible", "official_source_compatible",
)
#: Citing an older processed version stays allowed.
CITATION = tuple(name for name in RETRIEVAL if name != "version_is_highest_processed")


def latest_processed(versions: DataFrame) -> DataFrame:
    """document_id, institution_id, latest_version_id, latest_version_number."""
    newest = Window.partitionBy("document_id", "institution_id").orderBy(F.desc("version_number"))
    ranked = versions.filter("processing_status = 'processed'").withColumn("rn", F.row_number().over(newest)).filter("rn = 1")
    return ranked.select("document_id", "institution_id", F.col("version_id").alias("latest_version_id"), F.col("version_number").alias("latest_version_number"))


def latest_any(versions: DataFrame) -> DataFrame:
    """The newest version of each document whatever its status, beside the newest processed one."""
    per = versions.groupBy("document_id").agg(
        F.max_by("version_id", "version_number").alias("latest_version_id"),
        F.max_by("processing_status", "version_number").alias("latest_status"),
        F.expr("max_by(version_id, version_number) filter (where processing_status = 'processed')").alias("effective_version_id"),
    )
    return per


def candidates(chunks: DataFrame, documents: DataFrame, versions: DataFrame) -> DataFrame:
    """Chunks with the columns that the conditions read; joins are on id and institution together. Contents are shuffled once."""
    docs = documents.select(
        "document_id", F.col("institution_id").alias("document_institution"), F.col("language").alias("document_language"),
        "title", "official_source", "is_active", "valid_from", "valid_until",
    )
    vers = versions.select("version_id", "document_id", F.col("institution_id").alias("version_institution"), "version_number", "processing_status")
    newest = latest_processed(versions).withColumnRenamed("institution_id", "version_institution")
    rows = chunks.withColumnsRenamed({"institution_id": "chunk_institution", "language": "chunk_language"})
    about = vers.join(docs, "document_id").join(newest, ["document_id", "version_institution"], "left")
    return rows.join(about, ["version_id", "document_id"])


def within(rows: DataFrame, institution: Column | str, language: Column | str, reference_date, official_only: bool = False) -> DataFrame:
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.withColumns(
        {"ctx_institution": as_column(institution), "ctx_language": as_column(language), "reference_date": as_column(reference_date).cast("date"), "official_only": F.lit(official_only)}
    )


def eligible(rows: DataFrame, policy: tuple[str, ...] = RETRIEVAL) -> DataFrame:
    named = conditions()
    return rows.filter(reduce(lambda a, b: a & b, (named[n] for n in policy)))


def explain(rows: DataFrame, key: list[str], policy: tuple[str, ...] = RETRIEVAL) -> DataFrame:
    """(key, condition, satisfied) for every condition of the policy."""
    named = conditions()
    verdicts = F.array(*(F.struct(F.lit(n).alias("condition"), F.coalesce(named[n], F.lit(False)).alias("satisfied")) for n in policy))
    return rows.select(*key, F.explode(verdicts).alias("v")).select(*key, "v.condition", "v.satisfied")


def listed(documents: DataFrame, is_active: bool | None = None, official_source: bool | None = None, language: str | None = None) -> DataFrame:
    """Optional filters of a listing; None leaves a filter out."""
    for column, wanted in (("is_active", is_active), ("official_source", official_source), ("language", language)):
        if wanted is not None:
            documents = documents.filter(F.col(column) == F.lit(wanted))
    return documents


def page(rows: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page of a totally ordered listing."""
    return rows.orderBy(*order).offset(offset).limit(limit)
