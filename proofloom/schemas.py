"""Schemas of the evidence tables and their row constraints as data-quality predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DOCUMENTS = (
    "id string, institution_id string, created_by_user_id string, title string, description string, language string, source_url string, "
    "official_source boolean, is_active boolean, valid_from date, valid_until date, created_at timestamp, updated_at timestamp"
)
VERSIONS = (
    "id string, document_id string, institution_id string, version_number int, original_filename string, mime_type string, size_bytes long, "
    "checksum_sha256 string, storage_path string, processing_status string, extracted_text string, page_count int, extraction_method string, "
    "extraction_quality string, extraction_warning string, extraction_details array<struct<page_number int, method string, native_characters int, "
    "extracted_characters int, ocr_confidence double, quality string, warning string>>"
)
CHUNKS = (
    "id string, institution_id string, document_id string, document_version_id string, chunk_index int, content string, normalized_content string, "
    "content_sha256 string, start_char int, end_char int, page_number int, section_title string, structure_type string, chunking_strategy string, language string"
)
MESSAGES = (
    "id string, conversation_id string, institution_id string, user_id string, reply_to_message_id string, role string, content string, language string, "
    "metadata string, created_at timestamp"
)
MESSAGE_SOURCES = (
    "id string, message_id string, institution_id string, message_role string, chunk_id string, document_id string, document_version_id string, "
    "evidence_id string, citation_index int, document_title string, chunk_index int, content_sha256 string, language string, official_source boolean, "
    "valid_from date, valid_until date"
)
STRUCTURE_TYPES = ("heading", "paragraph", "table_row", "list_item", "list_block", "mixed", "fallback_fragment")
STATUSES = ("pending", "processing", "processed", "failed")
ROLES = ("user", "assistant", "system")


def version_checks() -> dict[str, Column]:
    return {
        "version_number_positive": F.col("version_number") > 0,
        "size_positive": F.col("size_bytes") > 0,
        "status_known": F.col("processing_status").isin(*STATUSES),
        "checksum_is_sha256": F.col("checksum_sha256").rlike("^[0-9a-f]{64}$"),
    }


def chunk_checks() -> dict[str, Column]:
    return {
        "chunk_index_not_negative": F.col("chunk_index") >= 0,
        "offsets_in_order": (F.col("start_char") >= 0) & (F.col("end_char") > F.col("start_char")),
        "content_not_blank": F.trim("content") != "",
        "structure_type_known": F.col("structure_type").isNull() | F.col("structure_type").isin(*STRUCTURE_TYPES),
    }


def source_checks() -> dict[str, Column]:
    return {
        "assistant_only": F.col("message_role") == "assistant",
        "evidence_id_form": F.col("evidence_id").rlike("^E[1-9][0-9]*$"),
        "digest_length": F.length("content_sha256") == 64,
    }


def violations(rows: DataFrame, checks: dict[str, Column], key: str) -> DataFrame:
    """(key, constraint) for every row that breaks a constraint; an unknown outcome counts as kept, as in SQL CHECKs."""
    broken = F.array_compact(F.array(*(F.when(~check, F.lit(name)) for name, check in checks.items())))
    return rows.select(key, F.explode(broken).alias("constraint"))


def duplicates(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Key values that break a UNIQUE constraint, with how often they occur."""
    known = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in columns))
    return rows.filter(known).groupBy(*columns).agg(F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1")


def orphans(rows: DataFrame, parents: DataFrame, columns: list[str]) -> DataFrame:
    """Rows whose (composite) foreign key has no parent."""
    return rows.dropna(subset=columns).join(parents.select(*columns).distinct(), columns, "left_anti")
