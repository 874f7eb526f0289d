"""Files as a source: reading, validating, duplicate rejection, versions, and text extraction.

Plain text and Markdown are decoded in the JVM. Scanned pages need an engine that this repository doesn't ship:
``extract_pages`` takes a function from bytes to page texts, and page rules and line reconstruction work on its output.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proofloom.functions.text import useful_characters

# Accepted types, and limits on size, native text, confidence and pixels.
TYPES = {"pdf": ("application/pdf",), "txt": ("text/plain",), "md": ("text/markdown", "text/plain")}
MAX_BYTES = 20 * 1024 * 1024
MIN_NATIVE, HIGH_CONFIDENCE, MIN_CONFIDENCE = 40, 80, 60
DPI, MAX_PIXELS = 300, 25_000_000


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """filename, size_bytes, checksum_sha256, content of every file under a path (Spark lists no file of zero bytes)."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("checksum_sha256"), "content")


def reject_reason(size: Column, filename: Column, declared: Column, head: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file is not accepted, null where it is. ``head`` is its first bytes as text."""
    extension = F.lower(F.regexp_extract(filename, r"\.([^.]+)$", 1))
    known = F.create_map(*(F.lit(x) for k, v in TYPES.items() for x in (k, ",".join(v))))
    allowed = F.split(F.try_element_at(known, extension), ",")
    return (
        F.when(size == 0, "empty_file")
        .when(size > max_bytes, "too_large")
        .when(~extension.isin(*TYPES), "unsupported_extension")
        .when(declared.isNotNull() & ~F.array_contains(allowed, F.lower(declared)), "mime_mismatch")
        .when((extension == "pdf") & ~head.startswith("%PDF-"), "not_a_pdf")
    )


def validate(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Adds reject_reason to files with size_bytes, filename, declared_type, content."""
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    return files.withColumn("reject_reason", reject_reason(F.col("size_bytes"), F.col("filename"), F.col("declared_type"), head, max_bytes))


def new_contents(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a batch whose checksum the tenant does not have yet, one for each checksum (the first upload_id)."""
    first = Window.partitionBy("institution_id", "checksum_sha256").orderBy("upload_id")
    rows = batch.withColumn("__n", F.row_number().over(first)).filter("__n = 1").drop("__n")
    return rows.join(known.select("institution_id", "checksum_sha256").distinct(), ["institution_id", "checksum_sha256"], "left_anti")


def number_versions(batch: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds version_number: on from the largest that the document has, in the order of upload_id."""
    top = versions.groupBy("document_id").agg(F.max("version_number").alias("__top"))
    turn = F.row_number().over(Window.partitionBy("document_id").orderBy("upload_id"))
    rows = batch.withColumn("__turn", turn).join(top, "document_id", "left")
    return rows.withColumn("version_number", F.coalesce("__top", F.lit(0)) + F.col("__turn")).drop("__top", "__turn")


def decode_text(files: DataFrame) -> DataFrame:
    """Adds text and extraction_error of plain files: UTF-8, byte order mark dropped, blank texts refused."""
    raw = F.col("content").cast("string")
    good = F.is_valid_utf8(raw)
    text = F.regexp_replace(F.make_valid_utf8(raw), "^﻿", "")
    error = F.when(~good, "not_utf8").when(useful_characters(text) == 0, "blank_text")
    return files.withColumns({"text": F.when(error.isNull(), text), "extraction_error": error})


def extract_pages(files: DataFrame, reader: Callable[[bytes], list[str]]) -> DataFrame:
    """filename, page_number, native_text of paged files through ``reader``; a reader's failure is a row with error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for name, data in zip(part["filename"], part["content"]):
                try:
                    rows += [(name, n, text, None) for n, text in enumerate(reader(bytes(data)), 1)]
                except ValueError as problem:
                    rows.append((name, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["filename", "page_number", "native_text", "error"]).astype({"page_number": "Int32"})

    return files.select("filename", "content").mapInPandas(run, "filename string, page_number int, native_text string, error string")


def page_method(native_text: Column, visual: Column) -> Column:
    """native with enough useful characters, else ocr where something is drawn, else empty."""
    return F.when(useful_characters(F.coalesce(native_text, F.lit(""))) >= MIN_NATIVE, "native").when(visual, "ocr").otherwise("empty")


def render_scale(width: Column, height: Column, dpi: int = DPI, max_pixels: int = MAX_PIXELS) -> Column:
    """Scale for the wanted resolution, held under a number of pixels."""
    return F.least(F.lit(dpi / 72), F.sqrt(F.lit(float(max_pixels)) / F.greatest(F.lit(1.0), width * height)))


def nearly_blank(histogram: Column, tolerance: int = 18, share: float = 0.001) -> Column:
    """Whether at most a thousandth of a page's cells is further than 18 grey levels from the commonest level.

    ``histogram``: array of 256 counts.
    """
    mode = F.array_position(histogram, F.array_max(histogram)).cast("int") - 1
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda a, x: a + x)
    far = F.aggregate(F.transform(histogram, lambda x, i: F.when(F.abs(i - mode) > tolerance, x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)
    return (total == 0) | (far <= total * share)


def page_quality(pages: DataFrame) -> DataFrame:
    """Adds quality of pages with method, extracted_characters, ocr_confidence."""
    c = F.col
    ocr = F.when(c("ocr_confidence") >= HIGH_CONFIDENCE, "high").when(c("ocr_confidence") >= MIN_CONFIDENCE, "medium").otherwise("low")
    return pages.withColumn("quality", F.when(c("method") == "native", "high").when((c("method") == "empty") | (c("extracted_characters") == 0), "empty").otherwise(ocr))


def document_extraction(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: text with pages joined by form feeds, method (native, ocr or mixed), the worst quality, counters."""
    order = F.create_map(*(F.lit(x) for kv in {"high": 0, "medium": 1, "low": 2, "empty": -1}.items() for x in kv))
    ranked = pages.withColumn("__q", F.element_at(order, F.col("quality")))
    methods = F.sort_array(F.collect_set(F.when(F.col("method") != "empty", F.col("method"))))
    return ranked.groupBy(key).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", F.coalesce("text", F.lit("")).alias("t")))), lambda p: p["t"]), "\f").alias("extracted_text"),
        F.count(F.lit(1)).alias("page_count"),
        F.when(F.size(methods) == 0, "empty").when(F.size(methods) == 1, F.element_at(methods, 1)).otherwise("mixed").alias("extraction_method"),
        F.max_by("quality", "__q").alias("extraction_quality"),
        F.count_if(F.col("method") == "native").alias("n_native"), F.count_if(F.col("method") == "ocr").alias("n_ocr"), F.count_if(F.col("method") == "empty").alias("n_empty"),
        F.round(F.avg("ocr_confidence"), 1).alias("mean_confidence"),
    )


# Language codes of the character recogniser.
OCR_LANGUAGES = {"pt": "por", "en": "eng", "es": "spa", "fr": "fra", "de": "deu"}


def ocr_language(language: Column, default: str = "eng") -> Column:
    known = F.create_map(*(F.lit(x) for kv in OCR_LANGUAGES.items() for x in kv))
    primary = F.split_part(F.replace(F.lower(F.trim(language)), F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1))
    return F.coalesce(F.try_element_at(known, primary), F.lit(default))


def text_slice(texts: DataFrame, offset: int, limit: int) -> DataFrame:
    """document_id, slice, total_chars."""
    return texts.select("document_id", F.substring("text", offset + 1, limit).alias("slice"), F.length("text").alias("total_chars"))
