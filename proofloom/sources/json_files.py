"""JSON sources with strict schemas, scans for forbidden data, and small report sinks."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import sensitive
from proofloom.functions.json_paths import json_strings
from proofloom.operators.digests import canonical_json

QUESTIONS = (
    "corpus_id string, snapshot_id string, questions array<struct<question_id: string, question: string, language: string, difficulty_types: array<string>, "
    "no_relevant_evidence: boolean, excluded_from_metrics: boolean, evidence_judgments: array<struct<corpus_item_id: string, chunk_index: int, relevance: int>>>>"
)


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(questions, judgments) of ground-truth files; a file of another shape fails the read."""
    raw = spark.read.schema(QUESTIONS).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    rows = raw.select("corpus_id", F.explode("questions").alias("q")).select("corpus_id", "q.*")
    judged = rows.select("question_id", F.explode("evidence_judgments").alias("j"))
    judged = judged.select("question_id", F.concat_ws("#", "j.corpus_item_id", F.col("j.chunk_index").cast("string")).alias("item"), F.col("j.relevance").alias("grade"))
    return rows.drop("evidence_judgments"), judged


def unknown_fields(rows: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Rows whose JSON object has a field outside the contract."""
    return rows.withColumn("extra", F.array_except(F.json_object_keys(column), F.array(*map(F.lit, known)))).filter(F.size("extra") > 0)


def forbidden_data(rows: DataFrame, key: str, text: str, allowed_host: str | None = None) -> DataFrame:
    """key, rule, n_matches, longest: what a text holds and how long, never the match itself. A null text holds nothing.

    With ``allowed_host``, addresses of other hosts are a finding too.
    """
    families = dict(sensitive.FAMILIES)
    if allowed_host is not None:

        def outside(own: Column) -> Column:
            host = sensitive.host_of
            return F.filter(sensitive.addresses(own), lambda u: (host(u) != allowed_host) & ~host(u).endswith(f".{allowed_host}"))

        families["url_outside_allowlist"] = outside

    def found(name: str, hits: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.size(hits).alias("n_matches"), F.coalesce(F.array_max(F.transform(hits, F.length)), F.lit(0)).alias("longest"))

    rules = F.array(*(found(name, family(F.col(text))) for name, family in families.items()))
    return rows.filter(F.col(text).isNotNull()).select(key, F.explode(F.filter(rules, lambda r: r["n_matches"] > 0)).alias("r")).select(key, "r.*")


def forbidden_in_json(rows: DataFrame, key: str, column: str, allowed_host: str | None = None) -> DataFrame:
    """key, pointer, rule, n_matches, longest over every string of a JSON column."""
    strings = json_strings(rows, key, column).select(F.struct(key, "pointer").alias("__at"), "value")
    return forbidden_data(strings, "__at", "value", allowed_host=allowed_host).select(f"__at.{key}", "__at.pointer", "rule", "n_matches", "longest")


def foreign_hosts(rows: DataFrame, key: str, url: str, allowed: list[str]) -> DataFrame:
    """key, host of addresses outside an allow-list."""
    host = F.lower(F.regexp_extract(url, r"^[a-z]+://([^/:?#]+)", 1))
    return rows.select(key, host.alias("host")).filter((F.col("host") != "") & ~F.col("host").isin(allowed))


def write_report(path: str, value: object) -> None:
    """A small report as canonical JSON, moved into place whole."""
    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False, encoding="utf-8") as file:
        file.write(canonical_json(value) + "\n")
    os.replace(file.name, path)


def markdown_table(columns: list[str], rows: list[tuple]) -> str:
    """Rows of a small result as a Markdown table."""
    cells = [columns, ["---"] * len(columns), *([("" if v is None else str(v)).replace("|", "\\|") for v in row] for row in rows)]
    return "\n".join("| " + " | ".join(row) + " |" for row in cells) + "\n"
