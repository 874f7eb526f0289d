"""Nearest neighbours by cosine, index coverage and staleness, digests of vectors."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from proofloom.operators import metric_index


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, ties: list[str], scope: str | None = None) -> DataFrame:
    """query_id, the columns of ``vectors`` but the embedding, similarity, rank, by an index made for this one search."""
    return metric_index.nearest(queries, metric_index.build(vectors, ties, scope), k, scope)


def coverage(admissible: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """n_admissible, n_embedded of the admissible rows."""
    found = admissible.join(index.select(key, F.lit(1).alias("__has")), key, "left")
    return found.agg(F.count(F.lit(1)).alias("n_admissible"), F.count("__has").alias("n_embedded"))


def index_state(admissible: DataFrame, index: DataFrame, key: str, configuration: str) -> DataFrame:
    """(key, state): fresh, stale_configuration, stale_content or missing. ``admissible`` has content_sha256."""
    held = index.select(key, F.col("configuration_version").alias("__c"), F.col("embedded_content_sha256").alias("__s"))
    state = (
        F.when(F.col("__c").isNull(), "missing")
        .when(F.col("__c") != configuration, "stale_configuration")
        .when(F.col("__s") != F.col("content_sha256"), "stale_content")
        .otherwise("fresh")
    )
    return admissible.join(held, key, "left").select(key, state.alias("state"))


def homogeneity(admissible: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """n_vectors, configurations, n_stale_content of the index over the admissible rows."""
    rows = admissible.join(index, key)
    return rows.agg(
        F.count(F.lit(1)).alias("n_vectors"),
        F.array_join(F.sort_array(F.collect_set("configuration_version")), ",").alias("configurations"),
        F.count_if(F.col("embedded_content_sha256") != F.col("content_sha256")).alias("n_stale_content"),
    )


@F.pandas_udf(StringType())
def vector_digest(vectors: pd.Series) -> pd.Series:
    """sha256 of the vector as little-endian 32-bit floats."""
    import hashlib

    return vectors.map(lambda v: hashlib.sha256(struct.pack(f"<{len(v)}f", *v)).hexdigest(), na_action="ignore")


def frozen_vectors(texts: DataFrame, vectors: DataFrame, column: str = "text") -> DataFrame:
    """Vectors of texts by the digest of the text; ``missing_vectors`` names those without."""
    return texts.withColumn("text_sha256", F.sha2(column, 256)).join(vectors, "text_sha256")


def missing_vectors(texts: DataFrame, vectors: DataFrame, column: str = "text") -> DataFrame:
    return texts.withColumn("text_sha256", F.sha2(column, 256)).join(vectors, "text_sha256", "left_anti")


def vector_problems(vectors: DataFrame, dimension: int) -> DataFrame:
    """(text_sha256, problem): wrong dimension, digest that differs, text twice."""
    size = vectors.filter(F.size("embedding") != dimension).select("text_sha256", F.lit("dimension").alias("problem"))
    digest = vectors.filter(vector_digest("embedding") != F.col("vector_sha256")).select("text_sha256", F.lit("digest").alias("problem"))
    twice = vectors.groupBy("text_sha256").count().filter("count > 1").select("text_sha256", F.lit("duplicate").alias("problem"))
    return size.unionByName(digest).unionByName(twice)
