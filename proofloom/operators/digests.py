"""Order-independent digests of tables: every row has one line of text, and lines are hashed in key order.

Digests nest. A document's digest covers its chunk digests, the corpus digest covers the documents', so no task
ever holds the contents of more than one document. Above ``FAN`` members a level is split by key prefix first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line(*columns: Column | str) -> Column:
    """Columns as one line: parts joined by a unit separator, null as a mark of its own."""
    mark = F.lit("␀")
    return F.concat_ws("\u001f", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), mark) for c in columns))


def row_digest(*columns: Column | str) -> Column:
    return F.sha2(line(*columns), 256)


def group_digest(rows: DataFrame, keys: list[str], order: str, digest: str, out: str) -> DataFrame:
    """(keys, out): sha256 of the members' digests in order."""
    members = F.sort_array(F.collect_list(F.struct(F.col(order), F.col(digest))))
    return rows.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(members, lambda m: m[digest]), "\n"), 256).alias(out))


def document_digests(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_digest over chunk_index, content_sha256."""
    rows = chunks.select("document_id", "chunk_index", row_digest("chunk_index", "content_sha256").alias("__d"))
    return group_digest(rows, ["document_id"], "chunk_index", "__d", "chunk_digest")


def corpus_digest(documents: DataFrame, key: str = "document_id", digest: str = "chunk_digest") -> DataFrame:
    """n_documents, corpus_digest in two levels: 4,096 shelves by the md5 of the key, so that no task sees all documents."""
    rows = documents.select(F.col(key).cast("string").alias("k"), row_digest(F.col(key), digest).alias("d"))
    shelves = rows.withColumn("shelf", F.substring(F.md5(F.col("k").cast("binary")), 1, 3))
    n = shelves.groupBy("shelf").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "d"))), lambda m: m["d"]), "\n"), 256).alias("d"))
    top = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("shelf", "d"))), lambda m: m["d"]), "\n")
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_documents"), F.sha2(top, 256).alias("corpus_digest"))


def snapshot_id(parts: list[str]) -> str:
    """Digest of a few digests and settings, on the driver."""
    import hashlib

    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


def canonical_json(value: object) -> str:
    """Sorted keys, compact separators, text as it is: the form that report digests are taken of."""
    import json

    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def drift(expected: DataFrame, found: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """(keys, problem): missing, unexpected or changed rows between two runs; empty when one reproduces the other."""
    a = expected.select(*keys, F.col(digest).alias("__a"))
    b = found.select(*keys, F.col(digest).alias("__b"))
    problem = F.when(F.col("__b").isNull(), "missing").when(F.col("__a").isNull(), "unexpected").when(F.col("__a") != F.col("__b"), "changed")
    return a.join(b, keys, "full_outer").withColumn("problem", problem).filter("problem is not null").select(*keys, "problem")
