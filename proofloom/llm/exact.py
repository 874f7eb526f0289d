"""Document fingerprints: a canonical exact digest, in DataFrame functions only.

The canonical form of a text is its compatibility composition (NFKC), case-folded and composed again, with
every run of white space made one space and the ends trimmed. Its fingerprint is 128 bits of xxhash: two
xxhash64 values of the canonical form, of which the second starts from another seed. Documents of one
fingerprint are compared as canonical bytes; should two differ, the later ones in byte order get a
suffix, so documents with equal fingerprints always have equal canonical texts. ``near_next`` and the
fingerprints of edited texts rest on the 128 bits where no document has such a text.

Null and empty texts have the empty canonical form. The next document is the one with the next larger
doc_id, after the largest the smallest; where several rows share an id, the smallest text prefix stands
for it. A row with a null id is nobody's next; its own next is the document with the smallest id. A
table without any id has the empty text as next. Repeated rows get equal values; a text of any length is
one value. An empty table gives an empty table; only doc_id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.llm.common import cut

#: White space of Unicode (the property White_Space).
SPACES = r"[\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def canonical(text: Column) -> Column:
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), composed, F.lit(True))
    again = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(True))
    return F.trim(F.regexp_replace(again, SPACES, " "))


def wide_hash(canon: Column) -> Column:
    """32 hex digits. The canonical form is bound once, so that it is not worked out for each half."""

    def digits(c: Column) -> Column:
        return F.concat(*(F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(c), F.xxhash64(F.lit("second"), c))))

    return F.transform(F.array(canon), digits)[0]


def clashes(docs: DataFrame) -> DataFrame:
    """(digest, canon, rank) of canonical texts that share their digest with a smaller one; as good as always empty."""
    canon = docs.select(canonical(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("canon"))
    distinct = canon.withColumn("digest", wide_hash(F.col("canon"))).groupBy("digest", "canon").agg(F.count(F.lit(1)).alias("n"))
    several = distinct.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest")
    if several.isEmpty():
        return several.select("digest", F.lit("").alias("canon"), F.lit(0).alias("rank")).limit(0)
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1
    return cut(distinct.join(several, "digest").select("digest", "canon", rank.alias("rank")).filter("rank > 0"))


def following(ids: DataFrame) -> DataFrame:
    """(id, next) for distinct non-null ids, next null after the largest: ranges of ids of equal size, then the first of each."""
    dealt = cut(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    inner = dealt.withColumn("next", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    firsts = dealt.groupBy("part").agg(F.min("id").alias("first"))  # one row for each partition
    beyond = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("beyond"))
    return inner.join(beyond, "part").select("id", F.coalesce("next", "beyond").alias("next"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited (the text with its second half overwritten by the next document's start), next_digest."""
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = texts.filter("doc_id is not null")  # both joins below use one shuffle of these
    halves = cut(texts.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.floor(F.length("text") / 2)).alias("half"), F.count(F.lit(1)).alias("rows")))
    ids = halves.filter("id is not null")
    least, most, nameless = halves.agg(F.min("id"), F.max(F.when(F.col("id").isNotNull(), F.col("rows"))), F.count_if(F.col("id").isNull())).first()
    chain = following(ids.select("id"))
    wanted = ids.join(chain, "id").select("id", "half", F.coalesce("next", F.lit(least)).alias("next"))
    given = known.join(wanted, known.doc_id == wanted.next).select(
        "id", F.substring("text", F.lit(1), F.col("half").cast("int")).alias("start"), wide_hash(canonical(F.col("text"))).alias("next_digest")
    )
    if most is not None and most > 1:
        given = given.groupBy("id").agg(F.min(F.struct("start", "next_digest")).alias("g")).select("id", "g.start", "g.next_digest")
    joined = known.join(given, known.doc_id == given.id, "left").select("doc_id", "text", "start", "next_digest")
    if nameless:
        first = known.filter(F.col("doc_id") == least).agg(F.min("text")).first()[0] if least is not None else ""
        digest = wide_hash(canonical(F.lit(first or "")))
        joined = joined.unionByName(texts.filter("doc_id is null").select("doc_id", "text", F.lit(first or "").alias("start"), digest.alias("next_digest")))
    n = F.length("text")
    put = F.substring(F.coalesce("start", F.lit("")), F.lit(1), F.floor(n / 2).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), (n - F.floor(n / 2)).cast("int")), put)
    return joined.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "next_digest")


def likeness(a: Column, b: Column) -> Column:
    """1 where two exact fingerprints are the same, else 0."""
    return F.when(a == b, 1.0).otherwise(0.0)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    empty = wide_hash(F.lit(""))
    pairs = with_next(docs).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("edited_canon"), "next_digest",
    )
    marked = pairs.withColumn("digest", wide_hash(F.col("canon"))).withColumn("edited_digest", wide_hash(F.col("edited_canon")))
    twice = clashes(docs)
    if twice.isEmpty():
        named = marked.withColumn("fingerprint", F.col("digest")).withColumn("edited_fingerprint", F.col("edited_digest"))
    else:
        named = marked
        for side, out in (("digest", "fingerprint"), ("edited_digest", "edited_fingerprint")):
            text = "canon" if side == "digest" else "edited_canon"
            other = twice.select(F.col("digest").alias("d"), F.col("canon").alias("c"), F.col("rank").alias(f"{side}_rank"))
            named = named.join(other, (F.col(side) == F.col("d")) & (F.col(text) == F.col("c")), "left").drop("d", "c")
            named = named.withColumn(out, F.concat(side, F.coalesce(F.concat(F.lit("-"), f"{side}_rank"), F.lit(""))))
    return named.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("canon"), F.col("edited_canon")).alias("near_edited"),
        likeness(F.col("digest"), F.coalesce("next_digest", empty)).alias("near_next"),
    )
