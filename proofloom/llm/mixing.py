"""Mixing sources to target weights with a time-varying curriculum.

``targets`` gives each source its share of the word budget by weight, stopping at a multiple of what the
source has; the excess goes to the others by weight until none is above. ``mix`` turns a target into
words taken from each document: whole passes over the source, then part of one more pass in a fixed
pseudo-random order (md5 of id and text), so that the words taken add up to the target rounded down.
Positions follow from the source's weight schedule: its integral up to t is the share of the source's
demand that training has used by t, so a document at cumulative demand u sits at the inverse of that
integral. ``curriculum`` repeats documents by what was taken and sorts all of them by position.

A running total over one source never sits in one task: documents are dealt into 4,096 buckets by their
order key, totals of earlier buckets are added afterwards, and only these bounded per-source tables see a
window over a whole source. Windows over all sources have one row per source.

Null texts have size 0, a null source is a source of its own that comes last. Null ids and ids that repeat
are told apart by their texts. Rows that repeat are mixed one by one. An empty table gives an empty table; a
text of any length is one row. Other columns are kept only by ``curriculum``, whose own columns begin with
two underscores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.llm.common import cut, row_key

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
CAP = 2
#: Weight at the start and at the end of training, in turn by source order; each integrates to 1.
SCHEDULES = ((0.5, 1.5), (1.0, 1.0), (1.5, 0.5))
#: Hex digits of the order key that make a bucket.
BUCKET_DIGITS = 3
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), k (order key) and row_key (the whole row in 128 bits)."""
    return docs.select(
        F.col("doc_id").cast("long"),
        F.col("source").cast("string"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary")).alias("k"),
        row_key(docs).alias("row_key"),
    )


def targets(sized: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP) -> DataFrame:
    """source, turn (place in the order of sources), source_size, target: one row per source."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    total = Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int")).cast("double")
    fill = Window.orderBy("ratio", "turn")
    levels = (
        per.withColumn("turn", F.row_number().over(order) - 1)
        .withColumn("weight", weight)
        .withColumn("words", F.sum("source_size").over(total) * F.lit(float(budget)))
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("full", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("words") - F.col("full")) / F.col("open"))
        .withColumn("capped", F.col("level") >= F.col("ratio"))
        .withColumn("even", F.max(F.when(~F.col("capped"), F.col("level"))).over(total))
    )
    return levels.select("source", "turn", "source_size", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.col("even")).alias("target"))


def position(turn: Column, share: Column, schedules=SCHEDULES) -> Column:
    """Training time in 0..1 at which the source has used ``share`` of its demand: the schedule's integral inverted."""
    place = (turn % len(schedules) + 1).cast("int")
    start, end = (F.element_at(F.array(*(F.lit(s[i]) for s in schedules)), place) for i in (0, 1))
    slope = end - start
    return F.when(slope == 0, share).otherwise((F.sqrt(start * start + slope * share * F.lit(2.0)) - start) / slope)


def mix(docs: DataFrame, weights=WEIGHTS, budget=BUDGET, cap=CAP, schedules=SCHEDULES) -> DataFrame:
    """doc_id, row_key, source, size, source_size, target, before (words of the source ahead), taken, position."""
    sized = cut(sizes(docs)).withColumn("bucket", F.substring("k", 1, BUCKET_DIGITS))
    own = Window.partitionBy("source", "bucket").orderBy("k", "doc_id", "size", "row_key").rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    filled = sized.groupBy("source", "bucket").agg(F.sum("size").alias("in_bucket"))
    filled = filled.withColumn("earlier", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    plan = targets(sized, weights, budget, cap)
    plan = plan.withColumn("demand", F.floor("target").cast("long"))
    plan = plan.withColumn("passes", F.when(F.col("source_size") > 0, F.expr("demand div source_size")).otherwise(F.lit(0)).cast("long"))
    begun = filled.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")))
    begun = begun.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "earlier", "turn", "source_size", "target", "demand", "passes")
    placed = sized.withColumn("in_order", F.coalesce(F.sum("size").over(own), F.lit(0)))
    placed = placed.join(begun, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    rest = F.col("demand") - F.col("passes") * F.col("source_size")
    placed = placed.withColumn("before", F.col("earlier") + F.col("in_order")).withColumn(
        "taken", F.col("passes") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("before")))
    )
    middle = (F.col("before") + F.least("size", "taken") / F.lit(2.0)) / F.col("demand")
    return placed.select(
        "doc_id", "row_key", "source", "size", "source_size", "target", "turn", "demand", "before", "taken",
        F.when(F.col("taken") > 0, position(F.col("turn"), middle, schedules)).alias("position"),
    )


def curriculum(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` repeated by the words taken and sorted by training position.

    A document appears once for each begun pass; the copy of an unfinished pass ends after the words taken
    from it. Documents of which nothing is taken go; the columns stay those of ``docs``.
    """
    mixed = mix(docs, **settings).filter("taken > 0")
    mixed = mixed.withColumn("pass", F.explode(F.sequence(F.lit(0), F.expr("cast((taken - 1) div size as int)"))))
    mixed = mixed.withColumn("words", F.least(F.col("size"), F.col("taken") - F.col("pass") * F.col("size")))
    demand = F.col("pass") * F.col("source_size") + F.col("before") + F.col("words") / 2
    mixed = mixed.withColumn("at", position(F.col("turn"), demand / F.col("demand")))
    uses = mixed.groupBy("row_key", "pass", "words", "size").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    uses = uses.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    uses = uses.select(*(F.col(c).alias(f"__{c}") for c in ("row_key", "pass", "words", "size", "at", "copy")))
    texts = docs.withColumn("__row", row_key(docs)).dropDuplicates(["__row"])
    joined = texts.join(uses, F.col("__row") == F.col("__row_key"))
    part = F.array_join(F.slice(F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, F.col("__words").cast("int")), "")
    cutoff = F.when(F.col("__words") < F.col("__size"), part).otherwise(F.col("text"))
    columns = [cutoff.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return joined.orderBy("__at", "__row", "__copy", "__pass").select(*columns)


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ' ' || coalesce(text, '')) AS k
  FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
turns AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS turn FROM per),
weighed AS (
  SELECT *, CASE turn % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS words, source_size::DOUBLE * 2.0::DOUBLE AS most
  FROM turns),
ratios AS (SELECT *, most / weight AS ratio FROM weighed),
levels AS (
  SELECT *, (words - coalesce(sum(most) OVER (ORDER BY ratio, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY ratio, turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM ratios),
evened AS (SELECT *, max(CASE WHEN level < ratio THEN level END) OVER () AS even FROM levels),
plan AS (
  SELECT source, turn, source_size, CASE WHEN level >= ratio THEN most ELSE weight * even END AS target FROM evened),
demands AS (SELECT *, floor(target)::BIGINT AS demand FROM plan),
passes AS (SELECT *, CASE WHEN source_size > 0 THEN demand // source_size ELSE 0 END AS passes FROM demands),
placed AS (
  SELECT s.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s)
SELECT doc_id, size, d.source_size, target,
       (passes * size + greatest(0, least(size, demand - passes * d.source_size - before)))::BIGINT AS taken
FROM placed p JOIN passes d ON p.source IS NOT DISTINCT FROM d.source
"""
