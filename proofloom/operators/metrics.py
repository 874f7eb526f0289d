"""Retrieval measures over whole tables of rankings and judgments. What is undefined is null, never zero.

A ranking has question_id, item, rank; judgments have question_id, item, grade (0 to 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Cut-offs and the grade that counts as relevant.
CUTOFFS = (1, 3, 5)
RELEVANT = 2


def gain(grade: Column) -> Column:
    return F.when(grade >= 2, 3.0).when(grade == 1, 1.0).otherwise(0.0)


def graded(ranking: DataFrame, judgments: DataFrame) -> DataFrame:
    """The ranking with grade (0 where nobody judged) and judged."""
    rows = ranking.join(judgments.select("question_id", "item", F.col("grade").alias("__g")), ["question_id", "item"], "left")
    return rows.withColumns({"grade": F.coalesce("__g", F.lit(0)), "judged": F.col("__g").isNotNull()}).drop("__g")


def per_question(ranking: DataFrame, judgments: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """question_id, n_relevant, recall_k, reciprocal_rank, ndcg_k for every judged question."""
    at_rank = gain(F.col("grade")) / F.log2(F.col("rank") + 1)
    hits = graded(ranking, judgments).groupBy("question_id").agg(
        *(F.count_if((F.col("rank") <= k) & (F.col("grade") >= RELEVANT)).alias(f"hits_{k}") for k in cutoffs),
        *(F.sum(F.when(F.col("rank") <= k, at_rank).otherwise(0.0)).alias(f"dcg_{k}") for k in cutoffs),
        F.min(F.when(F.col("grade") >= RELEVANT, F.col("rank"))).alias("first"),
    )
    best = judgments.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("grade"))))
    ideal = best.groupBy("question_id").agg(
        F.count_if(F.col("grade") >= RELEVANT).alias("n_relevant"),
        *(F.sum(F.when(F.col("rank") <= k, at_rank).otherwise(0.0)).alias(f"ideal_{k}") for k in cutoffs),
    )
    rows = ideal.join(hits, "question_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.select(
        "question_id", "n_relevant",
        *(F.when(F.col("n_relevant") > 0, zero(f"hits_{k}") / F.col("n_relevant")).alias(f"recall_{k}") for k in cutoffs),
        F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        *(F.when(F.col(f"ideal_{k}") > 0, F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"ideal_{k}")).alias(f"ndcg_{k}") for k in cutoffs),
    )


def macro(measures: DataFrame, rounded_first: bool = True, digits: int = 6) -> DataFrame:
    """Means over the questions with something relevant; of rounded or of plain values."""
    columns = [c for c in measures.columns if c.startswith(("recall_", "ndcg_")) or c == "reciprocal_rank"]
    value = (lambda c: F.round(c, digits)) if rounded_first else F.col
    return measures.filter("n_relevant > 0").agg(F.count(F.lit(1)).alias("n_questions"), *(F.round(F.avg(value(c)), digits).alias(f"mean_{c}") for c in columns))


def grade_histogram(graded_rows: DataFrame) -> DataFrame:
    """question_id, n_grade_0..2, n_unjudged, irrelevant_share."""
    g = F.col("grade")
    return graded_rows.groupBy("question_id").agg(
        F.count_if(F.col("judged") & (g == 0)).alias("n_grade_0"), F.count_if(g == 1).alias("n_grade_1"), F.count_if(g == 2).alias("n_grade_2"),
        F.count_if(~F.col("judged")).alias("n_unjudged"), (F.count_if(g == 0) / F.count(F.lit(1))).alias("irrelevant_share"),
    )


def breakdown(measures: DataFrame, attributes: DataFrame, measure: str) -> DataFrame:
    """Mean of a measure for each value of a multi-valued attribute (question_id, values array)."""
    rows = measures.join(attributes.select("question_id", F.explode("values").alias("value")), "question_id")
    return rows.groupBy("value").agg(F.count(F.lit(1)).alias("n_questions"), F.avg(measure).alias(f"mean_{measure}"))


def target_fate(targets: DataFrame, decided: DataFrame, returned: DataFrame) -> DataFrame:
    """question_id, item, fate: RETURNED, OUTSIDE_TOP_K, EXCLUDED or NEVER_A_CANDIDATE."""
    keys = ["question_id", "item"]
    seen = decided.groupBy(*keys).agg(F.max(F.col("status") == "kept").alias("kept"))
    rows = targets.select(*keys).join(seen, keys, "left").join(returned.select(*keys, F.lit(True).alias("out")).distinct(), keys, "left")
    fate = F.when(F.col("out"), "RETURNED").when(F.col("kept"), "OUTSIDE_TOP_K").when(~F.col("kept"), "EXCLUDED").otherwise("NEVER_A_CANDIDATE")
    return rows.select(*keys, fate.alias("fate"))


def candidate_recall(fates: DataFrame) -> DataFrame:
    return fates.agg(F.count(F.lit(1)).alias("n_targets"), F.avg((F.col("fate") != "NEVER_A_CANDIDATE").cast("double")).alias("candidate_recall"))


def direction(before: DataFrame, after: DataFrame, measures: list[str], epsilon: float = 1e-9) -> DataFrame:
    """question_id, direction of the change: improved, regressed, mixed or same."""
    rows = before.select("question_id", *(F.col(m).alias(f"__{m}") for m in measures)).join(after.select("question_id", *measures), "question_id")
    deltas = F.array(*(F.col(m) - F.col(f"__{m}") for m in measures))
    up, down = F.exists(deltas, lambda d: d > epsilon), F.exists(deltas, lambda d: d < -epsilon)
    return rows.select("question_id", F.when(up & down, "mixed").when(up, "improved").when(down, "regressed").otherwise("same").alias("direction"))


def rank_of(ranking: DataFrame, items: DataFrame) -> DataFrame:
    """(question_id, item, rank), rank null where the list lacks the item."""
    return items.join(ranking.select("question_id", "item", "rank"), ["question_id", "item"], "left")


def weighted_variants(features: DataFrame, variants: DataFrame, signals: list[str]) -> DataFrame:
    """Each pair's score under each weighting. ``variants``: variant and one weight for each signal, a few rows."""
    total = F.aggregate(F.array(*(F.col(f"__w.{s}") for s in signals)), F.lit(0.0), lambda a, w: a + w)
    packed = variants.agg(F.collect_list(F.struct("variant", *signals)).alias("__all"))
    rows = features.join(F.broadcast(packed)).withColumn("__w", F.explode("__all"))
    score = None
    for s in signals:
        part = F.col(f"__w.{s}") / total * F.col(s)
        score = part if score is None else score + part
    return rows.select(*features.columns, F.col("__w.variant").alias("variant"), score.alias("variant_score")).drop("__all")


def decomposition(features: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row for each pair and signal: value, weight, contribution."""
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(s).cast("double").alias("value"), F.lit(w).alias("weight")) for s, w in weights.items())))
    flat = features.select("question_id", "chunk_id", rows.alias("s")).select("question_id", "chunk_id", "s.*")
    return flat.withColumn("contribution", F.col("value") * F.col("weight"))


def competitors(ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """Each target beside every item ranked above it, with the score they are apart."""
    mine = ranked.join(targets.select("question_id", "item"), ["question_id", "item"], "left_semi")
    mine = mine.select("question_id", F.col("item").alias("target"), F.col("rank").alias("target_rank"), F.col("score").alias("target_score"))
    rows = mine.join(ranked.select("question_id", "item", "rank", "score"), "question_id").filter("rank < target_rank")
    return rows.withColumn("gap", F.col("score") - F.col("target_score"))


BUDGETS = ("current_quota", "redistribute_unused", "global_limited_pool")


def budget_policies(matches: DataFrame, limit: int) -> DataFrame:
    """question_id, turn, available, and what each policy returns of it. ``matches``: question_id, turn, n_variants, available.

    ``redistribute_unused`` gives each variant in turn an even share of what is left, rounded up; the pool
    policy hands out in order of turn until the limit is used.
    """
    ordered = Window.partitionBy("question_id").orderBy("turn")
    lists = matches.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("turn", "available"))).alias("__v"), F.first("n_variants").alias("__n"))
    start = F.struct(F.lit(limit).alias("left"), F.array().cast("array<int>").alias("given"))

    def step(acc: Column, v: Column) -> Column:
        share = F.ceil(acc["left"] / (F.col("__n") - v["turn"])).cast("int")
        got = F.least(v["available"].cast("int"), share)
        return F.struct((acc["left"] - got).alias("left"), F.array_append(acc["given"], got).alias("given"))

    fair = lists.select("question_id", F.posexplode(F.aggregate("__v", start, step, lambda acc: acc["given"])).alias("__i", "redistribute_unused"), F.col("__v.turn").alias("__t"))
    fair = fair.select("question_id", F.get("__t", F.col("__i")).alias("turn"), "redistribute_unused")
    before = F.coalesce(F.sum("available").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = F.floor(F.lit(limit) / F.col("n_variants")) + (F.col("turn") < F.lit(limit) % F.col("n_variants")).cast("int")
    rows = matches.withColumns(
        {
            "current_quota": F.least("available", quota).cast("int"),
            "global_limited_pool": F.greatest(F.lit(0), F.least(F.col("available"), F.lit(limit) - before)).cast("int"),
        }
    )
    return rows.join(fair, ["question_id", "turn"])
