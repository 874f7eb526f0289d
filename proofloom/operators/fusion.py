"""Rankings of several conditions: reciprocal rank fusion, pools and what is still to be judged.

A ranking has question_id, item, rank (1 first). All functions take whole tables of rankings.
"""

from __future__ import annotations

from functools import reduce
from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Constant, ranks that count and results of the fusion.
CONSTANT, DEPTH, FINAL = 60, 5, 5


def rrf(rankings: dict[str, DataFrame], constant: int = CONSTANT, depth: int = DEPTH, final: int = FINAL) -> DataFrame:
    """question_id, item, score, best_rank, n_lists, rank, and rank_<name> of each list.

    Scores are sums of integers over a common denominator, so ties are exact.
    """
    scale = reduce(lcm, range(constant + 1, constant + depth + 1))
    parts = [r.filter(F.col("rank") <= depth).select("question_id", "item", "rank", F.lit(name).alias("list")) for name, r in rankings.items()]
    rows = reduce(DataFrame.unionByName, parts)
    fused = rows.groupBy("question_id", "item").agg(
        F.sum(F.expr(f"{scale}L div ({constant} + rank)")).alias("units"),
        F.min("rank").alias("best_rank"),
        F.count(F.lit(1)).alias("n_lists"),
        *(F.min(F.when(F.col("list") == name, F.col("rank"))).alias(f"rank_{name}") for name in rankings),
    )
    order = Window.partitionBy("question_id").orderBy(F.desc("units"), "best_rank", "item")
    out = fused.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= final)
    return out.withColumn("score", F.col("units") / F.lit(float(scale))).drop("units")


def repeated(ranking: DataFrame) -> DataFrame:
    """Items that a list has twice: an error in its maker."""
    return ranking.groupBy("question_id", "item").count().filter("count > 1")


def pool(*rankings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [r.select("question_id", "item") for r in rankings]).distinct()


def exclusive(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("question_id", "item").distinct().join(b, ["question_id", "item"], "left_anti")


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """question_id, n_both."""
    both = a.select("question_id", "item").intersect(b.select("question_id", "item"))
    return both.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_both"))


def unjudged(pooled: DataFrame, judgments: DataFrame) -> DataFrame:
    return pooled.join(judgments, ["question_id", "item"], "left_anti")


def comparability(pooled: DataFrame, judgments: DataFrame) -> DataFrame:
    """question_id, n_unjudged, class: COMPARABLE or REPOOLING_REQUIRED."""
    known = judgments.select("question_id", "item", F.lit(1).alias("__j")).distinct()
    per = pooled.join(known, ["question_id", "item"], "left").groupBy("question_id").agg(F.count_if(F.col("__j").isNull()).alias("n_unjudged"))
    return per.withColumn("class", F.when(F.col("n_unjudged") == 0, "COMPARABLE").otherwise("REPOOLING_REQUIRED"))


def repooling_requests(a: DataFrame, b: DataFrame, judgments: DataFrame) -> DataFrame:
    """question_id, item, rank_a, rank_b of what either list has and nobody judged."""
    left = a.select("question_id", "item", F.col("rank").alias("rank_a"))
    right = b.select("question_id", "item", F.col("rank").alias("rank_b"))
    return left.join(right, ["question_id", "item"], "full_outer").join(judgments, ["question_id", "item"], "left_anti")


def verify_repooling(before: DataFrame, after: DataFrame) -> DataFrame:
    """question_id, item, change: added, removed or revised. Only additions are sound."""
    old = before.select("question_id", "item", F.col("grade").alias("old"))
    new = after.select("question_id", "item", F.col("grade").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "revised")
    return old.join(new, ["question_id", "item"], "full_outer").withColumn("change", change).filter("change is not null")


def unmet(requests: DataFrame, added: DataFrame) -> DataFrame:
    """question_id, item, side: asked for but not added, or added unasked."""
    keys = ["question_id", "item"]
    left = requests.select(*keys).join(added, keys, "left_anti").withColumn("side", F.lit("requested_not_added"))
    return left.unionByName(added.select(*keys).join(requests, keys, "left_anti").withColumn("side", F.lit("added_not_requested")))


def target_outcomes(targets: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """question_id, item, rank_a, rank_b, outcome of each target in two conditions."""
    keys = ["question_id", "item"]
    rows = targets.select(*keys).join(a.select(*keys, F.col("rank").alias("rank_a")), keys, "left").join(b.select(*keys, F.col("rank").alias("rank_b")), keys, "left")
    has_a, has_b = F.col("rank_a").isNotNull(), F.col("rank_b").isNotNull()
    return rows.withColumn("outcome", F.when(has_a & has_b, "both").when(has_a, "a_only").when(has_b, "b_only").otherwise("neither"))


def complementarity(outcomes: DataFrame) -> DataFrame:
    """How b stands to a over all targets: preserved, promoted, demoted, lost, exclusive."""
    a, b = F.col("rank_a"), F.col("rank_b")
    return outcomes.agg(
        F.count_if(a == b).alias("preserved"), F.count_if(b < a).alias("promoted"), F.count_if(b > a).alias("demoted"),
        F.count_if(a.isNotNull() & b.isNull()).alias("lost"), F.count_if(a.isNull() & b.isNotNull()).alias("gained"), F.count_if(a.isNull() & b.isNull()).alias("neither"),
    )
