"""Splits, abstention rules and their calibration, quantiles, scenario means and a cluster bootstrap."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the calibration grid and of the bootstrap.
MIN_TOP1 = (0.40, 0.45, 0.50, 0.55, 0.60)
MIN_MARGIN = (0.01, 0.02, 0.05)
MAX_FALSE_ABSTENTION = 0.2
REPLICATES, SEED, CONFIDENCE = 10_000, 20260819, 0.95
#: Scenarios in one part of the bootstrap, and tasks over which a part's replicates are dealt.
PART_ROWS, BLOCKS = 20_000, 8


def stratified_split(scenarios: DataFrame) -> DataFrame:
    """Adds split: DEV and HELD_OUT in turn within each (label, difficulty), by scenario_id."""
    order = Window.partitionBy("label", "difficulty").orderBy("scenario_id")
    return scenarios.withColumn("split", F.when((F.row_number().over(order) - 1) % 2 == 0, "DEV").otherwise("HELD_OUT"))


def leaks(rows: DataFrame) -> DataFrame:
    """Scenarios whose questions are on both sides of a split."""
    return rows.groupBy("scenario_id").agg(F.count_distinct("split").alias("n")).filter("n > 1").select("scenario_id")


def admission_signals(neighbours: DataFrame) -> DataFrame:
    """question_id, returned, top1, top2, margin of ranked similarities; the margin needs two."""
    per = neighbours.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("returned"), F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("top2")
    )
    return per.withColumn("margin", F.col("top1") - F.col("top2"))


def admits(rule: Column, top1: Column, margin: Column, min_top1: Column, min_margin: Column) -> Column:
    """R0 admits what returned anything, R1 asks for top1, R2 for top1 and a known margin."""
    some = top1.isNotNull()
    strong = F.coalesce(top1 >= min_top1, F.lit(False))
    wide = F.coalesce(margin >= min_margin, F.lit(False))
    return F.when(rule == "R0", some).when(rule == "R1", some & strong).otherwise(some & strong & wide)


def policy_grid(spark: SparkSession) -> DataFrame:
    """policy_id, rule, min_top1, min_margin: one R0, and R1 and R2 over the grid."""
    rows = [("R0", None, None)] + [("R1", t, None) for t in MIN_TOP1] + [("R2", t, m) for t in MIN_TOP1 for m in MIN_MARGIN]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "policy_id int, rule string, min_top1 double, min_margin double")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole, 6))


def admission_metrics(signals: DataFrame, policies: DataFrame) -> DataFrame:
    """Coverage, risk, correct and false abstention of every policy. ``signals`` has label ANSWERABLE or NO_EVIDENCE and solved."""
    packed = policies.agg(F.collect_list(F.struct(*policies.columns)).alias("__all"))
    rows = signals.join(F.broadcast(packed)).withColumn("p", F.explode("__all"))
    rows = rows.withColumn("admitted", admits(F.col("p.rule"), F.col("top1"), F.col("margin"), F.col("p.min_top1"), F.col("p.min_margin")))
    count = F.count_if
    a, ok, none = F.col("admitted"), F.col("label") == "ANSWERABLE", F.col("label") == "NO_EVIDENCE"
    per = rows.groupBy(*(F.col(f"p.{c}").alias(c) for c in policies.columns)).agg(
        count(F.lit(True)).alias("n"), count(a).alias("n_admitted"), count(a & ~F.col("solved")).alias("n_wrong"),
        count(none).alias("n_none"), count(none & ~a).alias("n_right_abstention"), count(ok).alias("n_ok"), count(ok & ~a).alias("n_false_abstention"),
    )
    return per.select(
        *policies.columns, "n", "n_admitted",
        _ratio(F.col("n_admitted"), F.col("n")).alias("coverage"), _ratio(F.col("n_wrong"), F.col("n_admitted")).alias("risk"),
        _ratio(F.col("n_right_abstention"), F.col("n_none")).alias("correct_abstention"), _ratio(F.col("n_false_abstention"), F.col("n_ok")).alias("false_abstention"),
    )


def select_policy(metrics: DataFrame) -> DataFrame:
    """The policy within the false-abstention budget with the most correct abstention, then least false, then simplest."""
    inside = metrics.filter(F.coalesce(F.col("false_abstention") <= MAX_FALSE_ABSTENTION, F.lit(True)))
    return inside.orderBy(F.desc_nulls_last("correct_abstention"), F.asc_nulls_last("false_abstention"), F.desc("coverage"), "rule", "min_top1", "min_margin").limit(1)


#: Buckets into which a range of values is counted at a time.
BUCKETS = 1024


def order_statistics(rows: DataFrame, column: str, ranks: list[int]) -> dict[int, float]:
    """Values at ranks (from 0, ascending) by distributed selection: a range is counted in buckets, and each rank's bucket is the next range.

    No state grows with the number of values; a pass returns ``BUCKETS`` rows a range at most, and a range is at an end when
    its bucket holds one value.
    """
    own = rows.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    low, high = own.agg(F.min("v"), F.max("v")).first()
    found: dict[int, float] = {}
    ranges = {r: (low, high, 0) for r in ranks}
    while ranges:
        distinct = sorted(set(ranges.values()))

        def place(i: int, low: float, high: float) -> Column:
            share = (F.col("v") / 2 - low / 2) / (high / 2 - low / 2) if high > low else F.lit(0.0)
            return F.when(F.col("v").between(low, high), F.struct(F.lit(i).alias("range"), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS)).cast("int").alias("bucket")))

        marked = own.select("v", F.explode(F.array_compact(F.array(*(place(i, low, high) for i, (low, high, _) in enumerate(distinct))))).alias("p"))
        counted = marked.groupBy("p.range", "p.bucket").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        later = {}
        for rank, own_range in ranges.items():
            below = own_range[2]
            for b in sorted((r for r in counted if r["range"] == distinct.index(own_range)), key=lambda r: r["bucket"]):
                if rank < below + b["n"]:
                    break
                below += b["n"]
            if b["low"] == b["high"]:
                found[rank] = b["low"]
            else:
                later[rank] = (b["low"], b["high"], below)
        ranges = later
    return found


def quantiles(rows: DataFrame, column: str, points: list[float]) -> DataFrame:
    """Quantiles with linear interpolation between order statistics, one row; null values do not count, without any all are null."""
    n = rows.filter(F.col(column).isNotNull()).count()
    at = {q: (n - 1) * q for q in points}
    ranks = sorted({rank for p in at.values() for rank in (math.floor(p), math.ceil(p))}) if n else []
    values = order_statistics(rows, column, ranks) if n else {}

    def value(p: float) -> float | None:
        if not n:
            return None
        low, high = math.floor(p), math.ceil(p)
        return values[low] * (1 - (p - low)) + values[high] * (p - low)

    names = [f"q{int(q * 1000):04d}" for q in points]
    return rows.sparkSession.createDataFrame([tuple(value(at[q]) for q in points)], ", ".join(f"{c} double" for c in names))


def scenario_mean(rows: DataFrame, column: str) -> DataFrame:
    """Mean over scenarios of the mean in each: every scenario weighs one."""
    per = rows.groupBy("scenario_id").agg(F.avg(column).alias("m"))
    return per.agg(F.count(F.lit(1)).alias("n_scenarios"), F.avg("m").alias("scenario_mean"))


def cluster_bootstrap(rows: DataFrame, column: str, replicates: int = REPLICATES, seed: int = SEED, confidence: float = CONFIDENCE, part_rows: int = PART_ROWS) -> DataFrame:
    """observed, low, high of the scenario mean under resampling of whole scenarios.

    Scenarios are dealt by a hash into parts of about ``part_rows``. A replicate's draws are dealt over the parts by one
    seeded multinomial that every part repeats, and each part returns the sum of its own draws.
    """
    per = rows.groupBy("scenario_id").agg(F.avg(column).alias("m")).filter("m is not null")
    total = per.count()
    dealt = per.select(F.pmod(F.xxhash64("scenario_id"), F.lit(max(1, -(-total // part_rows)))).cast("int").alias("part"), "m")
    counts = sorted((r["part"], r["count"]) for r in dealt.groupBy("part").count().collect())
    places, sizes = {part: k for k, (part, _) in enumerate(counts)}, np.array([n for _, n in counts], float)

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        part, block = (int(k) for k in key)
        means, sums = np.sort(group["m"].to_numpy(float)), []
        for replicate in range(block, replicates, BLOCKS):
            drawn = int(np.random.default_rng([seed, replicate]).multinomial(total, sizes / total)[places[part]])
            picks = np.random.default_rng([seed, replicate, part]).integers(0, len(means), drawn)
            sums.append((replicate, part, float(means[picks].sum())))
        return pd.DataFrame(sums, columns=["replicate", "part", "sum"])

    blocks = dealt.withColumn("block", F.explode(F.array(*(F.lit(k) for k in range(BLOCKS)))))
    drawn = blocks.groupBy("part", "block").applyInPandas(run, "replicate long, part int, sum double")
    in_order = F.array_sort(F.collect_list(F.struct("part", "sum")))
    sampled = drawn.groupBy("replicate").agg((F.aggregate(in_order, F.lit(0.0), lambda s, x: s + x["sum"]) / F.lit(total)).alias("mean"))
    tail = (1 - confidence) / 2
    bounds = sampled.agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    return per.agg(F.count(F.lit(1)).alias("n_scenarios"), F.avg("m").alias("observed")).join(bounds)


def interval_decision(low: Column, high: Column, regressed: Column) -> Column:
    """A: better and nothing worse; B: not told apart; C: worse or something regressed."""
    return F.when((low > 0) & ~regressed, "A").when((high < 0) | regressed, "C").otherwise("B")


def generalises(dev: Column, held: Column, false_abstention: Column, retention: float = 0.5, budget: float = MAX_FALSE_ABSTENTION) -> Column:
    """Whether a policy keeps enough of its correct abstention on held-out questions within the budget."""
    return (held >= dev * F.lit(retention)) & (false_abstention <= budget)
