"""Which items dominate others in all signals: targets against the items ranked above them, and skylines.

An item is dominated by another if no signal favours it, that is, if it exceeds the other in none by more than ``NEAR``. All weights of
a score are at least zero, so no other weighting puts a dominated target before its competitor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.sources.stored import stored

# Fixed value: differences up to this are ties.
NEAR = 1e-9
#: Rows of a block of a skyline.
BLOCK = 4_096
#: How often blocks are dealt before they meet.
ROUNDS = 2


def favours(signals: list[str], target: str = "t", competitor: str = "c") -> Column:
    """A bit for each signal in which the target exceeds the competitor; both are structs of the signals."""
    bits = [F.when(F.col(f"{target}.{s}") - F.col(f"{competitor}.{s}") > NEAR, F.lit(1 << n)).otherwise(F.lit(0)) for n, s in enumerate(signals)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total.cast("int")


def named(mask: Column, signals: list[str]) -> Column:
    """The signals of a mask, sorted and joined by commas."""
    order = sorted(range(len(signals)), key=signals.__getitem__)
    return F.array_join(F.array_compact(F.array(*(F.when(mask.bitwiseAND(F.lit(1 << n)) > 0, F.lit(signals[n])) for n in order))), ",")


def compare(targets: DataFrame, items: DataFrame, signals: list[str]) -> DataFrame:
    """question_id, target, item, favours, dominated, score_gap of every target with each item that is ranked before it.

    Both tables have question_id, item, rank, score and the signals. A question has one target, so there is one row an item at most.
    """
    packed = F.struct(*signals)
    t = targets.select("question_id", F.col("item").alias("target"), F.col("rank").alias("__rank"), F.col("score").alias("__score"), packed.alias("t"))
    pairs = items.select("question_id", "item", "rank", "score", packed.alias("c")).join(t, "question_id").filter(F.col("rank") < F.col("__rank"))
    mask = favours(signals)
    return pairs.select("question_id", "target", "item", mask.alias("favours"), (mask == 0).alias("dominated"), (F.col("score") - F.col("__score")).alias("score_gap"))


def summary(compared: DataFrame, signals: list[str]) -> DataFrame:
    """question_id, target, n_competitors, n_dominating, common_signals, diagnosis.

    ``common_signals`` favour the target against all its competitors: weight on one of them alone puts it first. A target that a
    competitor dominates has ``insufficient_signals``, any other is ``reweightable`` pair by pair.
    """
    per = compared.groupBy("question_id", "target").agg(F.count(F.lit(1)).alias("n_competitors"), F.count_if("dominated").alias("n_dominating"), F.bit_and("favours").alias("m"))
    diagnosis = F.when(F.col("n_dominating") > 0, "insufficient_signals").otherwise("reweightable")
    return per.select("question_id", "target", "n_competitors", "n_dominating", named(F.col("m"), signals).alias("common_signals"), diagnosis.alias("diagnosis"))


# ---- skylines ---------------------------------------------------------------------------------------------------


def _beaten(points: np.ndarray, others: np.ndarray) -> np.ndarray:
    """For each point, whether one of the others is at least as large in all signals and larger in one."""
    out = np.zeros(len(points), dtype=bool)
    for n, p in enumerate(points):
        above = (others >= p).all(axis=1)
        out[n] = bool(above.any()) and bool((others[above] > p).any())
    return out


def _best_of(points: np.ndarray) -> np.ndarray:
    """Which points of a block none of the block beats. A point can only be beaten by one of a larger sum, so those come first."""
    order = np.argsort(-points.sum(axis=1), kind="stable")
    kept: list[int] = []
    for at in order:
        if not kept or not _beaten(points[at : at + 1], points[kept])[0]:
            kept.append(int(at))
    mask = np.zeros(len(points), dtype=bool)
    mask[kept] = True
    return mask


def skyline(items: DataFrame, group: str, item: str, signals: list[str], block: int = BLOCK) -> DataFrame:
    """group, item of the items that no other of their group beats; of equal items all stay. Null signals count as least.

    Groups are dealt into blocks of about ``block`` rows by a hash of the item, and a block loses what it can beat by itself. What
    is left is counted, dealt anew and reduced again, ``ROUNDS`` times in all; then each two blocks of a group meet once. A call
    holds a few blocks at most, whatever the size of the group, and meetings grow with the square of what the rounds leave (the
    skyline, mostly), not of the group.
    """
    least = F.lit(float("-inf"))
    left = items.select(group, item, *(F.coalesce(F.col(s).cast("double"), least).alias(s) for s in signals))
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields} | {"__blocks": "int", "__b": "int"}
    columns = [group, item, *signals, "__blocks", "__b"]

    def deal(rows: DataFrame, turn: int) -> DataFrame:
        counts = rows.groupBy(group).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("__blocks"))
        return rows.join(counts.withColumnRenamed(group, "__g"), F.col(group).eqNullSafe(F.col("__g"))).drop("__g").withColumn("__b", F.pmod(F.xxhash64(item, F.lit(turn)), F.col("__blocks")).cast("int"))

    def alone(part: pd.DataFrame) -> pd.DataFrame:
        points, kept = part[signals].to_numpy(), np.zeros(len(part), dtype=bool)
        for at in part.groupby([group, "__b"], dropna=False).indices.values():
            kept[at] = _best_of(points[at])
        return part.loc[kept, columns]

    # Small groups share a task's call: blocks are packed by hash, about ``block`` rows together.
    calls = max(1, -(-items.count() // block))
    for turn in range(ROUNDS):
        packed = deal(left, turn).withColumn("__call", F.pmod(F.xxhash64(group, "__b"), F.lit(calls)))
        local = stored(packed.groupBy("__call").applyInPandas(alone, ", ".join(f"`{c}` {kinds[c]}" for c in columns)))
        left = local.drop("__blocks", "__b")
    # A row of block b goes to the meeting of b with each other block; a meeting is named by its two blocks.
    others = F.filter(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda o: o != F.col("__b"))
    few = local.filter("__blocks = 1").select(group, item)  # one block in the last round
    many = local.filter("__blocks > 1").withColumn("__o", F.explode(others))
    many = many.withColumns({"__low": F.least("__b", "__o"), "__high": F.greatest("__b", "__o")})

    def meeting(key: tuple, parts: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        low = parts["__b"].to_numpy() == key[1]
        points = parts[signals].to_numpy()
        lost = np.zeros(len(points), dtype=bool)
        lost[low] = _beaten(points[low], points[~low])
        lost[~low] = _beaten(points[~low], points[low])
        return parts.assign(lost=lost)[[group, item, "lost"]]

    met = many.groupBy(group, "__low", "__high").applyInPandas(meeting, f"`{group}` {kinds[group]}, `{item}` {kinds[item]}, lost boolean")
    return few.unionByName(met.groupBy(group, item).agg(F.bool_or("lost").alias("lost")).filter("not lost").select(group, item))
