"""Pairs of similar sets: exact, and never a join on a common word.

Equal sets are one class, named by its smallest id, so copies never pair with each other. Classes lie in blocks; a slice of
classes meets a block within one task, which counts common words by adding up rows of small counts (``blocks``), so only
pairs that reach the similarity leave the task. Two sets of Jaccard similarity t or more have a word in common among
the first n - ceil(t n) + 1 of each, the rarest first (``prefixes``, ``candidates``); where t is low these prefixes are nearly
the whole sets, so ``similar_classes`` does not use them.

Null sets are left out; two empty sets are equal. Null words count as no word; a word that repeats counts once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.operators import blocks
from proofloom.sources.stored import stored

#: Sets in a block, and in a slice that meets it.
BLOCK, SLICE = 16_384, 8_192

#: Guards comparisons of sizes against the last bits of a product.
_TINY = 1e-9


def classes(sets: DataFrame, key: str, words: str) -> DataFrame:
    """key, class: each row of a set with the smallest key of its equals."""
    named = sets.filter(F.col(words).isNotNull()).select(key, F.array_sort(F.array_distinct(F.array_compact(words))).alias("__w"))
    least = named.groupBy("__w").agg(F.min(key).alias("class"))
    return named.join(least, "__w").select(key, "class", F.col("__w").alias("words"))


def prefixes(distinct: DataFrame, threshold: float) -> DataFrame:
    """class, n, place, word of the first words of each set, the rarest first."""
    flat = distinct.select("class", F.size("words").alias("n"), F.explode("words").alias("word"))
    counts = flat.groupBy("word").agg(F.count(F.lit(1)).alias("uses"))
    ordered = flat.join(counts, "word").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("uses", "word"))).alias("o"))
    length = F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - F.lit(_TINY)) + 1
    return ordered.select("class", "n", F.posexplode(F.slice("o", F.lit(1), length.cast("int"))).alias("place", "w")).select("class", "n", "place", "w.word")


def candidates(first: DataFrame, threshold: float) -> DataFrame:
    """class_a, class_b that meet on a word of both prefixes and may reach the similarity by size and place."""
    a, b = (first.select("word", *(F.col(c).alias(f"{c}_{s}") for c in ("class", "n", "place"))) for s in "ab")
    t = F.lit(threshold)
    needed = F.ceil((F.col("n_a") + F.col("n_b")) * t / (F.lit(1.0) + t) - F.lit(_TINY))
    behind = 1 + F.least(F.col("n_a") - F.col("place_a") - 1, F.col("n_b") - F.col("place_b") - 1) + F.least("place_a", "place_b")
    met = a.join(b, "word").filter("class_a < class_b")
    sized = (F.col("n_a") >= F.col("n_b") * t - F.lit(_TINY)) & (F.col("n_b") >= F.col("n_a") * t - F.lit(_TINY))
    return met.filter(sized & (behind >= needed)).select("class_a", "class_b").distinct()


def similar_classes(distinct: DataFrame, threshold: float) -> DataFrame:
    """class_a, class_b, jaccard of the pairs of different sets that reach the threshold (over 0). ``distinct``: class, words."""
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies over 0 and up to 1")
    rows = stored(distinct)
    kind = rows.schema["class"].dataType.simpleString()
    place = [F.lit("").alias("institution_id"), F.lit("").alias("language")]
    sets = rows.select(*place, F.col("class").alias("chunk_id"), F.col("class").alias("document_id"), F.lit(0).alias("chunk_index"), "words")
    held = blocks.build_sets(sets, max(1, -(-rows.count() // BLOCK)))
    asked = rows.select(F.col("class").alias("question_id"), *place, "words")

    def answer(block: blocks.Block, questions: pa.Table) -> pa.Table:
        sizes = np.bincount(block.text, minlength=block.n)
        ids = block.id("chunk_id", np.arange(block.n))
        keys = ids.to_numpy(zero_copy_only=False)
        own = questions.column("question_id").combine_chunks()
        needed = sizes * (threshold / (1 + threshold)) - _TINY
        rows, slots, values = [], [np.empty(0, np.int64)], [np.empty(0)]
        for i, (key, words) in enumerate(zip(own.to_pylist(), questions.column("words").to_pylist())):
            behind = int(np.searchsorted(keys, key, side="right"))
            common = block.worth(words)[behind:]
            met = np.flatnonzero(common - len(words) * threshold / (1 + threshold) >= needed[behind:])
            both = common[met].astype(np.int64)
            jaccard = both / np.maximum(len(words) + sizes[behind:][met] - both, 1)
            good = jaccard >= threshold - _TINY
            rows.append(np.full(np.count_nonzero(good), i)), slots.append(met[good] + behind), values.append(jaccard[good])
        return pa.table({"class_a": own.take(pa.array(np.concatenate(rows))), "class_b": ids.take(pa.array(np.concatenate(slots))), "jaccard": np.concatenate(values)})

    return blocks.met(asked, held, answer, ["chunk_id"], f"class_a {kind}, class_b {kind}, jaccard double", SLICE)


def leaks(questions: DataFrame, threshold: float) -> DataFrame:
    """class_a, class_b, jaccard, n_a, n_b: sets of words that stand in both splits, and similar ones of which one is in DEV and one in HELD_OUT.

    ``questions``: question_id, split, words. n_a and n_b count the questions of the two sets.
    """
    named = stored(classes(questions, "question_id", "words").join(questions.select("question_id", "split"), "question_id"))
    held = named.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("split") == "DEV").alias("dev"), F.max(F.col("split") == "HELD_OUT").alias("out"))
    found = similar_classes(named.select("class", "words").distinct(), threshold)
    side = lambda s: held.select(*(F.col(c).alias(f"{c}_{s}") for c in held.columns))
    pairs = found.join(side("a"), "class_a").join(side("b"), "class_b").filter("(dev_a AND out_b) OR (out_a AND dev_b)")
    same = held.filter("dev AND out").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"), F.lit(1.0).alias("jaccard"), F.col("n").alias("n_a"), F.col("n").alias("n_b"))
    return pairs.select(*same.columns).unionByName(same)
