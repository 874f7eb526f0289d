"""Questions paired with the same questions in which diacritics are restored: words aligned, and claims of what was restored.

A pair is sound if the restored text without its marks is the original, to the letter. Then words stand at the same places in
both, and the alignment is by position.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _marks() -> tuple[str, str]:
    """Letters that decompose to one letter and marks, with marks by themselves at the end; and those letters, so that marks go."""
    pairs, alone = [], []
    for code in [*range(0x80, 0xD800), *range(0xF900, 0x10000)]:
        c = chr(code)
        rest = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if not rest:
            alone.append(c)
        elif len(rest) == 1 and rest != c:
            pairs.append((c, rest))
    return "".join(p[0] for p in pairs) + "".join(alone), "".join(p[1] for p in pairs)


_FROM, _TO = _marks()


def stripped(text: Column) -> Column:
    """Text without the marks of its letters, by canonical decomposition, inside the JVM; case and ligatures stay.

    Characters beyond U+FFFF and Hangul syllables stay as they are.
    """
    return F.translate(text, _FROM, _TO)


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def paired(pairs: DataFrame) -> DataFrame:
    """Adds reworded, and marked: (position, plain, accented) of each word that has marks, in order; null texts are empty.

    ``pairs``: question_id, original, restored. Positions count words from 0; a reworded pair has no alignment.
    """
    text, first = (F.coalesce(c, F.lit("")) for c in ("restored", "original"))
    bare = pairs.withColumn("__bare", stripped(text)).withColumn("reworded", F.col("__bare") != first)
    both = F.arrays_zip(words(F.col("__bare")).alias("plain"), words(text).alias("accented"))
    placed = F.transform(both, lambda w, i: F.struct(i.alias("position"), w["plain"].alias("plain"), w["accented"].alias("accented")))
    marked = F.filter(placed, lambda w: ~w["plain"].eqNullSafe(w["accented"]))
    none = F.expr("cast(array() as array<struct<position: int, plain: string, accented: string>>)")
    return bare.withColumn("marked", F.when(F.col("reworded"), none).otherwise(marked)).drop("__bare")


def restored_words(pairs: DataFrame) -> DataFrame:
    """plain, accented, n_places, n_questions: what was restored to what, over all pairs."""
    flat = paired(pairs).select("question_id", F.explode("marked").alias("w"))
    per = flat.groupBy("w.plain", "w.accented", "question_id").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("plain", "accented").agg(F.sum("n").alias("n_places"), F.count(F.lit(1)).alias("n_questions"))


def claim_problems(pairs: DataFrame) -> DataFrame:
    """question_id, problem, word: what is wrong with the claims of each pair, once for each word.

    ``pairs`` also has claims, an array of (plain, accented). Problems: ``reworded`` (the pair itself; its claims are not looked at),
    ``not_a_restoration`` (the accented word without marks is another), ``nothing_restored`` (both are equal), ``not_in_text``, and
    ``undeclared`` for words with marks in the text that no claim names. Null claims are none.
    """
    none = F.expr("cast(array() as array<struct<plain: string, accented: string>>)")
    rows = paired(pairs).withColumn("claims", F.coalesce("claims", none))
    sound = rows.filter("not reworded")
    text = F.array_distinct(words(F.coalesce("restored", F.lit(""))))
    declared = F.transform("claims", lambda c: c["accented"])
    missing = F.array_except(F.array_distinct(F.transform("marked", lambda w: w["accented"])), declared)
    each = sound.select("question_id", F.explode("claims").alias("c"), text.alias("t"))
    judged = each.select("question_id", "c", stripped(F.col("c.accented")).alias("bare"), F.array_contains("t", F.col("c.accented")).alias("there"))
    wrong = F.array_compact(F.array(
        F.when(~F.col("bare").eqNullSafe(F.col("c.plain")), "not_a_restoration"), F.when(F.col("c.plain").eqNullSafe(F.col("c.accented")), "nothing_restored"),
        F.when(~F.coalesce("there", F.lit(False)), "not_in_text"),
    ))
    found = judged.select("question_id", F.explode(wrong).alias("problem"), F.col("c.accented").alias("word"))
    found = found.unionByName(sound.select("question_id", F.lit("undeclared").alias("problem"), F.explode(missing).alias("word")))
    found = found.unionByName(rows.filter("reworded").select("question_id", F.lit("reworded").alias("problem"), F.lit(None).cast("string").alias("word")))
    return found.distinct()
