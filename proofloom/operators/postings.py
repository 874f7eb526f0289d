"""Full-text search by lexeme: positional posting lists in blocks by impact, and an exact top-k of alternatives that skips blocks.

A text is the array of its words' lexemes, with an empty one for each word without content, so places are kept. A
posting is a chunk with the places of one lexeme; the impact of a posting is how many places it has. The list of a
lexeme, within an institution and language, is stored in blocks of one impact and about ``BLOCK`` postings.

The worth of a chunk for alternatives is the number of its places that hold one of them. ``top_alternatives`` takes a few
blocks of the highest impacts first; the k-th best worth among their chunks is a worth that the answer reaches at
least. Then levels of impact are left out, the longest first, as long as their impacts, one a lexeme, add up to less:
a chunk that has nothing but left-out postings cannot reach that worth. The chunks of the other blocks are weighed in
full. So a frequent word that adds little is never read, and the answer is that of reading everything.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.lexical import fts_configuration
from proofloom.functions.stems import lexemes
from proofloom.operators import retrieval
from proofloom.sources.stored import stored

BLOCK = 1024
#: Impacts from here on share a level.
HIGH = 64
PLACE = ["institution_id", "language"]
IDS = ["chunk_id", "document_id", "chunk_index"]


def with_lexemes(rows: DataFrame, words: str, language: str = "language") -> DataFrame:
    """``words`` as lexemes of the language's configuration; words without content are empty."""
    return rows.withColumn(words, lexemes(F.col(words), fts_configuration(F.col(language))))


def lexeme_units(variants: DataFrame) -> DataFrame:
    """Adds units (parsed input) whose words are lexemes. Units without content go, and empty words at the ends of phrases."""
    parsed = variants.withColumn("units", retrieval.parse_websearch(F.col("input")))
    surfaces = F.array_distinct(F.flatten(F.transform("units", lambda u: u["phrase"])))
    known = parsed.withColumn("__w", surfaces).withColumn("__l", lexemes(F.col("__w"), fts_configuration(F.col("language"))))
    mapping = F.map_from_arrays("__w", "__l")

    def trimmed(phrase: Column) -> Column:
        own = F.transform(phrase, lambda w: F.try_element_at(mapping, w))
        full = F.filter(F.transform(own, lambda w, i: F.when(w != "", i)), lambda i: i.isNotNull())
        return F.when(F.size(full) == 0, F.slice(own, 1, 0)).otherwise(F.slice(own, F.array_min(full) + 1, F.array_max(full) - F.array_min(full) + 1))

    units = F.transform("units", lambda u: F.struct(u["negated"].alias("negated"), trimmed(u["phrase"]).alias("phrase"), u["alternative"].alias("alternative")))
    return known.withColumn("units", F.filter(units, lambda u: F.size(u["phrase"]) > 0)).drop("__w", "__l")


@dataclass
class PostingIndex:
    """texts: ids and lexemes of each chunk; blocks: institution_id, language, lexeme, impact (of the level), part, n, most, entries."""

    texts: DataFrame
    blocks: DataFrame


def build(chunks: DataFrame, block: int = BLOCK) -> PostingIndex:
    """From chunks with institution_id, language, chunk_id, document_id, chunk_index and words (in order)."""
    texts = stored(with_lexemes(chunks.select(*PLACE, *IDS, "words"), "words").withColumnRenamed("words", "lexemes"))
    places = texts.select(*PLACE, *IDS, F.posexplode("lexemes").alias("place", "lexeme")).filter("lexeme <> ''")
    found = places.groupBy(*PLACE, "lexeme", *IDS).agg(F.sort_array(F.collect_list("place")).alias("places"))
    found = stored(found.withColumn("impact", F.least(F.size("places"), F.lit(HIGH))))
    sized = found.groupBy(*PLACE, "lexeme", "impact").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).alias("parts"))
    dealt = found.join(sized, [*PLACE, "lexeme", "impact"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts")))
    entries = F.collect_list(F.struct(*IDS, "places")).alias("entries")
    blocks = dealt.groupBy(*PLACE, "lexeme", "impact", "part").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("places")).alias("most"), entries)
    return PostingIndex(texts, stored(blocks))


def _weighed(pairs: DataFrame, asked: DataFrame, index: PostingIndex) -> DataFrame:
    """Pairs (question_id, chunk_id) with worth and the chunk's ids."""
    own = pairs.join(asked.select("question_id", "lexemes"), "question_id").join(index.texts.select(*IDS, F.col("lexemes").alias("__t")), "chunk_id")
    return own.select("question_id", *IDS, F.size(F.filter("__t", lambda t: F.array_contains("lexemes", t))).alias("worth"))


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("question_id").orderBy(F.desc("worth"), "document_id", "chunk_index", "chunk_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def levels_to_read(group: pd.DataFrame) -> pd.DataFrame:
    """Of a question's levels (lexeme, impact, n, most, reach) those that are not left out.

    The most that can be left out adds up to less than ``reach``: by lexeme, levels from the lowest impact up, and of all
    next levels always the one with most postings for what it adds.
    """
    left = float(group["reach"].iloc[0]) - 1
    lists = {lexeme: rows.sort_values("impact") for lexeme, rows in group.groupby("lexeme")}
    gone = dict.fromkeys(lists, 0)
    spent = dict.fromkeys(lists, 0)
    while True:
        options = []
        for lexeme, rows in lists.items():
            if gone[lexeme] < len(rows):
                row = rows.iloc[gone[lexeme]]
                price = int(row["most"]) - spent[lexeme]
                if price <= left:
                    options.append((row["n"] / max(price, 1), lexeme, price, int(row["most"])))
        if not options:
            break
        _, lexeme, price, most = max(options)
        left, spent[lexeme], gone[lexeme] = left - price, most, gone[lexeme] + 1
    kept = pd.concat([rows.iloc[gone[lexeme] :] for lexeme, rows in lists.items()])
    return kept[["question_id", "institution_id", "language", "lexeme", "impact", "n"]]


def levels(asked: DataFrame, index: PostingIndex, k: int) -> tuple[DataFrame, DataFrame]:
    """All levels of the questions' lexemes, and those that have to be read. ``asked``: question_id, institution_id, language, lexemes (distinct)."""
    wanted = asked.select("question_id", *PLACE, F.explode("lexemes").alias("lexeme"))
    stats = index.blocks.groupBy(*PLACE, "lexeme", "impact").agg(F.sum("n").alias("n"), F.max("most").alias("most"))
    every = stored(wanted.join(stats, [*PLACE, "lexeme"]))
    down = Window.partitionBy("question_id").orderBy(F.desc("impact"), "n", "lexeme").rowsBetween(Window.unboundedPreceding, -1)
    first = every.withColumn("before", F.coalesce(F.sum(F.least("n", F.lit(BLOCK))).over(down), F.lit(0))).filter(F.col("before") < 2 * k)
    seen = first.select("question_id", *PLACE, "lexeme", "impact").join(index.blocks.filter("part = 0"), [*PLACE, "lexeme", "impact"])
    pairs = seen.select("question_id", F.explode("entries.chunk_id").alias("chunk_id")).distinct()
    reached = _best(_weighed(pairs, asked, index), k).groupBy("question_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("worth")).otherwise(0).alias("reach"))
    known = every.join(reached, "question_id", "left").withColumn("reach", F.coalesce("reach", F.lit(0)))
    kind = lambda c: every.schema[c].dataType.simpleString()
    schema = ", ".join(f"{c} {kind(c)}" for c in ("question_id", *PLACE, "lexeme", "impact", "n"))
    return every, known.groupBy("question_id").applyInPandas(levels_to_read, schema)


def top_alternatives(asked: DataFrame, index: PostingIndex, k: int) -> DataFrame:
    """question_id, chunk_id, document_id, chunk_index, worth, rank of the k chunks with most places of any of the lexemes."""
    some = asked.withColumn("lexemes", F.array_distinct(F.filter("lexemes", lambda t: t != ""))).filter(F.size("lexemes") > 0)
    _, read = levels(some, index, k)
    held = read.drop("n").join(index.blocks.select(*PLACE, "lexeme", "impact", "entries.chunk_id"), [*PLACE, "lexeme", "impact"])
    pairs = held.select("question_id", F.explode("chunk_id").alias("chunk_id")).distinct()
    return _best(_weighed(pairs, some, index), k)
