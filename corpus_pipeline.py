"""From raw documents to training tokens: five stages, each a table written from the one before.

A stage is a function of (spark, docs, sf_dir). Its result is written as Parquet in the shared folder and
read again as the next stage's docs, so a lost executor costs at most one stage's unfinished tasks. All
but the last return the columns of ``documents``, extra ones too.

Defined results of odd rows: a null or empty text is a document like any other until ``mix_sources``, which has
no words to take from it; a null id is larger than all others, so of copies the one with an id stays; of rows
that repeat in full one stays (``drop_near_copies``); a null source is a source of its own; a very long text is
never cut but by what it shares or by its source's target. An empty table gives an empty table in every stage.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.llm import bpe, mixing, near_copies, quality, suffixes
from proofloom.llm.common import cut, discard, read_table, scratch
from proofloom.llm.registry import TOKENIZER

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def step(stage: Stage) -> Stage:
    """A stage whose intermediate tables go when the next one begins, for its result is stored by then."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark, "pipeline"):
            return stage(spark, docs, sf_dir)

    return run


@step
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labels of this stage's input. Copies score alike."""
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, "__quality", "__passage")
    return scored.filter(F.col("__quality") >= quality.GOOD).select(*docs.columns)


@step
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that share 0.8 of their five-word shingles with one of a smaller id; ties fall to the smaller id.

    Candidates are what the vantage-point search over SimHash fingerprints links, as in op9, and what shares a shard of shingles.
    """
    return near_copies.deduplicate(docs)


@step
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings that a document with a smaller id has too."""
    return suffixes.deduplicate(docs)


@step
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or shortened to their source's target, in training order; those of no words go."""
    return mixing.curriculum(docs)


@step
def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every text."""
    return bpe.encode_decode(docs, TOKENIZER).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("quality", keep_good),
    ("simhash", drop_near_copies),
    ("suffixes", cut_repeats),
    ("mixing", mix_sources),
    ("bpe", tokenize),
]
#: Trained scores and byte-level suffix matching have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stored = read_table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
        if stored is not None:
            discard(stored)
        stored = docs
    return STAGES[-1][1](spark, docs, sf_dir)
