"""The stages on odd rows and clashing columns: nothing crashes, columns stay, decisions take effect."""

import pytest

import corpus_pipeline
from proofloom.llm import mixing
from proofloom.llm.common import cut

DATA = "/root/testdata/sf0.001"
EXTRA = {"size": 1, "at": "x", "words": 2.0, "copy": 3, "pass": 4, "quality_score": "mine", "label": 5, "fp": 6, "block": "b", "kept": "k"}


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    more = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", None, 0), (900002, "x " * 60000, "en", "src1", 120000), (900003, "a b c", None, "src1", 5), (900003, "a b c", None, "src1", 5)], docs.schema)
    from pyspark.sql import functions as F

    return docs.unionByName(more).withColumns({k: F.lit(v) for k, v in EXTRA.items()})


def test_stages_keep_columns_and_survive(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = cut(stage(spark, docs, DATA))
        assert out.columns == odd.columns, name
        first = out.first()
        assert first is not None and all(first[k] == v for k, v in EXTRA.items())
        docs = out
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert coded.count() == docs.count()


def test_near_copies_leave_one(spark, odd):
    out = corpus_pipeline.drop_near_copies(spark, odd, DATA)
    rows = out.filter("doc_id = 900003").count()
    assert rows == 1


def test_empty_input(spark, odd):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd.limit(0), DATA).count() == 0


def test_rows_that_differ_in_one_column_or_a_null(spark):
    """Rows equal but for an extra column, and rows whose nulls stand elsewhere, are rows of their own."""
    rows = [(1, "alpha beta", "s", "x"), (1, "alpha beta", "s", "y"), (1, "alpha beta", "s", None), (None, "alpha beta", None, "z"), (None, None, "alpha beta", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    got = mixing.curriculum(docs, budget=1.0, cap=1).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rows[:4], key=repr)
