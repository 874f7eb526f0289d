"""Stems, streamed ingest, SQL names and guards."""

import pytest
from pyspark.sql import functions as F

from proofloom.functions.register import register
from proofloom.functions.stems import accent_map, cover_density, english, portuguese, postings, project_terms
from proofloom.operators import contracts
from proofloom.streaming.ingest import ingest, read_documents

ENGLISH = {
    "running": "run", "caresses": "caress", "ponies": "poni", "cats": "cat", "hopping": "hop", "hoping": "hope", "generalization": "general", "relational": "relat", "conditional": "condit",
    "happily": "happili", "agreed": "agre", "national": "nation", "registration": "registr", "deadlines": "deadlin", "consistency": "consist", "skies": "sky", "news": "news",
}


@pytest.mark.parametrize(("word", "stem"), ENGLISH.items())
def test_english(word, stem):
    assert english(word) == stem


def test_portuguese_forms_meet():
    for a, b in (("bibliotecas", "biblioteca"), ("exames", "exame"), ("matricula", "matriculas")):
        assert portuguese(a) == portuguese(b)


def test_cover_density():
    assert cover_density([[1], [2]]) == pytest.approx(0.1)
    assert cover_density([[1], [5]]) == pytest.approx(0.1 / 4)
    assert cover_density([[1, 5], [3]]) == pytest.approx(0.1)
    assert cover_density([[1], []]) == 0.0 == cover_density([])


def test_postings(spark):
    rows = spark.createDataFrame([(1, "the running dogs run", "en"), (2, "die hunde", "de")], "chunk_id long, normalized string, language string")
    assert {(r["chunk_id"], r["lexeme"], tuple(r["positions"])) for r in postings(rows).collect()} == {(1, "run", (2, 4)), (1, "dog", (3,)), (2, "die", (1,)), (2, "hunde", (2,))}


def test_term_projection(spark):
    words = spark.createDataFrame([("ate", "até", 4), ("ate", "atè", 9), ("x", "x", 1)], "plain string, word string, position int")
    found = accent_map(words)
    rows = spark.createDataFrame([(1, ["ate", "ord:1", "zz"]), (2, [])], "id int, terms array<string>")
    got = {r["id"]: r["terms"] for r in project_terms(rows, "terms", found, "plain", "accented").collect()}
    assert got == {1: ["até", "ord:1", "zz"], 2: []}


def test_sql_names(spark):
    register(spark)
    assert spark.sql("SELECT normalize_text('Ünï  X')").first()[0] == "uni x"
    assert spark.sql("SELECT stem('running', 'english')").first()[0] == "run"
    assert spark.sql("SELECT lexical_words('A b-c')").first()[0] == ["a", "b", "c"]


def test_stream_and_its_restart(spark, tmp_path):
    schema = "document_id long, text string"
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    spark.createDataFrame([(1, "first text"), (2, " "), (1, "first text")], schema).coalesce(1).write.parquet(source)
    ingest(read_documents(spark, source, schema), out, checkpoint).awaitTermination()
    spark.createDataFrame([(3, "third text")], schema).coalesce(1).write.mode("append").parquet(source)
    ingest(read_documents(spark, source, schema), out, checkpoint).awaitTermination()
    assert sorted(r["document_id"] for r in spark.read.parquet(f"{out}/chunks").collect()) == [1, 3]
    assert [r["document_id"] for r in spark.read.parquet(f"{out}/rejected").collect()] == [2]


def test_guards(spark):
    cases = spark.createDataFrame([(1, ["E1", "E2"]), (2, ["E1", "E3"]), (3, [])], "case_id int, ids array<string>")
    assert [r["case_id"] for r in contracts.contiguous_ids(cases, "case_id", "ids", "E").collect()] == [2]
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "ref string, version int")
    assert [tuple(r) for r in contracts.inconsistent_groups(rows, ["ref"], ["version"]).collect()] == [("a", "version")]
    assert [r["version"] for r in contracts.uncovered([1, 2, 3], rows, "version").collect()] == [3]
    signals = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.5)], "question_id int, top1 double")
    got = {r["question_id"]: (r["min_other"], r["max_other"]) for r in contracts.separation(signals).collect()}
    assert got == {1: (0.5, 0.9), 2: (0.2, 0.5), 3: (0.2, 0.9)}
    a = spark.createDataFrame([(1, 0.5)], "question_id int, score double")
    assert contracts.null_controls(a, a, ["question_id"], ["score"]).count() == 0
    assert contracts.null_controls(a, a.withColumn("score", F.lit(0.6)), ["question_id"], ["score"]).count() == 1
    matrix = spark.createDataFrame([("s1", "c1", "known")], "scenario string, check string, class string")
    results = spark.createDataFrame([("s1", "c1", False), ("s1", "c2", False), ("s2", "c1", True)], "scenario string, check string, passed boolean")
    assert {(r["check"], r["class"]) for r in contracts.expected_failures(results, matrix).collect()} == {("c1", "known"), ("c2", "unexplained")}


def test_bootstrap_keeps_scenarios_in_parts(spark):
    from proofloom.operators import statistics

    rows = spark.createDataFrame([(s, float(s % 5)) for s in range(400)], "scenario_id int, value double")
    whole, parts = (statistics.cluster_bootstrap(rows, "value", replicates=2000, part_rows=n) for n in (400, 30))
    for frame in (whole, parts):
        got = frame.first()
        assert (got["n_scenarios"], got["observed"]) == (400, 2.0)
        assert abs(got["low"] - (2 - 1.96 * (2 / 400) ** 0.5)) < 0.02 and abs(got["high"] - (2 + 1.96 * (2 / 400) ** 0.5)) < 0.02
    assert parts.first() == parts.first()
    assert statistics.cluster_bootstrap(rows.limit(0), "value", replicates=10).first()["low"] is None
