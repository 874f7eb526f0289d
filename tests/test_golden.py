"""Unit cases with known results for functions and operators that SQL can't restate."""

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from proofloom.functions import lexical as lx
from proofloom.functions import text as tx
from proofloom.operators import admissibility, answering, chunking, dense, diagnostics, digests, fusion, metrics, retrieval, statistics
from proofloom.schemas import chunk_checks, source_checks, violations
from proofloom.sources import files, json_files
from proofloom.sources.ocr_lines import Word, page_lines, reconstruct


def canon(spark, text, language):
    df = spark.createDataFrame([(text, language)], "t string, l string")
    return [r["canonical"] for r in df.select(lx.tokens(F.col("t"), F.col("l")).alias("x")).first()["x"]]


@pytest.mark.parametrize(
    ("text", "language", "want"),
    [
        ("1.a chamada", "pt", ["ord:1", "chamada"]),
        ("primeira chamada", "pt", ["ord:1", "chamada"]),
        ("01a12", "pt", ["rng:1-12"]),
        ("01 a 12", "pt-BR", ["rng:1-12"]),
        ("12–01", "de", ["rng:1-12"]),
        ("2025/2026", "pt", ["2025", "2026"]),
        ("sala12", "pt", ["sala12"]),
        ("the 3rd and tenth", "en", ["the", "ord:3", "and", "ord:10"]),
        ("first", "fr", ["first"]),
        ("", "en", []),
    ],
)
def test_tokens(spark, text, language, want):
    assert canon(spark, text, language) == want


def plan(spark, text, language):
    df = spark.createDataFrame([(text, language)], "t string, l string")
    return [(v["strategy"], v["input"]) for v in df.select(lx.plan_variants(F.col("t"), F.col("l")).alias("p")).first()["p"]]


def test_plans(spark):
    assert plan(spark, "exames da primeira chamada", "pt") == [
        ("exact", "exames da primeira chamada"), ("reduced_and", "exames primeira chamada"), ("canonical_relaxed_and", "exames chamada"), ("reduced_or", "exames OR primeira OR chamada"),
    ]
    assert plan(spark, "de que", "pt") == []
    assert plan(spark, "1a 2a", "pt") == [("exact", "1a 2a")]
    assert plan(spark, '"two words" here', "en") == [("exact", '"two words" here')]
    assert plan(spark, "etwas wissen", "de") == [("exact", "etwas wissen")]
    assert plan(spark, "classes or exams", "en") == [("exact", "classes or exams")]


@pytest.mark.parametrize("text", ["onor or. rooms", "ing or, rooms", "rooms (or halls)", "or: rooms"])
def test_joining_word_beside_marks_is_syntax(spark, text):
    """As in the SQL of the plans, which looks for the word and not for a blank on each side of it."""
    assert plan(spark, text, "en") == [("exact", text)]


def test_words_that_begin_like_the_joining_word_are_plain(spark):
    assert [v[0] for v in plan(spark, "orange floor", "en")] == ["exact", "reduced_or"]


def test_normalisation(spark):
    texts = ["Ünï  STRASSE ß", "ﬁn ½ Ⅳ", "ΑΒΓ ς", "a b\tc d", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(tx.normalize_text(F.col("t"))).collect()] == [t if t is None else tx.normalize(t) for t in texts]


@pytest.mark.parametrize(
    ("query", "text", "want"),
    [
        ("a b", "b x a", True), ("a b", "a", False), ("a or b", "b", True), ('"a b"', "a b c", True), ('"a b"', "b a", False), ("a -b", "a c", True), ("a -b", "a b", False),
        ("a or b c", "b c", True), ("a or b c", "a", False), ('-"a b" c', "c b a", True),
    ],
)
def test_websearch(spark, query, text, want):
    df = spark.createDataFrame([(query, text.split())], "q string, w array<string>")
    assert df.select(retrieval.matches(F.col("w"), retrieval.parse_websearch(F.col("q")))).first()[0] is want


def test_content_match(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["x", "a", "b", "y", "c"], [0, 1, 2, 3, 4], ["x", "a", "b", "y", "c"])], "t array<string>, k array<string>, p array<int>, s array<string>")
    got = df.select(*(c.alias(n) for n, c in retrieval.content_match(F.col("t"), F.col("k"), F.col("p"), F.col("s")).items())).first()
    assert (got["coverage"], got["exact_phrase"], got["ordered"]) == (1.0, 0.0, 1.0)
    assert got["compactness"] == pytest.approx(3 / 4) and got["proximity"] == pytest.approx(3 / 4)


def chunked(spark, texts, **settings):
    """Sorted (start, end, page, section, kind, strategy) by document, from the Column version; contents and indexes checked."""
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string")
    found = {k: [] for k in range(len(texts))}
    for r in chunking.chunk_documents(df, **settings).orderBy("document_id", "chunk_index").collect():
        assert r["content"] == texts[r["document_id"]][r["start_char"] : r["end_char"]]
        assert r["chunk_index"] == len(found[r["document_id"]])
        found[r["document_id"]].append((r["start_char"], r["end_char"], r["page_number"], r["section_title"], r["structure_type"], r["chunking_strategy"]))
    return found


def test_chunks_of_a_structured_text(spark):
    text = "# Title\n\nFirst line\nsecond line\n\n- one\n- two\n\n- three\na | b\n\fNEXT PAGE\nbody text here."
    got = chunked(spark, [text])[0]
    assert [(text[a:b], page, section, kind) for a, b, page, section, kind, _ in got] == [
        ("# Title", 1, "# Title", "heading"), ("First line\nsecond line", 1, "# Title", "paragraph"), ("- one\n- two", 1, "# Title", "list_block"), ("- three", 1, "# Title", "list_item"),
        ("a | b", 1, "# Title", "table_row"), ("NEXT PAGE", 2, "NEXT PAGE", "heading"), ("body text here.", 2, "NEXT PAGE", "paragraph"),
    ]


def test_long_pieces_are_cut_with_overlap(spark):
    texts = ["word " * 700, "x" * 3000, "line one\r\nline two\r" * 200]
    for text, got in zip(texts, chunked(spark, texts).values()):
        assert all(b - a <= 1200 for a, b, *_ in got)
        assert got[0][0] == 0 and got[-1][1] == len(text.rstrip())
        assert all(n[0] < p[1] and n[0] > p[0] for p, n in zip(got, got[1:]))
        assert {g[5] for g in got} == {"character_fallback_v1"}


@pytest.mark.parametrize(("size", "overlap"), [(1200, 150), (90, 10), (50, 0)])
def test_chunks_equal_the_plain_version(spark, size, overlap):
    from plain_chunker import chunk_text

    rng = random.Random(1)
    parts = ["# Head", "- item", "- two", "1) x", "a | b", "para text here", "UPPER CASE", "word " * 60, "x" * 400, "", "", " ", "\t", "  indented", "Ends:", "é\U0001f642 thing", "z" * 1500, "w " * 900, "\u2003wide"]
    ends = ["\n", "\n", "\n\n", "\r\n", "\r", "\f", " "]
    texts = ["".join(rng.choice(parts) + rng.choice(ends) for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(200)] + ["", " \n", "q " * 40_000, "# h\n" * 3000]
    got = chunked(spark, texts, size=size, overlap=overlap)
    for k, text in enumerate(texts):
        assert got[k] == chunk_text(text, size, overlap), k


def test_chunks_of_repeated_and_null_keys(spark):
    df = spark.createDataFrame([(1, "one.\n\ntwo."), (1, "one.\n\ntwo."), (None, "three"), (2, None), (3, " ")], "document_id long, text string")
    got = [(r["document_id"], r["chunk_index"], r["content"]) for r in chunking.chunk_documents(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 0, "one.\n\ntwo."), (1, 0, "one.\n\ntwo."), (None, 0, "three")], key=repr)
    assert chunking.chunk_documents(df.limit(0)).collect() == []


def test_chunk_parameters(spark):
    df = spark.createDataFrame([(1, "x")], "document_id long, text string")
    for size, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            chunking.chunk_documents(df, size=size, overlap=overlap)


def test_relational_units_match_the_plain_ones(spark):
    from plain_chunker import pieces

    text = "HEAD\npara one\npara two\n\n1) item\n  indented | row  \r\nlast\fpage two"
    df = spark.createDataFrame([(1, text)], "document_id long, text string")
    got = sorted((r["start_char"], r["end_char"], r["structure_type"], r["section_title"]) for r in chunking.units(df).collect())
    assert got == [(p.start, p.end, p.kind, p.section) for p in pieces(text)]


def test_integrity_audit_finds_faults(spark):
    chunks = spark.createDataFrame([(1, 0, 0, 5, "hello"), (1, 1, 3, 8, "wrong"), (1, 1, 20, 19, " ")], "document_id long, chunk_index int, start_char int, end_char int, content string")
    audit = diagnostics.chunk_integrity(chunks, spark.createDataFrame([(1, "hello world")], "document_id long, text string"))
    got = diagnostics.integrity_summary(audit).first()
    assert (got["n_bad_offsets"], got["n_duplicate_index"], got["n_blank"], got["overlap_chars"], got["gap_chars"]) == (1, 2, 1, 2, 12)


def test_rrf_ties_and_depth(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "z", 6)], "question_id int, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "x", 2)], "question_id int, item string, rank int")
    got = [(r["item"], r["rank"]) for r in fusion.rrf({"a": a, "b": b}).orderBy("rank").collect()]
    assert got == [("x", 1), ("y", 2)]
    assert fusion.rrf({"a": a, "b": b}).first()["score"] == pytest.approx(1 / 61 + 1 / 62)


@pytest.mark.parametrize("grades", [[2, 0, 0], [0, 2, 0], [1, 1, 2], [0, 0, 0]])
def test_measures(spark, grades):
    ranking = spark.createDataFrame([(1, f"d{k}", k + 1) for k in range(3)], "question_id int, item string, rank int")
    known = spark.createDataFrame([(1, f"d{k}", g) for k, g in enumerate(grades)] + [(1, "missed", 2)], "question_id int, item string, grade int")
    got = metrics.per_question(ranking, known).first()
    gains = [{0: 0, 1: 1, 2: 3}[g] for g in grades]
    ideal = sorted([*gains, 3], reverse=True)
    dcg = lambda xs, k: sum(x / math.log2(i + 2) for i, x in enumerate(xs[:k]))
    n = grades.count(2) + 1
    for k in (1, 3, 5):
        assert got[f"recall_{k}"] == pytest.approx(grades[:k].count(2) / n)
        assert got[f"ndcg_{k}"] == pytest.approx(dcg(gains, k) / dcg(ideal, k))
    assert got["reciprocal_rank"] == pytest.approx(1 / (grades.index(2) + 1) if 2 in grades else 0)


def test_undefined_is_null(spark):
    ranking = spark.createDataFrame([(1, "d", 1)], "question_id int, item string, rank int")
    none = spark.createDataFrame([(1, "d", 0)], "question_id int, item string, grade int")
    got = metrics.per_question(ranking, none).first()
    assert got["recall_5"] is None and got["ndcg_5"] is None


def test_budget_redistribution(spark):
    rows = spark.createDataFrame([(1, 0, 3, 2), (1, 1, 3, 50), (1, 2, 3, 50)], "question_id int, turn int, n_variants int, available int")
    got = {r["turn"]: (r["current_quota"], r["redistribute_unused"], r["global_limited_pool"]) for r in metrics.budget_policies(rows, 20).collect()}
    assert got == {0: (2, 2, 2), 1: (7, 9, 18), 2: (6, 9, 0)}


def test_abstention(spark):
    rows = spark.createDataFrame([(1, 0.7, 0.1, "ANSWERABLE", True), (2, 0.5, None, "NO_EVIDENCE", False), (3, None, None, "NO_EVIDENCE", False)], "question_id int, top1 double, margin double, label string, solved boolean")
    got = {r["policy_id"]: r for r in statistics.admission_metrics(rows, statistics.policy_grid(spark)).collect()}
    assert len(got) == 21
    assert (got[0]["n_admitted"], got[5]["n_admitted"], got[6]["n_admitted"]) == (2, 1, 1)
    assert got[5]["correct_abstention"] == 1.0 and got[5]["false_abstention"] == 0.0
    assert statistics.select_policy(statistics.admission_metrics(rows, statistics.policy_grid(spark))).first()["correct_abstention"] == 1.0


def test_bootstrap_is_reproducible(spark):
    rows = spark.createDataFrame([(s, float(s % 5)) for s in range(40)], "scenario_id int, value double")
    a, b = (statistics.cluster_bootstrap(rows, "value", replicates=400).first() for _ in range(2))
    assert a == b and a["low"] < a["observed"] < a["high"]


def test_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, 10, "t", "x" * 900), (1, 2, 11, "t", "y" * 400), (1, 3, 12, "t", "z")], "question_id int, rank int, chunk_id long, title string, content string")
    assert [r["evidence_id"] for r in answering.pack_context(rows, 500).collect()] == ["E1"]
    assert [r["evidence_id"] for r in answering.pack_context(rows, 5000).orderBy("rank").collect()] == ["E1", "E2", "E3"]


def test_vector_digest(spark):
    got = spark.createDataFrame([([0.5, -1.0],)], "v array<float>").select(dense.vector_digest("v")).first()[0]
    assert got == hashlib.sha256(struct.pack("<2f", 0.5, -1.0)).hexdigest()


def test_nearest_breaks_ties_by_id(spark):
    rows = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "vec_id int, embedding array<float>")
    asked = spark.createDataFrame([(9, [1.0, 0.0])], "query_id int, embedding array<float>")
    assert [r["vec_id"] for r in dense.nearest(asked, rows, 2, ["vec_id"]).orderBy("rank").collect()] == [1, 2]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbfhello")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    (tmp_path / "c.pdf").write_bytes(b"no")
    nothing = spark.createDataFrame([("d.txt", 0, "", bytearray())], "filename string, size_bytes long, checksum_sha256 string, content binary")
    found = files.read_files(spark, str(tmp_path)).unionByName(nothing).withColumn("declared_type", F.lit(None).cast("string"))
    assert {r["filename"]: r["reject_reason"] for r in files.validate(found).collect()} == {"a.txt": None, "b.txt": None, "c.pdf": "not_a_pdf", "d.txt": "empty_file"}
    texts = {r["filename"]: (r["text"], r["extraction_error"]) for r in files.decode_text(found).collect()}
    assert texts["a.txt"] == ("hello", None) and texts["b.txt"] == (None, "not_utf8") and texts["d.txt"] == (None, "blank_text")


def test_document_extraction(spark):
    pages = spark.createDataFrame([(1, 1, "native", "one", 3, None), (1, 2, "ocr", "two", 3, 70.0), (2, 1, "empty", None, 0, None)], "document_id long, page_number int, method string, text string, extracted_characters int, ocr_confidence double")
    got = {r["document_id"]: r for r in files.document_extraction(files.page_quality(pages)).collect()}
    assert (got[1]["extracted_text"], got[1]["extraction_method"], got[1]["extraction_quality"]) == ("one\ftwo", "mixed", "medium")
    assert got[2]["extraction_method"] == "empty"


def test_ocr_lines(spark):
    words = [Word("Left", 0, 0, 40, 10), Word("cell", 45, 1, 40, 10), Word("right", 300, 0, 50, 10), Word("next", 0, 30, 40, 10), Word(" ", 0, 60, 5, 5)]
    assert page_lines(words) == ["Left cell | right", "next"]
    df = spark.createDataFrame([(1, 1, w.text, *map(float, w[1:])) for w in words], "document_id long, page_number int, text string, left double, top double, width double, height double")
    assert [r["line"] for r in reconstruct(df).orderBy("line_index").collect()] == ["Left cell | right", "next"]


def test_constraints(spark):
    chunks = spark.createDataFrame([(1, -1, 0, 4, "text", "paragraph"), (2, 0, 4, 4, " ", "poem")], "id int, chunk_index int, start_char int, end_char int, content string, structure_type string")
    assert sorted((r["id"], r["constraint"]) for r in violations(chunks, chunk_checks(), "id").collect()) == [
        (1, "chunk_index_not_negative"), (2, "content_not_blank"), (2, "offsets_in_order"), (2, "structure_type_known"),
    ]
    sources = spark.createDataFrame([(1, "user", "E0", "x")], "id int, message_role string, evidence_id string, content_sha256 string")
    assert violations(sources, source_checks(), "id").count() == 3


def test_json_contract(spark):
    rows = spark.createDataFrame([(1, '{"a": 1}'), (2, '{"a": 1, "b": 2}')], "id int, body string")
    assert [r["id"] for r in json_files.unknown_fields(rows, "body", ["a"]).collect()] == [2]
    assert json_files.markdown_table(["x"], [("a|b",)]) == "| x |\n| --- |\n| a\\|b |\n"


def test_digests_ignore_row_order_and_notice_changes(spark):
    docs = spark.createDataFrame([(k, f"d{k}") for k in range(50)], "document_id long, chunk_digest string")
    a, b = digests.corpus_digest(docs).first(), digests.corpus_digest(docs.orderBy(F.desc("document_id")).repartition(7)).first()
    assert a == b and a["n_documents"] == 50
    assert digests.corpus_digest(docs.withColumn("chunk_digest", F.lit("x"))).first() != a
    assert [r["problem"] for r in digests.drift(docs, docs.filter("document_id > 0"), ["document_id"], "chunk_digest").collect()] == ["missing"]


def test_language_resolution(spark):
    df = spark.createDataFrame([(" PT_br ", "en", ["en", "pt-br"]), (None, "en", ["en"]), ("xx", "en", ["en"])], "a string, f string, s array<string>")
    assert [r[0] for r in df.select(tx.resolve_language(F.col("a"), F.col("f"), F.col("s"))).collect()] == ["pt-br", "en", None]


def test_conditions_explain_what_filters(spark):
    row = {
        "chunk_institution": "a", "document_institution": "a", "version_institution": "a", "processing_status": "processed", "version_id": 1, "latest_version_id": 2, "is_active": True,
        "document_language": "en", "chunk_language": "en", "valid_from": None, "valid_until": None, "official_source": False, "chunk_id": 7,
    }
    schema = "chunk_institution string, document_institution string, version_institution string, processing_status string, version_id int, latest_version_id int, is_active boolean, document_language string, chunk_language string, valid_from date, valid_until date, official_source boolean, chunk_id int"
    rows = admissibility.within(spark.createDataFrame([row], schema), "a", "en", "2024-01-01", official_only=True)
    failed = {r["condition"] for r in admissibility.explain(rows, ["chunk_id"]).collect() if not r["satisfied"]}
    assert failed == {"version_is_highest_processed", "official_source_compatible"}
    assert admissibility.eligible(rows).count() == 0


def test_words_without_size_stay():
    words = [Word("date", 0, 0, 40, 10), Word("I", 50, 0, 0, 10), Word("-", 60, 5, 8, 0)]
    assert sorted(page_lines(words)[0].replace(" | ", " ").split()) == ["-", "I", "date"]


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [5.0] * 40 + [1.0], list(range(1000)), [1e308, -1e308, 0.0, 1e-300, 2e-300], [0.1 * k * k for k in range(5000)] + [7.0] * 3000])
def test_quantiles_by_selection(spark, values):
    rows = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(3)
    points = [0.0, 0.025, 0.5, 0.975, 1.0]
    got = statistics.quantiles(rows, "v", points).first()
    want = rows.agg(*(F.percentile("v", F.lit(q)) for q in points)).first()
    assert list(got) == pytest.approx(list(want), rel=1e-12)
    ordered = sorted(map(float, values))
    ranks = [0, len(values) // 3, len(values) - 1]
    assert statistics.order_statistics(rows, "v", ranks) == {r: ordered[r] for r in ranks}


def test_quantiles_without_values(spark):
    rows = spark.createDataFrame([(None,)], "v double")
    assert list(statistics.quantiles(rows, "v", [0.5]).first()) == [None]


def test_visible_conversations_by_equal_keys(spark):
    from proofloom.operators import rules

    users = spark.createDataFrame([(1, "a", "admin"), (2, "a", "member"), (3, "b", None), (4, "b", "admin")], "user_id long, institution_id string, role string")
    talks = spark.createDataFrame([(10, "a", 2), (11, "a", 1), (12, "b", 3), (13, "b", 2)], "conversation_id long, institution_id string, owner_id long")
    seen = rules.visible_conversations(users, talks)
    assert sorted(map(tuple, seen.collect())) == [(1, 10), (1, 11), (2, 10), (3, 12), (4, 12), (4, 13)]


def test_entry_without_the_corpus_operators(tmp_path):
    """A library that only the corpus operators need may be absent: the other queries are still there."""
    import os
    import subprocess
    import sys

    (tmp_path / "ahocorasick.py").write_text("raise ImportError('absent')")
    code = "import __spark_entry__ as e; names = set(e.queries()); print(len(names) > 100, any(n.startswith('op') and n[2].isdigit() for n in names))"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, cwd=root)
    assert out.stdout.split() == ["True", "False"], out.stderr
