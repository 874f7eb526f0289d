"""Queries of full-text search by lexeme. The SQL stems words itself, so both sides of each comparison have rules of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import lexical as lx
from proofloom.functions import stems
from proofloom.functions.text import normalize_text
from proofloom.operators import blocks, postings, set_join
from proofloom.plans.corpus_queries import admissible
from proofloom.plans.declare import query
from proofloom.plans.search_queries import index
from proofloom.plans.stem_sql import english
from proofloom.plans.views import EN, REFERENCE_DATE, WORD, normal
from proofloom.sources import tables
from proofloom.sources.stored import once, stored_once

K = 8

_LEXED = f"""said AS (SELECT conv_id * 10000 + turn AS question_id, 'i' || (conv_id % 2) AS institution_id, {normal('text')} AS query FROM conversations WHERE role = 'user'
    UNION ALL SELECT -1 - question_id, institution_id, query FROM questions),
  ew AS (SELECT chunk_id, document_id, chunk_index, institution_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place
    FROM (SELECT *, regexp_extract_all({normal('content')}, {WORD}) AS ws FROM elig)),
  qw AS (SELECT question_id, institution_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (SELECT *, list_slice(list_filter(raw, lambda t, i: NOT (length(t) = 1 AND regexp_full_match(t, '\\p{{L}}'))
    AND NOT list_contains({EN}, t) AND t <> 'or' AND list_position(raw, t) = i), 1, 12) AS ws FROM (SELECT *, regexp_extract_all(query, {WORD}) AS raw FROM said))),
  lx AS ({english("SELECT word FROM ew UNION ALL SELECT word FROM qw")}),
  e AS (SELECT chunk_id, document_id, chunk_index, institution_id, list(CASE WHEN list_contains({EN}, word) THEN '' ELSE lexeme END ORDER BY place) AS words FROM ew JOIN lx USING (word) GROUP BY ALL),
  q AS (SELECT question_id, institution_id, list(lexeme ORDER BY place) AS t FROM qw JOIN lx USING (word) GROUP BY ALL),
  pairs AS (SELECT q.question_id, t, e.chunk_id, e.document_id, e.chunk_index, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM q JOIN e USING (institution_id))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of users: the user turns of all conversations and the benchmark passages (negative ids), asked in English."""
    own = tables.scan(spark, sf_dir, "conversations").filter("role = 'user'")
    said = own.select((F.col("conv_id") * 10000 + F.col("turn")).alias("question_id"), F.concat(F.lit("i"), (F.col("conv_id") % 2).cast("string")).alias("institution_id"), normalize_text(F.col("text")).alias("query"))
    passages = tables.questions(spark, sf_dir).select((-1 - F.col("question_id")).alias("question_id"), "institution_id", "query")
    rows = said.unionByName(passages).withColumn("language", F.lit("en"))
    return rows.withColumn("terms", lx.informative_terms(F.col("query"), F.col("language"))).filter(F.size("terms") > 0)


def lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the lexemes of the admissible chunks, stored."""

    def make() -> DataFrame:
        valid = F.coalesce(F.col("valid_from") <= REFERENCE_DATE, F.lit(True)) & F.coalesce(F.col("valid_until") >= REFERENCE_DATE, F.lit(True))
        docs = tables.documents(spark, sf_dir).filter(F.col("is_active") & (F.col("language") == "en") & valid)
        n_bytes = docs.groupBy("institution_id").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0]
        chunks = admissible(spark, sf_dir).select(F.col("chunk_institution").alias("institution_id"), F.col("chunk_language").alias("language"), *blocks.IDS, "content")
        return blocks.build(chunks, n_bytes)

    return once(spark, sf_dir, "lexed", make)


@query(f"WITH {_LEXED} SELECT word, lexeme FROM lx")
def lexeme_table(spark, sf_dir):
    """Every word of the admissible chunks and the questions with its stem."""
    words = index(spark, sf_dir).select(F.explode("words").alias("word")).unionByName(turns(spark, sf_dir).select(F.explode("terms").alias("word"))).distinct()
    return words.select("word", stems.stem("word", F.lit("english")).alias("lexeme"))


def _found(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """How many admissible chunks match, by lexemes, a query made from each question's terms."""
    asked = stored_once(spark, sf_dir, "turns", lambda: turns(spark, sf_dir))
    variants = asked.filter(F.size("terms") >= 2).withColumn("input", text)
    return blocks.match_counts(variants, lexed(spark, sf_dir))


def _twin(condition: str) -> str:
    return f"WITH {_LEXED} SELECT question_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM pairs WHERE len(t) >= 2 AND {condition} GROUP BY question_id"


@query(_twin("list_has_all(words, t[1:3])"))
def stemmed_match_and(spark, sf_dir):
    return _found(spark, sf_dir, F.array_join(F.slice("terms", 1, 3), " "))


@query(_twin("list_has_any(words, t)"))
def stemmed_match_or(spark, sf_dir):
    return _found(spark, sf_dir, F.array_join("terms", " OR "))


@query(_twin("contains(line, ' ' || t[1] || ' ' || t[2] || ' ')"))
def stemmed_match_phrase(spark, sf_dir):
    return _found(spark, sf_dir, F.concat(F.lit('"'), F.array_join(F.slice("terms", 1, 2), " "), F.lit('"')))


@query(_twin("list_contains(words, t[1]) AND NOT list_contains(words, t[2])"))
def stemmed_match_not(spark, sf_dir):
    return _found(spark, sf_dir, F.concat(F.element_at("terms", 1), F.lit(" -"), F.element_at("terms", 2)))


@query(f"""WITH {_LEXED}, s AS (SELECT question_id, chunk_id, document_id, chunk_index, len(list_filter(words, lambda w: list_contains(t, w)))::INTEGER AS worth FROM pairs)
  SELECT question_id, chunk_id, worth, row_number() OVER (PARTITION BY question_id ORDER BY worth DESC, document_id, chunk_index, chunk_id) AS rank FROM s WHERE worth > 0 QUALIFY rank <= {K}""")
def stemmed_top_alternatives(spark, sf_dir):
    """The chunks with most places of each question's lexemes."""
    asked = stored_once(spark, sf_dir, "turns", lambda: turns(spark, sf_dir))
    words = asked.select("question_id", "institution_id", "language", F.col("terms").alias("lexemes"))
    found = blocks.top_alternatives(postings.with_lexemes(words, "lexemes"), lexed(spark, sf_dir), K)
    return found.select("question_id", "chunk_id", "worth", F.col("rank").cast("long").alias("rank"))


#: The bundled questions are invented words, so those that are alike at all are so by little.
LEAK = 0.15


@query(f"""WITH {_LEXED}, w AS (SELECT question_id, CASE WHEN (question_id // 10000) % 3 = 0 THEN 'HELD_OUT' ELSE 'DEV' END AS split, list_sort(list_distinct(regexp_extract_all(query, {WORD}))) AS w FROM said WHERE query <> ''),
  c AS (SELECT w, min(question_id) AS class, count(*) AS n, bool_or(split = 'DEV') AS dev, bool_or(split = 'HELD_OUT') AS held FROM w GROUP BY w),
  p AS (SELECT a.class AS class_a, b.class AS class_b, round(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))), 9) AS jaccard, a.n AS n_a, b.n AS n_b
    FROM c a JOIN c b ON a.class < b.class AND ((a.dev AND b.held) OR (a.held AND b.dev)))
  SELECT * FROM p WHERE jaccard >= {LEAK} UNION ALL SELECT class, class, 1.0::DOUBLE, n, n FROM c WHERE dev AND held""")
def leaking_questions(spark, sf_dir):
    """Questions of users and passages that stand in both splits, or nearly so: every third conversation is held out."""
    own = tables.scan(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 10000 + F.col("turn")).alias("question_id"), normalize_text(F.coalesce("text", F.lit(""))).alias("query"))
    passages = tables.questions(spark, sf_dir).select((-1 - F.col("question_id")).alias("question_id"), "query")
    rows = own.unionByName(passages).filter("query <> ''")
    split = F.when(F.expr("(question_id div 10000) % 3") == 0, "HELD_OUT").otherwise("DEV")
    words = F.regexp_extract_all("query", F.lit(r"(?U)([^\W_]+)"), F.lit(1))
    found = set_join.leaks(rows.select("question_id", split.alias("split"), words.alias("words")), LEAK)
    return found.withColumn("jaccard", F.round("jaccard", 9))
