"""Queries of full-text analysis, guards over evaluation data, diagnoses and human handoff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proofloom.functions import stems
from proofloom.functions.text import normalize_text
from proofloom.operators import answering, contracts, diagnostics, metrics, retrieval
from proofloom.plans.declare import query
from proofloom.plans.measure_queries import _DECIDED, _SIGNALS, LISTS, _fact_sql, _facts, presence, signals
from proofloom.plans.search_queries import _TF_RANK, TOP_K, asked, decided, index, search_chunks
from proofloom.plans import stem_sql
from proofloom.plans.views import EN, WORD, normal
from proofloom.sources import tables


@query(f"""WITH w AS (SELECT document_id, chunk_index, ws, unnest(ws) AS lexeme, generate_subscripts(ws, 1) AS place FROM (
    SELECT doc_id AS document_id, chunk_index, regexp_extract_all({normal('line')}, {WORD}) AS ws FROM linesof WHERE lang <> 'en'))
  SELECT document_id, chunk_index, lexeme, array_to_string(list(place ORDER BY place), ' ') AS positions FROM w GROUP BY ALL""")
def postings_simple(spark, sf_dir):
    """Lexemes with positions of the languages without a configuration of their own."""
    lines = tables.lines(spark, sf_dir).join(tables.documents(spark, sf_dir).filter("language <> 'en'").select("document_id", "language"), "document_id")
    keyed = lines.select(F.struct("document_id", "chunk_index").alias("chunk_id"), "language", normalize_text(F.col("content")).alias("normalized"))
    rows = stems.postings(keyed)
    return rows.select("chunk_id.document_id", F.col("chunk_id.chunk_index").cast("long").alias("chunk_index"), "lexeme", F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions"))


@query(f"""WITH w AS (SELECT chunk_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (SELECT chunk_id, regexp_extract_all({normal('content')}, {WORD}) AS ws FROM elig)),
  lx AS ({stem_sql.english('SELECT word FROM w')}) SELECT chunk_id, lexeme, list(place::INTEGER ORDER BY place) AS positions FROM w JOIN lx USING (word) WHERE NOT list_contains({EN}, word) GROUP BY ALL""")
def postings(spark, sf_dir):
    """Stemmed lexemes with positions of the admissible chunks."""
    return stems.postings(search_chunks(spark, sf_dir))


@query(f"""WITH {_TF_RANK} SELECT question_id, chunk_id, round(density, 9) AS density FROM dens""")
def cover_density(spark, sf_dir):
    """Cover density of every question in every admissible chunk that holds all its terms."""
    questions = asked(spark, sf_dir)
    held = index(spark, sf_dir)
    found = retrieval.cover_worth(retrieval.places_of_terms(retrieval.joint_pairs(questions, held), questions, held), questions)
    return found.select("question_id", "chunk_id", F.round("raw_score", 9).alias("density"))


@query(f"""WITH {_DECIDED}, r AS (SELECT question_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC,
    document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank FROM decided WHERE status = 'kept')
  SELECT a.question_id, a.chunk_id AS target, a.rank AS target_rank, b.chunk_id AS item, b.rank, round(b.score - a.score, 5) AS gap FROM r a JOIN r b ON a.question_id = b.question_id AND b.rank < a.rank""")
def ranking_competitors(spark, sf_dir):
    """Every returned chunk beside each that ranks above it."""
    rows = retrieval.ranked(decided(spark, sf_dir), 100).withColumn("item", F.col("chunk_id"))
    out = metrics.competitors(rows, rows.select("question_id", "item"))
    return out.select("question_id", "target", F.col("target_rank").cast("long"), "item", F.col("rank").cast("long"), F.round(F.round("score", 6) - F.round("target_score", 6), 5).alias("gap"))


@query(f"""WITH {LISTS}, {_SIGNALS} SELECT question_id, round(top1, 6) AS top1, round((SELECT min(o.top1) FROM sig o WHERE o.question_id <> sig.question_id), 6) AS min_other,
  round((SELECT max(o.top1) FROM sig o WHERE o.question_id <> sig.question_id), 6) AS max_other FROM sig""")
def similarity_separation(spark, sf_dir):
    return contracts.separation(signals(spark, sf_dir)).select("question_id", *(F.round(c, 6).alias(c) for c in ("top1", "min_other", "max_other")))


@query("""SELECT attribute, value, count(*) AS n_questions FROM (SELECT unnest(['institution_id', 'language', 'n_words']) AS attribute,
  unnest([institution_id, language, len(string_split(query, ' '))::VARCHAR]) AS value FROM questions) GROUP BY ALL""")
def protocol_distribution(spark, sf_dir):
    rows = tables.questions(spark, sf_dir).withColumn("n_words", F.size(F.split("query", " ")))
    return contracts.distribution(rows, ["institution_id", "language", "n_words"])


@query("SELECT count(*) AS n_scenarios, min(n) AS min_questions, max(n) AS max_questions FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def scenario_bounds(spark, sf_dir):
    return contracts.per_scenario_bounds(tables.scan(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "scenario_id"))


@query("""SELECT source, 'lang' AS attribute FROM documents GROUP BY source HAVING count(DISTINCT coalesce(lang, '␀')) > 1""")
def inconsistent_sources(spark, sf_dir):
    """Sources whose documents disagree on the language."""
    return contracts.inconsistent_groups(tables.scan(spark, sf_dir, "documents"), ["source"], ["lang"])


@query("SELECT question_id FROM questions WHERE false")
def null_controls(spark, sf_dir):
    """Questions whose candidates differ between two runs of the same plan: none."""
    runs = [decided(spark, sf_dir).groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total")) for _ in range(2)]
    return contracts.null_controls(*runs, ["question_id"], ["n", "total"])


@query(f"""WITH {_fact_sql()}, n AS (SELECT document_id, question_id, count(DISTINCT fact) AS n_facts FROM pres GROUP BY ALL)
  SELECT question_id, max(n_facts) AS most_facts, count(*) AS n_documents FROM n GROUP BY question_id""")
def facts_per_document(spark, sf_dir):
    per = presence(spark, sf_dir).groupBy("question_id", "document_id").agg(F.count_distinct("fact").alias("n_facts"))
    return per.groupBy("question_id").agg(F.max("n_facts").alias("most_facts"), F.count(F.lit(1)).alias("n_documents"))


@query(f"""WITH {_fact_sql()}, a AS (SELECT question_id, document_id, fact, chunk_index FROM pres)
  SELECT x.question_id, x.document_id, min(abs(x.chunk_index - y.chunk_index)) AS lines_apart FROM a x JOIN a y ON x.question_id = y.question_id AND x.document_id = y.document_id AND x.fact = 'F1' AND y.fact = 'F2' GROUP BY ALL""")
def fact_proximity(spark, sf_dir):
    """How many lines apart the two facts of a question come in each document that has both."""
    rows = presence(spark, sf_dir)
    x = rows.filter("fact = 'F1'").select("question_id", "document_id", F.col("chunk_index").alias("a"))
    y = rows.filter("fact = 'F2'").select("question_id", "document_id", F.col("chunk_index").alias("b"))
    return x.join(y, ["question_id", "document_id"]).groupBy("question_id", "document_id").agg(F.min(F.abs(F.col("a") - F.col("b"))).cast("long").alias("lines_apart"))


@query(f"""WITH {_fact_sql()}, jf AS (SELECT f.question_id, f.fact, f.needle, j.document_id FROM f JOIN judgments j USING (question_id)),
  w AS (SELECT document_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS position FROM dwords WHERE document_id IN (SELECT document_id FROM jf)),
  p AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY document_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lead(word) OVER (PARTITION BY document_id ORDER BY position) AS after FROM w),
  o AS (SELECT jf.question_id, jf.document_id, fact, start, length(needle) AS length FROM jf JOIN p ON p.document_id = jf.document_id AND word || ' ' || after = needle QUALIFY row_number() OVER (PARTITION BY jf.question_id, jf.document_id, fact ORDER BY start) <= 8),
  d AS (SELECT a.question_id, a.document_id, a.fact AS fact_a, b.fact AS fact_b, min(greatest(0, b.start - a.start - a.length, a.start - b.start - b.length))::BIGINT AS distance FROM o a JOIN o b ON a.question_id = b.question_id AND a.document_id = b.document_id AND a.fact < b.fact GROUP BY ALL)
  SELECT *, distance > 300 AS apart FROM d""")
def fact_distances(spark, sf_dir):
    """How many characters apart the facts of a question come in the documents that are judged for it."""
    docs = tables.documents(spark, sf_dir).select("document_id", normalize_text(F.col("text")).alias("normalized"))
    facts = _facts(spark, sf_dir).join(tables.judgments(spark, sf_dir), "question_id").select("question_id", "fact", "needle", "document_id")
    return diagnostics.nearest_pairs(diagnostics.occurrences(facts, docs)).withColumn("distance", F.col("distance").cast("long"))


@query(f"""WITH {_DECIDED}, k AS (SELECT DISTINCT question_id, document_id FROM decided WHERE status = 'kept'),
  r AS (SELECT DISTINCT question_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC, document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank
    FROM decided WHERE status = 'kept') WHERE rank <= 5)
  SELECT conclusion, count(*) AS n_targets FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.question_id = j.question_id AND r.document_id = j.document_id) THEN 'evidence_returned'
    WHEN NOT EXISTS (SELECT 1 FROM elig e JOIN questions q ON q.institution_id = e.institution_id WHERE q.question_id = j.question_id AND e.document_id = j.document_id) THEN 'not_admissible'
    WHEN NOT EXISTS (SELECT 1 FROM decided d WHERE d.question_id = j.question_id AND d.document_id = j.document_id) THEN 'not_retrieved'
    WHEN NOT EXISTS (SELECT 1 FROM k WHERE k.question_id = j.question_id AND k.document_id = j.document_id) THEN 'excluded_by_ranking' ELSE 'outside_top_k' END AS conclusion FROM judgments j) GROUP BY conclusion""")
def failure_conclusions(spark, sf_dir):
    """Where each relevant document of a question was lost, counted."""
    rows = decided(spark, sf_dir)
    keys = ["question_id", "document_id"]
    there = lambda df, name: df.select(*keys).distinct().withColumn(name, F.lit(True))
    owners = tables.questions(spark, sf_dir).select("question_id", "institution_id")
    open_to = search_chunks(spark, sf_dir).select("institution_id", "document_id").distinct().join(owners, "institution_id")
    targets = tables.judgments(spark, sf_dir).select(*keys)
    for name, df in (("admissible", open_to), ("candidate", rows), ("kept", rows.filter("status = 'kept'")), ("returned", retrieval.ranked(rows, TOP_K))):
        targets = targets.join(there(df, name), keys, "left").fillna(False, [name])
    return diagnostics.conclude(targets.withColumns({"extracted": F.lit(True), "chunked": F.lit(True)})).groupBy("conclusion").agg(F.count(F.lit(1)).alias("n_targets"))


@query("""SELECT conv_id AS conversation_id, 's' || (conv_id % 3) AS institution_id, CASE conv_id % 3 WHEN 0 THEN 'escalated' WHEN 1 THEN 'escalated' ELSE 'no_destination' END AS status,
  CASE conv_id % 3 WHEN 0 THEN 'Help desk' || chr(10) || 'help@example.org' WHEN 1 THEN 'Office' || chr(10) || 'https://example.org/office' END AS message, '{"action":"ESCALATE"}' AS metadata
  FROM (SELECT DISTINCT conv_id FROM conversations)""")
def human_handoff(spark, sf_dir):
    conversations = tables.scan(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation_id"), F.concat(F.lit("s"), (F.col("conv_id") % 3).cast("string")).alias("institution_id")).distinct()
    contacts = spark.createDataFrame(
        [("s0", "Help desk", "help@example.org", None), ("s1", "Office", None, "https://example.org/office"), ("s2", "Nobody", None, None)], "institution_id string, support_name string, support_email string, support_url string"
    )
    return answering.handoff(conversations, contacts)
