"""Queries of the lexical and dense retrieval pipelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import lexical as lx
from proofloom.functions.text import normalize_text
from proofloom.operators import answering, dense, metric_index, retrieval
from proofloom.plans.corpus_queries import admissible
from proofloom.plans.declare import query
from proofloom.plans.views import EN, WORD, normal
from proofloom.sources import tables
from proofloom.sources.stored import once, stored, stored_once

TOP_K = 5


def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Admissible chunks in the shape that retrieval reads."""
    return admissible(spark, sf_dir).select(
        "chunk_id", "document_id", "chunk_index", F.col("chunk_institution").alias("institution_id"), F.col("chunk_language").alias("language"),
        "content", normalize_text(F.col("content")).alias("normalized"), "title", F.lit(None).cast("string").alias("section_title"), "structure_type",
    )


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysed chunks, stored: readers of words, places or arrays scan only those columns."""
    return stored_once(spark, sf_dir, "index", lambda: retrieval.analyze_chunks(search_chunks(spark, sf_dir)))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The analysed questions, stored."""
    return stored_once(spark, sf_dir, "asked", lambda: retrieval.analyze_questions(tables.questions(spark, sf_dir)))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decided candidates, stored: ranking, traces, measures and answers all read them."""

    def make() -> DataFrame:
        variants = stored(retrieval.planned_variants(asked(spark, sf_dir), TOP_K))
        return retrieval.candidates(asked(spark, sf_dir), variants, index(spark, sf_dir))

    return stored_once(spark, sf_dir, "decided", make)


@query("SELECT question_id, institution_id, query FROM questions")
def question_texts(spark, sf_dir):
    return tables.questions(spark, sf_dir).select("question_id", "institution_id", "query")


@query("SELECT question_id, array_to_string(informative, ' ') AS terms FROM qterms")
def informative_terms(spark, sf_dir):
    return tables.question_terms(spark, sf_dir).select("question_id", F.array_join("terms", " ").alias("terms"))


_PLAN = f"""p AS (SELECT question_id, query, informative, raw, list_contains(raw, 'or') AS advanced FROM qterms),
  v AS (SELECT question_id, 0 AS turn, 'exact' AS strategy, 4 AS priority, query AS input FROM p WHERE advanced OR len(informative) > 0
    UNION ALL SELECT question_id, 1, 'reduced_and', 3, array_to_string(informative, ' ') FROM p WHERE NOT advanced AND len(informative) > 0 AND informative <> raw
    UNION ALL SELECT question_id, 2, 'reduced_or', 1, array_to_string(informative, ' OR ') FROM p WHERE NOT advanced AND len(informative) >= 2),
  plan AS (SELECT question_id, strategy, priority, input, row_number() OVER (PARTITION BY question_id ORDER BY priority DESC) - 1 AS turn,
    count(*) OVER (PARTITION BY question_id) AS n_variants FROM v)"""


@query(f"WITH {_PLAN} SELECT question_id, turn, strategy, priority, input, (25 // n_variants + (CASE WHEN turn < 25 % n_variants THEN 1 ELSE 0 END))::INTEGER AS quota FROM plan")
def query_plan_variants(spark, sf_dir):
    """Variants and quotas of every question (no benchmark question has an ordinal or a range)."""
    plan = retrieval.planned_variants(asked(spark, sf_dir), TOP_K)
    return plan.select("question_id", F.col("turn").cast("long"), "strategy", "priority", "input", "quota")


@query(f"""WITH {_PLAN} SELECT question_id, k::INTEGER AS top_k, n_variants::INTEGER AS n_variants, turn::INTEGER AS turn, (lim // n_variants + (CASE WHEN turn < lim % n_variants THEN 1 ELSE 0 END))::INTEGER AS quota
  FROM plan, (SELECT k, least(100, greatest(20, 5 * k)) AS lim FROM range(1, 26) r(k))""")
def budget_quotas(spark, sf_dir):
    """Quotas of every question's variants for each number of results up to 25."""
    plan = retrieval.planned_variants(asked(spark, sf_dir), TOP_K).select("question_id", F.col("turn").cast("int").alias("turn"))
    sized = plan.join(plan.groupBy("question_id").agg(F.count(F.lit(1)).cast("int").alias("n_variants")), "question_id")
    rows = sized.withColumn("top_k", F.explode(F.sequence(F.lit(1), F.lit(25))))
    return rows.withColumn("quota", lx.quota(lx.candidate_limit(F.col("top_k")), F.col("n_variants"), F.col("turn")))


def _matched(spark: SparkSession, sf_dir: str, text: Column) -> DataFrame:
    """How many admissible chunks match a query made from each question."""
    variants = tables.question_terms(spark, sf_dir).filter(F.size("terms") >= 2).withColumns({"input": text, "turn": F.lit(0)})
    pairs = retrieval.match_candidates(stored(variants.drop("terms")), index(spark, sf_dir))
    return pairs.groupBy("question_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


_PAIRS = f"""e AS (SELECT chunk_id, institution_id, regexp_extract_all({normal('content')}, {WORD}) AS words FROM elig),
  q AS (SELECT * FROM qterms WHERE len(informative) >= 2),
  pairs AS (SELECT question_id, informative AS t, chunk_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line FROM q JOIN e USING (institution_id))"""


@query(f"WITH {_PAIRS} SELECT question_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM pairs WHERE list_has_all(words, t[1:3]) GROUP BY question_id")
def lexical_match_and(spark, sf_dir):
    return _matched(spark, sf_dir, F.array_join(F.slice("terms", 1, 3), " "))


@query(f"WITH {_PAIRS} SELECT question_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM pairs WHERE list_has_any(words, t) GROUP BY question_id")
def lexical_match_or(spark, sf_dir):
    return _matched(spark, sf_dir, F.array_join("terms", " OR "))


@query(f"WITH {_PAIRS} SELECT question_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM pairs WHERE contains(line, ' ' || t[1] || ' ' || t[2] || ' ') GROUP BY question_id")
def lexical_match_phrase(spark, sf_dir):
    return _matched(spark, sf_dir, F.concat(F.lit('"'), F.array_join(F.slice("terms", 1, 2), " "), F.lit('"')))


@query(f"WITH {_PAIRS} SELECT question_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM pairs WHERE list_contains(words, t[1]) AND NOT list_contains(words, t[2]) GROUP BY question_id")
def lexical_match_not(spark, sf_dir):
    return _matched(spark, sf_dir, F.concat(F.element_at("terms", 1), F.lit(" -"), F.element_at("terms", 2)))


_NAMES = ", ".join(f"l{k}" for k in range(1, 13))
_LAST = ", ".join(f"max(CASE WHEN i = {k} THEN position END) OVER w AS l{k}" for k in range(1, 13))
_WHOLE = " AND ".join(f"(l{k} IS NOT NULL OR {k} > n)" for k in range(1, 13))
_TF_RANK = f"""{_PLAN}, qt AS (SELECT question_id, unnest(informative) AS term, generate_subscripts(informative, 1) AS i FROM p),
  n AS (SELECT question_id, len(informative) AS n FROM p),
  ek AS (SELECT e.institution_id, k.chunk_id, k.canonical AS key, min(k.position) AS pos, count(*) AS places FROM ekeys k JOIN elig e USING (chunk_id) GROUP BY ALL),
  hits AS (SELECT q.question_id, ek.chunk_id, qt.term, qt.i, ek.pos, ek.places FROM qt JOIN questions q USING (question_id) JOIN ek ON ek.key = qt.term AND ek.institution_id = q.institution_id),
  occ AS (SELECT q.question_id, k.chunk_id, qt.i, k.position, n.n FROM qt JOIN questions q USING (question_id) JOIN n USING (question_id) JOIN ekeys k ON k.canonical = qt.term JOIN elig e ON e.chunk_id = k.chunk_id AND e.institution_id = q.institution_id),
  seen AS (SELECT *, {_LAST} FROM occ WINDOW w AS (PARTITION BY question_id, chunk_id ORDER BY position RANGE UNBOUNDED PRECEDING)),
  stretches AS (SELECT question_id, chunk_id, least({_NAMES}) AS start, min(position) AS stop FROM seen WHERE {_WHOLE} GROUP BY ALL),
  dens AS (SELECT question_id, chunk_id, sum(0.1::DOUBLE / (1 + greatest(0, stop - start - (inside - 1)))) AS density FROM (
    SELECT s.question_id, s.chunk_id, s.start, s.stop, count(*) AS inside FROM stretches s JOIN occ o ON o.question_id = s.question_id AND o.chunk_id = s.chunk_id AND o.position BETWEEN s.start AND s.stop GROUP BY ALL) GROUP BY ALL),
  per AS (SELECT question_id, chunk_id, count(*) AS m, sum(places) AS places, max(pos) - min(pos) + 1 AS span, count(DISTINCT pos) AS spots FROM hits GROUP BY ALL),
  ordered AS (SELECT a.question_id, a.chunk_id, count(*) AS pairs_ok FROM hits a JOIN hits b ON a.question_id = b.question_id AND a.chunk_id = b.chunk_id AND b.i = a.i + 1 WHERE a.pos < b.pos GROUP BY ALL),
  streams AS (SELECT k.chunk_id, ' ' || string_agg(k.canonical, ' ' ORDER BY k.position) || ' ' AS stream FROM ekeys k WHERE NOT list_contains({EN}, k.surface)
    AND NOT (length(k.surface) = 1 AND regexp_full_match(k.surface, '\\p{{L}}')) GROUP BY k.chunk_id),
  titles AS (SELECT e.chunk_id, regexp_extract_all({normal('e.title')}, {WORD}) AS words FROM elig e),
  match AS (SELECT per.question_id, per.chunk_id, n.n, per.m, per.places / 10.0::DOUBLE AS raw_score, per.m / n.n AS coverage,
    CASE WHEN n.n = 1 THEN 1.0 WHEN contains(s.stream, ' ' || array_to_string(p.informative, ' ') || ' ') THEN 1.0 ELSE 0.0 END AS exact_phrase,
    CASE WHEN n.n < 2 THEN 1.0 ELSE coalesce(o.pairs_ok, 0) / (n.n - 1) END AS ordered,
    CASE WHEN spots = 1 THEN 1.0 ELSE spots / span END AS compactness, spots / n.n * (CASE WHEN spots = 1 THEN 1.0 ELSE spots / span END) AS proximity,
    len(list_intersect(p.informative, t.words)) / n.n AS title_overlap
    FROM per JOIN n USING (question_id) JOIN p USING (question_id) LEFT JOIN streams s USING (chunk_id) JOIN titles t USING (chunk_id) LEFT JOIN ordered o USING (question_id, chunk_id))"""


def or_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (question, admissible chunk) with a term in common, with content signals."""
    some, held = asked(spark, sf_dir).filter(F.size("terms") > 0), index(spark, sf_dir)
    variant = stored(some.withColumns({"input": F.array_join("terms", " OR "), "turn": F.lit(0)}))
    pairs = retrieval.with_arrays(retrieval.match_candidates(variant, held), some, held)
    c = F.col
    return pairs.withColumns(retrieval.content_match(c("terms"), c("keys"), c("positions"), c("stream")))


@query(f"""WITH {_TF_RANK} SELECT question_id, chunk_id, m AS n_matched, round(coverage, 6) AS coverage, exact_phrase::DOUBLE AS exact_phrase, round(ordered, 6) AS ordered,
  round(proximity, 6) AS proximity, round(compactness, 6) AS compactness FROM match""")
def coverage_features(spark, sf_dir):
    rows = or_pairs(spark, sf_dir)
    sixth = lambda c: F.round(c, 6).alias(c)
    return rows.select("question_id", "chunk_id", F.col("n_matched").cast("long"), sixth("coverage"), "exact_phrase", *map(sixth, ("ordered", "proximity", "compactness")))


_DECIDED = f"""{_TF_RANK},
  wordsof AS (SELECT chunk_id, document_id, chunk_index, institution_id, content, structure_type, regexp_extract_all({normal('content')}, {WORD}) AS words FROM elig),
  hit AS (SELECT plan.*, w.chunk_id, w.document_id, w.chunk_index FROM plan JOIN p USING (question_id) JOIN questions q USING (question_id) JOIN wordsof w ON w.institution_id = q.institution_id
    WHERE CASE strategy WHEN 'exact' THEN CASE WHEN p.advanced THEN false ELSE list_has_all(w.words, p.raw) END WHEN 'reduced_and' THEN list_has_all(w.words, p.informative) ELSE list_has_any(w.words, p.informative) END),
  worth AS (SELECT hit.*, coalesce(CASE WHEN strategy = 'reduced_or' THEN m.raw_score ELSE c.density END, 0) AS raw_score FROM hit LEFT JOIN match m USING (question_id, chunk_id) LEFT JOIN dens c USING (question_id, chunk_id)),
  taken AS (SELECT * FROM worth QUALIFY row_number() OVER (PARTITION BY question_id, turn ORDER BY raw_score DESC, document_id, chunk_index, chunk_id) <= 25 // n_variants + (CASE WHEN turn < 25 % n_variants THEN 1 ELSE 0 END)),
  merged AS (SELECT question_id, chunk_id, document_id, chunk_index, arg_max(strategy, priority) AS strategy, max(priority) AS priority, max(raw_score) AS raw_score FROM taken GROUP BY ALL),
  feats AS (SELECT g.*, m.n, m.m, m.coverage, m.exact_phrase, m.ordered, m.proximity, m.compactness, m.title_overlap,
    CASE WHEN w.structure_type = 'table_row' AND m.coverage >= 0.5 AND m.compactness >= 0.5 THEN 1.0 ELSE 0.0 END AS bonus,
    g.raw_score / (g.raw_score + 0.1::DOUBLE) AS fts, 400.0::DOUBLE / greatest(length(w.content), 400) AS len_factor, g.priority / 4.0 AS quality
    FROM merged g JOIN match m USING (question_id, chunk_id) JOIN wordsof w USING (chunk_id)),
  scored AS (SELECT *, least(1.0, greatest(0.0, 0.40::DOUBLE * coverage + 0.16::DOUBLE * exact_phrase + 0.14::DOUBLE * proximity + 0.08::DOUBLE * ordered + 0.07::DOUBLE * title_overlap
      + 0.06::DOUBLE * bonus + 0.02::DOUBLE * (fts * len_factor) + 0.02::DOUBLE * quality)) AS score,
    CASE WHEN n = 1 THEN 'single_term_surface' WHEN exact_phrase >= 1 THEN 'exact_phrase' WHEN strategy IN ('exact', 'reduced_and') THEN 'conjunctive_strategy'
      WHEN m >= greatest(2, ceil(n * 0.5)) AND coverage >= 0.5 THEN 'coverage' ELSE 'insufficient_coverage' END AS decision FROM feats),
  decided AS (SELECT *, CASE WHEN decision = 'insufficient_coverage' THEN decision WHEN score < 0.05 THEN 'below_threshold' ELSE 'kept' END AS status FROM scored)"""


@query(f"WITH {_DECIDED} SELECT question_id, chunk_id, strategy, decision, status FROM decided")
def eligibility_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("question_id", "chunk_id", "strategy", "decision", "status")


@query(f"""WITH {_DECIDED} SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC, document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank,
  chunk_id, document_id, round(score, 6) AS score FROM decided WHERE status = 'kept' QUALIFY rank <= 5""")
def composite_topk(spark, sf_dir):
    """Ranked evidence for every question, the raw score by cover density."""
    rows = retrieval.ranked(decided(spark, sf_dir), TOP_K)
    return rows.select("question_id", F.col("rank").cast("long"), "chunk_id", "document_id", F.round("score", 6).alias("score"))


@query(f"""WITH {_DECIDED} SELECT question_id, count(*) AS n_candidates, count_if(status = 'kept') AS n_kept, count_if(status = 'no_content_match') AS n_no_content_match,
  count_if(status = 'insufficient_coverage') AS n_insufficient_coverage, count_if(status = 'below_threshold') AS n_below_threshold, count_if(strategy = 'exact') AS n_exact,
  count_if(strategy = 'reduced_and') AS n_reduced_and, count_if(strategy = 'canonical_relaxed_and') AS n_canonical_relaxed_and, count_if(strategy = 'reduced_or') AS n_reduced_or
  FROM decided GROUP BY question_id""")
def trace_counts(spark, sf_dir):
    return retrieval.trace(decided(spark, sf_dir))


# ---- dense ---------------------------------------------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.scan(spark, sf_dir, "embeddings")


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Nearest vectors of the query set (ids divisible by 50) among all vectors; each finds itself first."""
    rows = vectors(spark, sf_dir)
    index = once(spark, sf_dir, "metric_index", lambda: metric_index.build(rows, ["vec_id"]))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return metric_index.nearest(asked, index, k)


DENSE = """near AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS similarity,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0)"""


@query(f"WITH {DENSE} SELECT query_id, vec_id, rank, round(similarity, 6) AS similarity FROM near WHERE rank <= 5")
def dense_knn(spark, sf_dir):
    rows = neighbours(spark, sf_dir, TOP_K)
    return rows.select("query_id", "vec_id", F.col("rank").cast("long"), F.round("similarity", 6).alias("similarity"))


_INDEX = """idx AS (SELECT vec_id AS document_id, CASE WHEN vec_id % 11 = 0 THEN 'v0' ELSE 'v1' END AS configuration_version,
  CASE WHEN vec_id % 13 = 0 THEN sha256('old') ELSE sha256(text) END AS embedded_content_sha256 FROM embeddings JOIN documents ON doc_id = vec_id),
  adm AS (SELECT document_id, sha256(text) AS content_sha256 FROM docs WHERE is_active)"""


def _index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Admissible documents, and an index of them in which some vectors are of another configuration or content."""
    docs = tables.documents(spark, sf_dir)
    held = vectors(spark, sf_dir).join(docs, F.col("vec_id") == F.col("document_id")).select(
        "document_id", F.when(F.col("vec_id") % 11 == 0, "v0").otherwise("v1").alias("configuration_version"),
        F.when(F.col("vec_id") % 13 == 0, F.sha2(F.lit("old"), 256)).otherwise(F.sha2("text", 256)).alias("embedded_content_sha256"),
    )
    return docs.filter("is_active").select("document_id", F.sha2("text", 256).alias("content_sha256")), held


@query(f"WITH {_INDEX} SELECT count(*) AS n_admissible, count(idx.document_id) AS n_embedded FROM adm LEFT JOIN idx USING (document_id)")
def dense_coverage(spark, sf_dir):
    return dense.coverage(*_index(spark, sf_dir), "document_id")


@query(f"""WITH {_INDEX} SELECT document_id, CASE WHEN configuration_version IS NULL THEN 'missing' WHEN configuration_version <> 'v1' THEN 'stale_configuration'
  WHEN embedded_content_sha256 <> content_sha256 THEN 'stale_content' ELSE 'fresh' END AS state FROM adm LEFT JOIN idx USING (document_id)""")
def index_staleness(spark, sf_dir):
    return dense.index_state(*_index(spark, sf_dir), "document_id", "v1")


@query(f"""WITH {_INDEX} SELECT count(*) AS n_vectors, array_to_string(list_sort(list_distinct(list(configuration_version))), ',') AS configurations,
  count_if(embedded_content_sha256 <> content_sha256) AS n_stale_content FROM adm JOIN idx USING (document_id)""")
def index_homogeneity(spark, sf_dir):
    return dense.homogeneity(*_index(spark, sf_dir), "document_id")


@query()
def vector_digests(spark, sf_dir):
    return vectors(spark, sf_dir).select("vec_id", dense.vector_digest("embedding").alias("vector_sha256"))


# ---- answers -----------------------------------------------------------------------------------------------------


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.ranked(decided(spark, sf_dir), TOP_K).select("question_id", "rank", "chunk_id", "title", "content")


@query(f"""WITH {_DECIDED}, top AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC,
    document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank FROM decided WHERE status = 'kept' QUALIFY rank <= 5),
  sized AS (SELECT top.*, length('{{"id":"E' || rank || '","title":' || to_json(e.title) || ',"content":' || to_json(e.content) || '}}') AS payload_chars FROM top JOIN elig e USING (chunk_id)),
  summed AS (SELECT *, sum(payload_chars) OVER (PARTITION BY question_id ORDER BY rank) + rank + 1 AS used FROM sized)
  SELECT question_id, 'E' || rank AS evidence_id, chunk_id, payload_chars::BIGINT AS payload_chars, used::BIGINT AS used FROM summed WHERE rank = 1 OR used <= 1500""")
def context_packing(spark, sf_dir):
    rows = answering.pack_context(evidence(spark, sf_dir), 1500)
    return rows.select("question_id", "evidence_id", "chunk_id", F.col("payload_chars").cast("long"), F.col("used").cast("long"))


@query(f"""WITH {_DECIDED} SELECT question_id, CASE WHEN k.question_id IS NULL THEN 'insufficient_evidence' ELSE 'answered' END AS status
  FROM questions q LEFT JOIN (SELECT DISTINCT question_id FROM decided WHERE status = 'kept') k USING (question_id)""")
def ask(spark, sf_dir):
    """Every question answered by quoting its best evidence; without evidence nothing is generated."""
    return answering.ask(tables.questions(spark, sf_dir), evidence(spark, sf_dir), answering.quote_first).select("question_id", "status")


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as answers, citing ids that follow from their number."""
    i = F.col("message_id")
    cited = F.when(i % 5 == 0, F.array().cast("array<string>")).when(i % 5 == 1, F.array(F.lit("E1"), F.lit("E1"))).when(i % 5 == 2, F.array(F.lit("E1"), F.lit("E9"))).otherwise(F.array(F.lit("E1"), F.lit("E2")))
    rows = tables.messages(spark, sf_dir).filter("role = 'assistant'")
    return rows.select("message_id", F.col("content").alias("answer"), cited.alias("cited"), F.array(F.lit("E1"), F.lit("E2"), F.lit("E3")).alias("allowed"))


@query("""SELECT message_id, CASE WHEN trim(content) = '' THEN 'empty_answer' WHEN length(content) > 900 THEN 'answer_too_long' WHEN message_id % 5 = 0 THEN 'missing_citations'
  WHEN message_id % 5 = 1 THEN 'duplicate_evidence_ids' WHEN message_id % 5 = 2 THEN 'unknown_evidence_ids:1' ELSE 'valid' END AS verdict FROM messages WHERE role = 'assistant'""")
def citation_validation(spark, sf_dir):
    return answering.validate_answers(_answers(spark, sf_dir), 900).select("message_id", "verdict")


@query("""SELECT message_id AS case_id, message_id % 5 >= 3 AS status_ok, (CASE WHEN message_id % 5 = 2 THEN 1 ELSE 0 END)::INTEGER AS n_unknown, (CASE WHEN message_id % 5 = 1 THEN 1 ELSE 0 END)::INTEGER AS n_duplicate,
  (CASE message_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END)::INTEGER AS n_expected_missing, length(content) <= 4000 AS within_limit, true AS calls_ok,
  (CASE WHEN contains(lower(content), 'the and') THEN 1 ELSE 0 END)::INTEGER AS n_forbidden FROM messages WHERE role = 'assistant'""")
def answer_metrics(spark, sf_dir):
    rows = answering.validate_answers(_answers(spark, sf_dir)).select(
        F.col("message_id").alias("case_id"), F.when(F.col("verdict") == "valid", "answered").otherwise("invalid_answer").alias("status"), F.lit("answered").alias("expected_status"),
        "cited", "allowed", F.array(F.lit("E1"), F.lit("E2")).alias("expected_sources"), "answer", F.array(F.lit("the and")).alias("forbidden"), F.lit(1).alias("generator_calls"), F.lit(1).alias("expected_calls"),
    )
    return answering.answer_measures(rows)


@query("""SELECT c.chunk_id, true AS "exists", c.chunk_id % 3 <> 0 AS same_content, c.chunk_id % 4 <> 0 AS same_metadata,
  coalesce(c.processing_status = 'processed' AND c.is_active AND (valid_from IS NULL OR valid_from <= DATE '2024-06-01') AND (valid_until IS NULL OR valid_until >= DATE '2024-06-01') AND c.document_language = 'en', false) AS citable
  FROM cands c""")
def citation_revalidation(spark, sf_dir):
    """Citations of every chunk, some recorded with other content or metadata, against the rows of now."""
    from proofloom.operators import admissibility as adm
    from proofloom.plans.corpus_queries import REFERENCE_DATE, candidates

    rows = adm.within(candidates(spark, sf_dir), F.col("chunk_institution"), "en", REFERENCE_DATE)
    named = adm.conditions()
    ok = None
    for name in adm.CITATION:
        ok = named[name] if ok is None else ok & named[name]
    now = rows.withColumn("citable", ok)
    recorded = rows.select(
        "chunk_id", F.when(F.col("chunk_id") % 3 == 0, F.sha2(F.lit("then"), 256)).otherwise(F.sha2("content", 256)).alias("content_sha256"),
        F.when(F.col("chunk_id") % 4 == 0, "other").otherwise(F.col("title")).alias("document_title"), "chunk_index",
    )
    return answering.revalidate(recorded, now).select("chunk_id", "exists", "same_content", "same_metadata", "citable")
