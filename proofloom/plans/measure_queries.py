"""Queries that measure rankings, compare conditions and calibrate abstention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.operators import diagnostics, fusion, metric_index, metrics, retrieval, statistics
from proofloom.plans.declare import query
from proofloom.plans.search_queries import _DECIDED, decided, neighbours, vectors
from proofloom.sources import tables
from proofloom.sources.stored import once

# Rankings of vectors stand for two conditions: the exact neighbours, and neighbours by the first half of the vector.
# A vector is relevant (2) for a query of its label, and related (1) where the labels are next to each other.


def exact(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    rows = neighbours(spark, sf_dir, k)
    return rows.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("item"), F.col("rank").cast("long"), "similarity")


def halved(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    rows = vectors(spark, sf_dir).withColumn("embedding", F.slice("embedding", 1, 32))
    index = once(spark, sf_dir, "halved_metric_index", lambda: metric_index.build(rows, ["vec_id"]))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = metric_index.nearest(asked, index, k)
    return found.select(F.col("query_id").alias("question_id"), F.col("vec_id").alias("item"), F.col("rank").cast("long"), "similarity")


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Graded pairs of the query vectors with all vectors of their label and of the labels next to it."""
    rows = vectors(spark, sf_dir).select("vec_id", "label")
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), F.col("label").alias("own"))
    near = F.explode(F.array(*(F.struct((F.col("own") + d).alias("label"), F.lit(g).alias("grade")) for d, g in ((0, 2), (1, 1), (-1, 1)))))
    wanted = asked.select("question_id", near.alias("w")).select("question_id", "w.label", "w.grade")
    return rows.join(wanted, "label").select("question_id", F.col("vec_id").alias("item"), "grade")


_SIM = "list_cosine_similarity({0}, {1})"


def _ranked(name: str, a: str, b: str) -> str:
    s = f"list_cosine_similarity({a}, {b})"
    return f"""{name} AS (SELECT q.vec_id AS question_id, v.vec_id AS item, {s} AS similarity, row_number() OVER (PARTITION BY q.vec_id ORDER BY {s} DESC, v.vec_id) AS rank
  FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0 QUALIFY rank <= 5)"""


LISTS = (
    _ranked("a", "v.embedding::DOUBLE[]", "q.embedding::DOUBLE[]")
    + ", "
    + _ranked("b", "v.embedding[1:32]::DOUBLE[]", "q.embedding[1:32]::DOUBLE[]")
    + """, j AS (SELECT q.vec_id AS question_id, v.vec_id AS item, CASE WHEN v.label = q.label THEN 2 ELSE 1 END AS grade FROM embeddings q, embeddings v
  WHERE q.vec_id % 50 = 0 AND abs(v.label - q.label) <= 1)"""
)

_PER = """g AS (SELECT r.*, coalesce(j.grade, 0) AS grade, j.grade IS NOT NULL AS judged FROM {0} r LEFT JOIN j USING (question_id, item)),
  gains AS (SELECT *, CASE grade WHEN 2 THEN 3.0 WHEN 1 THEN 1.0 ELSE 0.0 END / log2(rank + 1) AS v FROM g),
  best AS (SELECT question_id, grade, row_number() OVER (PARTITION BY question_id ORDER BY grade DESC) AS rank FROM j),
  ideal AS (SELECT question_id, count_if(grade = 2) AS n_relevant, {1} FROM (SELECT *, CASE grade WHEN 2 THEN 3.0 ELSE 1.0 END / log2(rank + 1) AS v FROM best) GROUP BY question_id),
  hits AS (SELECT question_id, {2}, min(rank) FILTER (WHERE grade = 2) AS first FROM gains GROUP BY question_id),
  per AS (SELECT question_id, n_relevant, {3}, coalesce(1.0 / first, 0.0) AS reciprocal_rank, {4} FROM ideal LEFT JOIN hits USING (question_id))"""


def _per(name: str) -> str:
    ks = (1, 3, 5)
    return _PER.format(
        name,
        ", ".join(f"sum(v) FILTER (WHERE rank <= {k}) AS ideal_{k}" for k in ks),
        ", ".join(f"count_if(rank <= {k} AND grade = 2) AS hits_{k}, coalesce(sum(v) FILTER (WHERE rank <= {k}), 0) AS dcg_{k}" for k in ks),
        ", ".join(f"CASE WHEN n_relevant > 0 THEN coalesce(hits_{k}, 0) / n_relevant END AS recall_{k}" for k in ks),
        ", ".join(f"CASE WHEN ideal_{k} > 0 THEN coalesce(dcg_{k}, 0) / ideal_{k} END AS ndcg_{k}" for k in ks),
    )


_MEASURES = ("recall_1", "recall_3", "recall_5", "reciprocal_rank", "ndcg_1", "ndcg_3", "ndcg_5")


@query(f"WITH {LISTS}, {_per('a')} SELECT question_id, n_relevant, {', '.join(f'round({m}, 6) AS {m}' for m in _MEASURES)} FROM per")
def recall_mrr_ndcg(spark, sf_dir):
    rows = metrics.per_question(exact(spark, sf_dir), judged(spark, sf_dir))
    return rows.select("question_id", "n_relevant", *(F.round(m, 6).alias(m) for m in _MEASURES))


@query(f"WITH {LISTS}, {_per('a')} SELECT count(*) AS n_questions, {', '.join(f'round(avg(round({m}, 6)), 6) AS mean_{m}' for m in _MEASURES)} FROM per WHERE n_relevant > 0")
def macro_average(spark, sf_dir):
    return metrics.macro(metrics.per_question(exact(spark, sf_dir), judged(spark, sf_dir)))


@query(f"WITH {LISTS}, {_per('b')} SELECT count(*) AS n_questions, {', '.join(f'round(avg({m}), 6) AS mean_{m}' for m in _MEASURES)} FROM per WHERE n_relevant > 0")
def macro_average_unrounded(spark, sf_dir):
    return metrics.macro(metrics.per_question(halved(spark, sf_dir), judged(spark, sf_dir)), rounded_first=False)


@query(f"""WITH {LISTS}, {_per('a')} SELECT question_id, count_if(judged AND grade = 0) AS n_grade_0, count_if(grade = 1) AS n_grade_1, count_if(grade = 2) AS n_grade_2,
  count_if(NOT judged) AS n_unjudged, count_if(grade = 0) / count(*) AS irrelevant_share FROM g GROUP BY question_id""")
def grade_histogram(spark, sf_dir):
    return metrics.grade_histogram(metrics.graded(exact(spark, sf_dir), judged(spark, sf_dir)))


@query(f"""WITH {LISTS}, {_per('a')}, attrs AS (SELECT question_id, unnest(CASE WHEN question_id // 50 % 2 = 0 THEN ['even', 'any'] ELSE ['odd', 'any'] END) AS value FROM per)
  SELECT value, count(*) AS n_questions, avg(ndcg_5) AS mean_ndcg_5 FROM per JOIN attrs USING (question_id) GROUP BY value""")
def difficulty_breakdown(spark, sf_dir):
    rows = metrics.per_question(exact(spark, sf_dir), judged(spark, sf_dir))
    values = F.when(F.floor(F.col("question_id") / 50) % 2 == 0, F.array(F.lit("even"), F.lit("any"))).otherwise(F.array(F.lit("odd"), F.lit("any")))
    return metrics.breakdown(rows, rows.select("question_id", values.alias("values")), "ndcg_5")


_A, _B = _per("a"), _per("b").replace("g AS", "g2 AS").replace("gains AS", "gains2 AS").replace("FROM g)", "FROM g2)").replace("FROM gains", "FROM gains2").replace("best AS", "best2 AS").replace("FROM best)", "FROM best2)").replace("ideal AS", "ideal2 AS").replace("hits AS", "hits2 AS").replace("per AS", "per2 AS").replace("FROM ideal LEFT JOIN hits", "FROM ideal2 LEFT JOIN hits2")


@query(f"""WITH {LISTS}, {_A}, {_B}, d AS (SELECT question_id, [p2.recall_5 - p.recall_5, p2.reciprocal_rank - p.reciprocal_rank, p2.ndcg_5 - p.ndcg_5] AS x FROM per p JOIN per2 p2 USING (question_id))
  SELECT question_id, CASE WHEN u AND w THEN 'mixed' WHEN u THEN 'improved' WHEN w THEN 'regressed' ELSE 'same' END AS direction
  FROM (SELECT question_id, coalesce(list_max(x), 0) > 1e-9 AS u, coalesce(list_min(x), 0) < -1e-9 AS w FROM d)""")
def before_after_direction(spark, sf_dir):
    known = judged(spark, sf_dir)
    before, after = (metrics.per_question(f(spark, sf_dir), known) for f in (exact, halved))
    fill = {m: 0.0 for m in _MEASURES}
    rows = metrics.direction(before.fillna(fill), after.fillna(fill), ["recall_5", "reciprocal_rank", "ndcg_5"])
    return rows


_SCALE = 495593280
_RRF = f"""u AS (SELECT question_id, item, rank, 'c0' AS list FROM a UNION ALL SELECT question_id, item, rank, 'c1' FROM b),
  fused AS (SELECT question_id, item, sum({_SCALE} // (60 + rank))::BIGINT AS units, min(rank) AS best_rank, count(*) AS n_lists,
    min(rank) FILTER (WHERE list = 'c0') AS rank_c0, min(rank) FILTER (WHERE list = 'c1') AS rank_c1 FROM u GROUP BY ALL),
  rrf AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY units DESC, best_rank, item) AS rank FROM fused QUALIFY rank <= 5)"""


@query(f"WITH {LISTS}, {_RRF} SELECT question_id, item, round(units / {_SCALE}::DOUBLE, 9) AS score, best_rank, n_lists, rank_c0, rank_c1, rank FROM rrf")
def rrf_fusion(spark, sf_dir):
    rows = fusion.rrf({"c0": exact(spark, sf_dir), "c1": halved(spark, sf_dir)})
    return rows.withColumns({"score": F.round("score", 9), "rank": F.col("rank").cast("long")})


@query(f"WITH {LISTS} SELECT question_id, item FROM a UNION SELECT question_id, item FROM b")
def union_pool(spark, sf_dir):
    return fusion.pool(exact(spark, sf_dir), halved(spark, sf_dir))


@query(f"WITH {LISTS} SELECT question_id, item FROM a EXCEPT SELECT question_id, item FROM b")
def exclusive_pool(spark, sf_dir):
    return fusion.exclusive(exact(spark, sf_dir), halved(spark, sf_dir))


@query(f"WITH {LISTS} SELECT question_id, count(*) AS n_both FROM a JOIN b USING (question_id, item) GROUP BY question_id")
def overlap_pool(spark, sf_dir):
    return fusion.overlap(exact(spark, sf_dir), halved(spark, sf_dir))


@query(f"""WITH {LISTS}, pool AS (SELECT question_id, item FROM a UNION SELECT question_id, item FROM b)
  SELECT question_id, n_unjudged, CASE WHEN n_unjudged = 0 THEN 'COMPARABLE' ELSE 'REPOOLING_REQUIRED' END AS class
  FROM (SELECT question_id, count_if(j.item IS NULL) AS n_unjudged FROM pool LEFT JOIN j USING (question_id, item) GROUP BY question_id)""")
def comparability(spark, sf_dir):
    return fusion.comparability(fusion.pool(exact(spark, sf_dir), halved(spark, sf_dir)), judged(spark, sf_dir))


@query(f"""WITH {LISTS} SELECT question_id, item, a.rank AS rank_a, b.rank AS rank_b FROM a FULL JOIN b USING (question_id, item)
  WHERE NOT EXISTS (SELECT 1 FROM j WHERE j.question_id = coalesce(a.question_id, b.question_id) AND j.item = coalesce(a.item, b.item))""")
def repooling_requests(spark, sf_dir):
    return fusion.repooling_requests(exact(spark, sf_dir), halved(spark, sf_dir), judged(spark, sf_dir))


@query(f"""WITH {LISTS}, n AS (SELECT question_id, item, CASE WHEN item % 6 = 0 THEN 2 ELSE grade END AS grade FROM j WHERE item % 10 <> 0 UNION ALL SELECT question_id, item, 0 FROM a WHERE item % 2 = 1)
  SELECT question_id, item, j.grade AS old, n.grade AS new, CASE WHEN j.grade IS NULL THEN 'added' WHEN n.grade IS NULL THEN 'removed' ELSE 'revised' END AS change
  FROM j FULL JOIN n USING (question_id, item) WHERE j.grade IS DISTINCT FROM n.grade""")
def verify_repooling(spark, sf_dir):
    before = judged(spark, sf_dir)
    changed = before.filter("item % 10 <> 0").withColumn("grade", F.when(F.col("item") % 6 == 0, 2).otherwise(F.col("grade")))
    after = changed.unionByName(exact(spark, sf_dir).filter("item % 2 = 1").select("question_id", "item", F.lit(0).alias("grade")))
    return fusion.verify_repooling(before, after)


@query(f"""WITH {LISTS}, t AS (SELECT question_id, item FROM j WHERE grade = 2) SELECT question_id, item, a.rank AS rank_a, b.rank AS rank_b,
  CASE WHEN a.rank IS NOT NULL AND b.rank IS NOT NULL THEN 'both' WHEN a.rank IS NOT NULL THEN 'a_only' WHEN b.rank IS NOT NULL THEN 'b_only' ELSE 'neither' END AS outcome
  FROM t LEFT JOIN a USING (question_id, item) LEFT JOIN b USING (question_id, item)""")
def target_outcomes(spark, sf_dir):
    return fusion.target_outcomes(judged(spark, sf_dir).filter("grade = 2"), exact(spark, sf_dir), halved(spark, sf_dir))


@query(f"""WITH {LISTS}, o AS (SELECT a.rank AS x, b.rank AS y FROM (SELECT question_id, item FROM j WHERE grade = 2) LEFT JOIN a USING (question_id, item) LEFT JOIN b USING (question_id, item))
  SELECT count(*) FILTER (x = y) AS preserved, count(*) FILTER (y < x) AS promoted, count(*) FILTER (y > x) AS demoted, count_if(x IS NOT NULL AND y IS NULL) AS lost, count_if(x IS NULL AND y IS NOT NULL) AS gained,
  count_if(x IS NULL AND y IS NULL) AS neither FROM o""")
def complementarity(spark, sf_dir):
    return fusion.complementarity(target_outcomes(spark, sf_dir))


# ---- lexical experiments -----------------------------------------------------------------------------------------


_FATE = f"""{_DECIDED}, tops AS (SELECT question_id, document_id FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC,
    document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank FROM decided WHERE status = 'kept') WHERE rank <= 5),
  fates AS (SELECT j.question_id, j.document_id AS item, CASE WHEN EXISTS (SELECT 1 FROM tops t WHERE t.question_id = j.question_id AND t.document_id = j.document_id) THEN 'RETURNED'
    WHEN EXISTS (SELECT 1 FROM decided d WHERE d.question_id = j.question_id AND d.document_id = j.document_id AND status = 'kept') THEN 'OUTSIDE_TOP_K'
    WHEN EXISTS (SELECT 1 FROM decided d WHERE d.question_id = j.question_id AND d.document_id = j.document_id) THEN 'EXCLUDED' ELSE 'NEVER_A_CANDIDATE' END AS fate FROM judgments j)"""


def _fates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decided(spark, sf_dir).withColumn("item", F.col("document_id"))
    targets = tables.judgments(spark, sf_dir).withColumnRenamed("document_id", "item")
    return metrics.target_fate(targets, rows, retrieval.ranked(rows, 5))


@query(f"WITH {_FATE} SELECT question_id, item, fate FROM fates")
def target_fate(spark, sf_dir):
    return _fates(spark, sf_dir)


@query(f"WITH {_FATE} SELECT count(*) AS n_targets, avg(CASE WHEN fate <> 'NEVER_A_CANDIDATE' THEN 1.0 ELSE 0.0 END) AS candidate_recall FROM fates")
def candidate_recall(spark, sf_dir):
    return metrics.candidate_recall(_fates(spark, sf_dir))


@query("SELECT question_id, document_id, grade FROM judgments")
def judgments(spark, sf_dir):
    return tables.judgments(spark, sf_dir)


@query(f"""WITH {_DECIDED}, w(variant, cov, prox, ord) AS (VALUES ('A0', 0.5, 0.3, 0.2), ('A1', 0.6, 0.2, 0.2), ('B1', 0.2, 0.6, 0.2))
  SELECT question_id, chunk_id, variant, round(cov * coverage + prox * proximity + ord * ordered, 6) AS variant_score FROM decided, w""")
def ranking_variants(spark, sf_dir):
    variants = spark.createDataFrame([("A0", 0.5, 0.3, 0.2), ("A1", 0.6, 0.2, 0.2), ("B1", 0.2, 0.6, 0.2)], "variant string, coverage double, proximity double, ordered double")
    rows = metrics.weighted_variants(decided(spark, sf_dir), variants, ["coverage", "proximity", "ordered"])
    return rows.select("question_id", "chunk_id", "variant", F.round("variant_score", 6).alias("variant_score"))


@query(f"""WITH {_DECIDED} SELECT question_id, signal, round(sum(value), 6) AS total, count(*) AS n FROM (
  SELECT question_id, unnest(['coverage', 'proximity', 'title_overlap']) AS signal, unnest([coverage, proximity, title_overlap]::DOUBLE[]) AS value FROM decided) GROUP BY ALL""")
def signal_decomposition(spark, sf_dir):
    rows = metrics.decomposition(decided(spark, sf_dir), {s: retrieval.WEIGHTS[s] for s in ("coverage", "proximity", "title_overlap")})
    return rows.groupBy("question_id", "signal").agg(F.round(F.sum("value"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""WITH m AS (SELECT o_custkey AS question_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) - 1 AS turn, count(*) OVER (PARTITION BY o_custkey) AS n_variants, count(*) AS available
    FROM (SELECT o_custkey, o_totalprice::INTEGER % 4 AS o_orderpriority FROM orders) GROUP BY o_custkey, o_orderpriority)
  SELECT question_id, turn, available, least(available, 5 // n_variants + (CASE WHEN turn < 5 % n_variants THEN 1 ELSE 0 END))::INTEGER AS current_quota,
    greatest(0, least(available, 5 - coalesce(sum(available) OVER (PARTITION BY question_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::INTEGER AS global_limited_pool FROM m""")
def budget_policies(spark, sf_dir):
    """Quota policies over customers' orders in four classes, with a budget of five."""
    from pyspark.sql import Window

    by = tables.scan(spark, sf_dir, "orders").select(F.col("o_custkey").alias("question_id"), (F.rint("o_totalprice").cast("int") % 4).alias("class"))
    per = by.groupBy("question_id", "class").agg(F.count(F.lit(1)).alias("available"))
    whole = Window.partitionBy("question_id")
    rows = per.withColumns({"turn": F.row_number().over(whole.orderBy("class")) - 1, "n_variants": F.count(F.lit(1)).over(whole)})
    return metrics.budget_policies(rows, 5).select("question_id", F.col("turn").cast("long"), "available", "current_quota", "global_limited_pool")


# ---- abstention ----------------------------------------------------------------------------------------------------


_SIGNALS = """s AS (SELECT question_id, count(*) AS returned, max(similarity) FILTER (WHERE rank = 1) AS top1, max(similarity) FILTER (WHERE rank = 2) AS top2 FROM a GROUP BY question_id),
  sig AS (SELECT *, top1 - top2 AS margin, CASE WHEN question_id // 50 % 3 = 0 THEN 'NO_EVIDENCE' ELSE 'ANSWERABLE' END AS label, question_id // 50 % 2 = 0 AS solved FROM s)"""


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statistics.admission_signals(exact(spark, sf_dir))
    turn = F.floor(F.col("question_id") / 50)
    label = F.when(turn % 3 == 0, "NO_EVIDENCE").otherwise("ANSWERABLE")
    return rows.withColumns({"label": label, "solved": turn % 2 == 0})


@query(f"WITH {LISTS}, {_SIGNALS} SELECT question_id, returned, round(top1, 6) AS top1, round(top2, 6) AS top2, round(margin, 6) AS margin FROM sig")
def admission_signals(spark, sf_dir):
    return signals(spark, sf_dir).select("question_id", "returned", *(F.round(c, 6).alias(c) for c in ("top1", "top2", "margin")))


_GRID = """pol AS (SELECT 0 AS policy_id, 'R0' AS rule, NULL::DOUBLE AS min_top1, NULL::DOUBLE AS min_margin
  UNION ALL SELECT (1 + i)::INTEGER, 'R1', 0.40 + 0.05 * i, NULL FROM range(5) t(i) UNION ALL SELECT (6 + 3 * i + k)::INTEGER, 'R2', 0.40 + 0.05 * i, [0.01, 0.02, 0.05][k + 1] FROM range(5) t(i), range(3) u(k)),
  adm AS (SELECT pol.*, label, solved, CASE rule WHEN 'R0' THEN top1 IS NOT NULL WHEN 'R1' THEN coalesce(top1 >= min_top1, false) ELSE coalesce(top1 >= min_top1 AND margin >= min_margin, false) END AS ok FROM sig, pol)"""


@query(f"""WITH {LISTS}, {_SIGNALS}, {_GRID} SELECT policy_id, rule, round(min_top1, 2) AS min_top1, min_margin::DOUBLE AS min_margin, count(*) AS n, count_if(ok) AS n_admitted, round(count_if(ok) / count(*), 6) AS coverage,
  CASE WHEN count_if(ok) > 0 THEN round(count_if(ok AND NOT solved) / count_if(ok), 6) END AS risk,
  round(count_if(label = 'NO_EVIDENCE' AND NOT ok) / count_if(label = 'NO_EVIDENCE'), 6) AS correct_abstention,
  round(count_if(label = 'ANSWERABLE' AND NOT ok) / count_if(label = 'ANSWERABLE'), 6) AS false_abstention FROM adm GROUP BY ALL""")
def admission_policies(spark, sf_dir):
    return statistics.admission_metrics(signals(spark, sf_dir), statistics.policy_grid(spark))


@query("""SELECT scenario_id, label, difficulty, CASE WHEN (row_number() OVER (PARTITION BY label, difficulty ORDER BY scenario_id) - 1) % 2 = 0 THEN 'DEV' ELSE 'HELD_OUT' END AS split
  FROM (SELECT l.doc_id AS scenario_id, quality AS label, toxic AS difficulty FROM labels l)""")
def stratified_split(spark, sf_dir):
    rows = tables.scan(spark, sf_dir, "labels").select(F.col("doc_id").alias("scenario_id"), F.col("quality").alias("label"), F.col("toxic").alias("difficulty"))
    return statistics.stratified_split(rows)


@query("SELECT count(*) AS n_scenarios, avg(m) AS scenario_mean FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY user_id)")
def scenario_macro_mean(spark, sf_dir):
    return statistics.scenario_mean(tables.scan(spark, sf_dir, "events").withColumnRenamed("user_id", "scenario_id"), "value")


@query("SELECT quantile_cont(l_extendedprice, 0.025) AS q0025, quantile_cont(l_extendedprice, 0.5) AS q0500, quantile_cont(l_extendedprice, 0.975) AS q0975 FROM lineitem")
def quantile_type7(spark, sf_dir):
    return statistics.quantiles(tables.scan(spark, sf_dir, "lineitem"), "l_extendedprice", [0.025, 0.5, 0.975])


@query()
def bootstrap_ci(spark, sf_dir):
    return statistics.cluster_bootstrap(tables.scan(spark, sf_dir, "events").withColumnRenamed("user_id", "scenario_id"), "value")


# ---- facts ---------------------------------------------------------------------------------------------------------


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two facts a question: its first two words, and the next two."""
    words = F.regexp_extract_all("query", F.lit(r"(?U)([^\W_]+)"), F.lit(1))
    rows = tables.questions(spark, sf_dir).select("question_id", words.alias("words")).filter(F.size("words") >= 4)
    facts = F.explode(F.array(*(F.struct(F.lit(f"F{k + 1}").alias("fact"), F.array_join(F.slice("words", 2 * k + 1, 2), " ").alias("needle")) for k in range(2))))
    return rows.select("question_id", facts.alias("f")).select("question_id", "f.*")


_FACTS = """f AS (SELECT question_id, unnest(['F1', 'F2']) AS fact, unnest([array_to_string(raw[1:2], ' '), array_to_string(raw[3:4], ' ')]) AS needle FROM qterms WHERE len(raw) >= 4),
  t AS (SELECT doc_id AS document_id, chunk_index, ' ' || array_to_string(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}]+'), ' ') || ' ' AS line FROM linesof WHERE trim(line) <> ''),
  pres AS (SELECT DISTINCT question_id, fact, document_id, chunk_index FROM f JOIN t ON contains(line, ' ' || needle || ' '))"""


def _fact_sql() -> str:
    from proofloom.plans.views import normal

    return _FACTS.format(normal("line"))


def presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from proofloom.functions.text import normalize_text

    lines = tables.lines(spark, sf_dir).select("document_id", "chunk_index", normalize_text(F.col("content")).alias("normalized"))
    return diagnostics.fact_presence(_facts(spark, sf_dir), lines)


@query(f"WITH {_fact_sql()} SELECT question_id, fact, document_id, chunk_index FROM pres")
def fact_presence(spark, sf_dir):
    return presence(spark, sf_dir).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query(f"""WITH {_fact_sql()}, per AS (SELECT question_id, document_id, chunk_index, bool_or(fact = 'F1') AS one, bool_or(fact = 'F2') AS two FROM pres GROUP BY ALL),
  m AS (SELECT question_id, document_id, min(chunk_index) FILTER (WHERE one AND two) AS c, min(chunk_index) FILTER (WHERE one AND NOT two) AS a, min(chunk_index) FILTER (WHERE two AND NOT one) AS b, bool_or(one) AND bool_or(two) AS complete FROM per GROUP BY ALL)
  SELECT question_id, document_id, complete, CASE WHEN c IS NOT NULL THEN c::VARCHAR WHEN complete THEN least(a, b)::VARCHAR || ',' || greatest(a, b)::VARCHAR ELSE coalesce(a, b)::VARCHAR END AS first_set FROM m""")
def covering_sets(spark, sf_dir):
    """Whether a document's chunks hold all facts, and the first of the smallest sets that do (else of the facts there are)."""
    found = diagnostics.covering_sets(presence(spark, sf_dir), _facts(spark, sf_dir))
    return found.select("question_id", "document_id", "complete", F.array_join(F.get("sets", F.lit(0)).cast("array<string>"), ",").alias("first_set"))


# ---- question similarity ---------------------------------------------------------------------------------------------


@query("""WITH w AS (SELECT question_id, list_distinct(list_filter(raw, lambda t: length(t) > 2)) AS w FROM qterms)
  SELECT a.question_id AS question_a, b.question_id AS question_b, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS jaccard
  FROM w a JOIN w b ON a.question_id < b.question_id WHERE list_has_any(a.w, b.w)""")
def token_jaccard_pairs(spark, sf_dir):
    """Questions that share a word of over two letters, with how alike they are; pairs meet on shared words."""
    words = F.array_distinct(F.filter(F.regexp_extract_all("query", F.lit(r"(?U)([^\W_]+)"), F.lit(1)), lambda t: F.length(t) > 2))
    rows = tables.questions(spark, sf_dir).select("question_id", words.alias("words"))
    flat = rows.select("question_id", F.size("words").alias("n"), F.explode("words").alias("word"))
    a, b = (flat.select(F.col("question_id").alias(f"question_{s}"), F.col("n").alias(f"n_{s}"), "word") for s in "ab")
    both = a.join(b, "word").filter("question_a < question_b").groupBy("question_a", "question_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("n_both"))
    return both.select("question_a", "question_b", (F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both"))).alias("jaccard"))
