"""Lexical retrieval over a table of questions at once: variants, matching, quotas, scoring, eligibility, top-k.

Candidates come from an inverted join within an institution and language. A variant that asks for several
things at once meets chunks only on the one that fewest chunks have, so a common word pairs nothing by itself;
alternatives meet on each of their words. Pairs are ids alone until a variant's quota is drawn: whether they
match is read from the chunk's words, what they are worth from the places of the question's terms. Only the
few candidates that are left meet the arrays of their chunk, and from there on all is Column arithmetic.

Questions have question_id, institution_id, language, query (normalised). Chunks have chunk_id, document_id,
chunk_index, institution_id, language, content, normalized, title, section_title, structure_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions import lexical as lx
from proofloom.functions.text import normalize_text
from proofloom.operators.meeting import rarest_meetings

# Weights of the composite score, its saturation and length constants, and the floor.
WEIGHTS = {"coverage": 0.40, "exact_phrase": 0.16, "proximity": 0.14, "ordered": 0.08, "title_overlap": 0.07, "section_overlap": 0.05, "table_row_bonus": 0.06, "fts": 0.02, "strategy_quality": 0.02}
SATURATION, SOFT_LENGTH = 0.1, 400
MIN_SCORE = 0.05
MIN_COVERAGE, MIN_MATCHED = 0.5, 2


# ---- arrays of one text -------------------------------------------------------------------------------


def place_keys(toks: Column) -> Column:
    """array<struct<key, position>>: canonical forms with range ends beside them, in reading order."""
    per = F.transform(toks, lambda t: F.array_compact(F.array(*(F.when(t[c].isNotNull(), F.struct(t[c].alias("key"), t["position"].alias("position"))) for c in ("canonical", "lo", "hi")))))
    return F.flatten(per)


def first_position(keys: Column, positions: Column, term: Column) -> Column:
    """Position of the first place of a term, null where it has none."""
    return F.try_element_at(positions, F.nullif(F.array_position(keys, term), F.lit(0)).cast("int"))


def analyze_chunks(chunks: DataFrame) -> DataFrame:
    """Adds keys, positions (of every key), stream (content forms in order) and words (distinct, for matching)."""
    lang = F.col("language")
    rows = chunks.withColumn("__t", lx.tokens(F.col("normalized"), lang))
    rows = rows.withColumn("__k", place_keys(F.col("__t")))
    return rows.withColumns(
        {
            "keys": F.col("__k.key"),
            "positions": F.col("__k.position"),
            "stream": lx.stream(F.col("__t"), lang),
            "words": F.regexp_extract_all("normalized", F.lit(r"(?U)([^\W_]+)"), F.lit(0)),
        }
    ).drop("__t", "__k")


def analyze_questions(questions: DataFrame) -> DataFrame:
    """Adds terms (canonical, for scoring) and explicit (whether operators are written out)."""
    lang = F.col("language")
    toks = lx.tokens(F.col("query"), lang)
    return questions.withColumns({"terms": lx.query_terms(toks, lang), "explicit": lx.advanced_syntax(F.col("query"))}).filter("query <> ''")


def planned_variants(questions: DataFrame, top_k: int) -> DataFrame:
    """One row for each variant of each question: strategy, priority, input, quota."""
    plan = questions.withColumn("__p", lx.plan_variants(F.col("query"), F.col("language")))
    rows = plan.select(*questions.columns, F.size("__p").alias("n_variants"), F.posexplode("__p").alias("turn", "v"))
    limit = lx.candidate_limit(F.lit(top_k))
    return rows.select(*questions.columns, "turn", "v.strategy", "v.priority", "v.input", lx.quota(limit, F.col("n_variants"), F.col("turn")).alias("quota"))


# ---- matching ------------------------------------------------------------------------------------------


def parse_websearch(text: Column) -> Column:
    """array<struct<negated, phrase array<string>, alternative>> of a query: words, "phrases", or, -negated.

    ``alternative`` marks a unit joined to the one before it by the word "or".
    """
    parts = F.regexp_extract_all(text, F.lit(r'(?U)(-?"[^"]*"|-?[^\s"]+)'), F.lit(0))

    def unit(part: Column, i: Column) -> Column:
        words = F.regexp_extract_all(part, F.lit(r"(?U)([^\W_]+)"), F.lit(0))
        before = F.when(i > 0, F.lower(F.get(parts, i - 1)) == lx.OPERATOR).otherwise(False)
        return F.struct(part.rlike(r'^-["\w]').alias("negated"), words.alias("phrase"), before.alias("alternative"), (F.lower(part) == lx.OPERATOR).alias("operator"))

    units = F.filter(F.transform(parts, unit), lambda u: ~u["operator"] & (F.size(u["phrase"]) > 0))
    return F.transform(units, lambda u: F.struct(u["negated"].alias("negated"), u["phrase"].alias("phrase"), u["alternative"].alias("alternative")))


def has_phrase(words: Column, phrase: Column) -> Column:
    """Whether the words of a phrase stand next to each other in order; an empty word of the phrase stands for any."""
    n = F.size(phrase)
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1)))
    like = lambda i: F.forall(F.zip_with(F.slice(words, i, n), phrase, lambda w, p: (p == "") | (w == p)), lambda b: b)
    long = F.exists(starts, lambda i: F.when(F.array_contains(phrase, ""), like(i)).otherwise(F.slice(words, i, n) == phrase))
    return F.when(n == 1, F.array_contains(words, F.element_at(phrase, 1))).when(n > F.size(words), F.lit(False)).otherwise(long)


def matches(words: Column, units: Column) -> Column:
    """Whether a text's words satisfy a parsed query: alternatives bind closer than conjunction."""
    start = F.struct(F.lit(True).alias("all"), F.lit(True).alias("last"), F.lit(True).alias("first"))

    def step(acc: Column, u: Column) -> Column:
        hit = has_phrase(words, u["phrase"]) != u["negated"]
        joined = F.when(u["alternative"] & ~acc["first"], acc["last"] | hit).otherwise(hit)
        done = F.when(u["alternative"] | acc["first"], acc["all"]).otherwise(acc["all"] & acc["last"])
        return F.struct(done.alias("all"), joined.alias("last"), F.lit(False).alias("first"))

    return F.aggregate(units, start, step, lambda acc: acc["all"] & acc["last"])


def _grouped(units: Column) -> Column:
    """array<struct<group, negated, phrase>>: units that are alternatives of each other have one group."""
    number = lambda i: F.size(F.filter(F.slice(units, 1, i + 1), lambda u: ~u["alternative"]))
    return F.transform(units, lambda u, i: F.struct(number(i).alias("group"), u["negated"].alias("negated"), u["phrase"].alias("phrase")))


def meeting_words(variants: DataFrame, hits: DataFrame) -> DataFrame:
    """question_id, turn, institution_id, language, word: the words on which each variant meets chunks.

    Of the groups that must all match, the one with the fewest hits is met; of a phrase, its rarest word. ``variants`` have
    units, ``hits`` one row for each (institution_id, language, word, chunk). A variant with a negation in every group has no word.
    """
    place = ["institution_id", "language"]
    flat = variants.select(*place, "question_id", "turn", F.posexplode(_grouped(F.col("units"))).alias("unit", "u")).select(*place, "question_id", "turn", "unit", "u.*")
    owner = ["question_id", "turn"]
    open_ = flat.groupBy(*owner, "group").agg(F.max("negated").alias("no")).filter("NOT no").drop("no")
    words = flat.join(open_, [*owner, "group"]).withColumn("word", F.explode(F.array_distinct("phrase"))).filter("word <> ''")
    counts = hits.groupBy(*place, "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = words.join(counts, [*place, "word"], "left").groupBy(*place, *owner, "group", "unit").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rarest"))
    best = rarest.groupBy(*owner, "group").agg(F.sum("rarest.n").alias("cost")).groupBy(*owner).agg(F.min(F.struct("cost", "group")).alias("best"))
    chosen = rarest.join(best.select(*owner, F.col("best.group").alias("group")), [*owner, "group"])
    return chosen.select(*place, *owner, F.col("rarest.word").alias("word")).distinct()


def match_candidates(variants: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, turn, chunk_id, document_id, chunk_index of the pairs that match.

    A variant in which every group has a negation meets every chunk of its institution and language, as it asks for. Variants
    with ``units`` are matched by these, else by their parsed input.
    """
    place, owner, ids = ["institution_id", "language"], ["question_id", "turn"], ["chunk_id", "document_id", "chunk_index"]
    units = F.col("units") if "units" in variants.columns else parse_websearch(F.col("input"))
    asked = variants.select(*place, *owner, units.alias("units")).filter(F.size("units") > 0)
    words = asked.select(*place, F.explode(F.flatten(F.transform("units", lambda u: u["phrase"]))).alias("word")).filter("word <> ''").distinct()
    hits = chunks.select(*place, *ids, F.explode(F.array_distinct("words")).alias("word")).join(words, [*place, "word"], "left_semi")
    meet = meeting_words(asked, hits)
    found = hits.join(meet, [*place, "word"]).select(*owner, *ids).distinct()
    found = found.unionByName(chunks.select(*place, *ids).join(asked.join(meet, owner, "left_anti"), place).select(*owner, *ids))
    simple = F.forall("units", lambda u: ~u["negated"] & (F.size(u["phrase"]) == 1)) & F.forall(F.slice("units", 2, 1000), lambda u: u["alternative"])
    plain = found.join(asked.filter(simple).select(*owner), owner, "left_semi")  # alternatives of single words: met is matched
    tested = found.join(asked.filter(~simple).select(*owner, "units"), owner).join(chunks.select("chunk_id", "words"), "chunk_id")
    return plain.unionByName(tested.filter(matches(F.col("words"), F.col("units"))).select(*owner, *ids))


def with_arrays(pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs with everything known of their question and their chunk."""
    own = [c for c in chunks.columns if c not in ("institution_id", "language", "document_id", "chunk_index")]
    return pairs.join(questions.drop("turn", "strategy", "priority", "input", "quota"), "question_id").join(chunks.select(*own), "chunk_id")


# ---- what a match is worth --------------------------------------------------------------------------------------


def places_of_terms(pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_id, term (its number), position of every place of a question's terms in the chunks it is paired with."""
    both = pairs.select("question_id", "chunk_id").distinct().join(questions.select("question_id", "terms"), "question_id")
    held = both.join(chunks.select("chunk_id", "keys", "positions"), "chunk_id")
    found = F.filter(F.arrays_zip("keys", "positions"), lambda p: F.array_contains("terms", p["keys"]))
    numbered = F.transform(found, lambda p: F.struct((F.array_position("terms", p["keys"]) - 1).cast("int").alias("term"), p["positions"].alias("position")))
    return held.select("question_id", "chunk_id", F.explode(numbered).alias("p")).select("question_id", "chunk_id", "p.term", "p.position")


def joint_pairs(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id, chunk_id where the chunk, of the question's institution and language, has the question's rarest term."""
    needles = questions.select("question_id", F.col("institution_id").alias("__i"), F.col("language").alias("__l"), F.col("terms").alias("words"))
    texts = chunks.select("chunk_id", "institution_id", "language", F.col("keys").alias("words"))
    met = rarest_meetings(needles, ["question_id", "__i", "__l"], texts, ["chunk_id", "institution_id", "language"])
    return met.filter("__i = institution_id AND __l = language").select("question_id", "chunk_id")


def term_worth(places: DataFrame) -> DataFrame:
    """question_id, chunk_id, raw_score of alternatives: each place that holds a term is a cover by itself and worth a tenth."""
    return places.groupBy("question_id", "chunk_id").agg((F.count(F.lit(1)) / F.lit(10.0)).alias("raw_score"))


def cover_worth(places: DataFrame, questions: DataFrame) -> DataFrame:
    """question_id, chunk_id, raw_score of conjunctions by cover density.

    A cover is a shortest stretch that holds every term: for each place, it begins at the latest place that still has all
    terms behind it; of stretches with one beginning the shortest counts. A cover is worth a tenth, divided by one more
    than the words in it that are no term.
    """
    pair = ["question_id", "chunk_id"]
    rows = places.join(questions.select("question_id", F.size("terms").alias("n")), "question_id")
    so_far = Window.partitionBy(*pair).orderBy("position").rangeBetween(Window.unboundedPreceding, 0)
    last = [F.max(F.when(F.col("term") == k, F.col("position"))).over(so_far) for k in range(lx.MAX_TERMS)]
    whole = F.forall(F.array(*(F.coalesce(x.isNotNull(), F.lit(False)) | (F.lit(k) >= F.col("n")) for k, x in enumerate(last))), lambda b: b)
    ends = rows.withColumns({"start": F.least(*last), "whole": whole, "upto": F.count(F.lit(1)).over(so_far)}).filter("whole")
    covers = ends.groupBy(*pair, "start").agg(F.min("position").alias("stop"), F.min("upto").alias("upto"))
    before = rows.groupBy(*pair, "position").agg(F.count(F.lit(1)).alias("here"), F.min("n").alias("n")).withColumn("upto_start", F.sum("here").over(so_far))
    opened = covers.join(before.select(*pair, F.col("position").alias("start"), "here", "upto_start"), [*pair, "start"])
    inside = F.col("upto") - F.col("upto_start") + F.col("here")
    noise = F.greatest(F.lit(0), F.col("stop") - F.col("start") - (inside - 1))
    return opened.groupBy(*pair).agg(F.sum(F.lit(0.1) / (F.lit(1) + noise)).alias("raw_score"))


CONJUNCTIVE = ("exact", "reduced_and", "canonical_relaxed_and")


def scored(pairs: DataFrame, variants: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pairs with strategy, priority, quota and raw_score: cover density for conjunctions, places for alternatives."""
    told = pairs.join(variants.select("question_id", "turn", "strategy", "priority", "quota"), ["question_id", "turn"])
    questions = variants.select("question_id", "institution_id", "language", "terms").dropDuplicates(["question_id"])
    places = places_of_terms(told, questions, chunks)
    both = ["question_id", "chunk_id"]
    conjunctive = F.col("strategy").isin(*CONJUNCTIVE)
    joint = told.filter(conjunctive).select(*both).distinct()
    covers = cover_worth(places.join(joint, both, "left_semi"), questions)
    apart = told.filter(~conjunctive).join(term_worth(places), both, "left")
    rows = told.filter(conjunctive).join(covers, both, "left").unionByName(apart)
    return rows.withColumn("raw_score", F.coalesce("raw_score", F.lit(0.0)))


def take_quota(pairs: DataFrame) -> DataFrame:
    """The best rows of each variant within its quota."""
    best = Window.partitionBy("question_id", "turn").orderBy(F.desc("raw_score"), "document_id", "chunk_index", "chunk_id")
    return pairs.withColumn("variant_rank", F.row_number().over(best)).filter(F.col("variant_rank") <= F.col("quota"))


def merge_variants(taken: DataFrame) -> DataFrame:
    """One row for each question and chunk: best strategy, largest raw score."""
    return taken.groupBy("question_id", "chunk_id", "document_id", "chunk_index").agg(
        F.max_by("strategy", "priority").alias("strategy"), F.max("priority").alias("priority"), F.max("raw_score").alias("raw_score")
    )


# ---- features, eligibility, score ---------------------------------------------------------------------------


def overlap(terms: Column, keys: Column) -> Column:
    return F.when(F.size(terms) > 0, F.size(F.array_intersect(terms, keys)) / F.size(terms)).otherwise(0.0)


def content_match(terms: Column, keys: Column, positions: Column, stream: Column) -> dict[str, Column]:
    """coverage, n_matched, exact_phrase, ordered, proximity, compactness of a text for question terms."""
    n = F.size(terms)
    matched = F.array_intersect(terms, keys)
    coverage = overlap(terms, keys)
    places = F.transform(terms, lambda t: first_position(keys, positions, t))
    steps = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    in_order = F.size(F.filter(steps, lambda i: F.coalesce(F.get(places, i - 1) < F.get(places, i), F.lit(False))))
    distinct = F.array_distinct(F.array_compact(places))
    m = F.size(distinct)
    compactness = F.when(m == 0, 0.0).when(m == 1, 1.0).otherwise(m / (F.array_max(distinct) - F.array_min(distinct) + 1))
    return {
        "n_terms": n,
        "n_matched": F.size(matched),
        "coverage": coverage,
        "exact_phrase": F.when(n >= 2, has_phrase(stream, terms)).otherwise(coverage > 0).cast("double"),
        "ordered": F.when(n < 2, 1.0).otherwise(in_order / (n - 1)),
        "proximity": F.when((n == 0) | (m == 0), 0.0).otherwise(m / n * compactness),
        "compactness": F.when(n == 0, 0.0).otherwise(compactness),
    }


def eligibility(terms: Column, keys: Column, n_matched: Column, coverage: Column, exact_phrase: Column, strategy: Column, explicit: Column) -> Column:
    """Why a pair is evidence, or why not (reasons: no_content_match, insufficient_coverage). First rule that fits."""
    n = F.size(terms)
    marker = lambda t: t.startswith("ord:") | t.startswith("rng:")
    markers, context = F.filter(terms, marker), F.filter(terms, lambda t: ~marker(t))
    relaxed = (F.size(markers) > 0) & (F.size(context) > 0) & F.forall(context, lambda t: F.array_contains(keys, t)) & F.arrays_overlap(markers, keys)
    required = F.greatest(F.lit(MIN_MATCHED), F.ceil(n * F.lit(MIN_COVERAGE)))
    return (
        F.when(n == 0, "no_content_match")
        .when((n == 1) & (n_matched > 0), "single_term_surface")
        .when(n == 1, "single_term_fts")
        .when(n_matched == 0, "no_content_match")
        .when(explicit & (strategy == "exact"), "explicit_syntax")
        .when(exact_phrase >= 1.0, "exact_phrase")
        .when(strategy.isin("exact", "reduced_and"), "conjunctive_strategy")
        .when((strategy == "canonical_relaxed_and") & relaxed, "canonical_relaxed")
        .when((n_matched >= required) & (coverage >= MIN_COVERAGE), "coverage")
        .otherwise("insufficient_coverage")
    )


REASONS = ("no_content_match", "insufficient_coverage", "below_threshold")


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum of the signal columns in the order of ``weights``, held in 0..1."""
    signals = {name: F.col(name) for name in weights if name != "fts"}
    signals["fts"] = F.col("fts_norm") * F.col("length_factor")
    total = None
    for name, weight in weights.items():
        part = F.lit(weight) * signals[name]
        total = part if total is None else total + part
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def features(pairs: DataFrame) -> DataFrame:
    """Adds all nine signals, the decision and the score; expects what ``merge_variants`` returns."""
    c = F.col
    rows = pairs.withColumns(content_match(c("terms"), c("keys"), c("positions"), c("stream")))
    lang = c("language")
    side = lambda text: F.transform(place_keys(lx.tokens(normalize_text(F.coalesce(text, F.lit(""))), lang)), lambda k: k["key"])
    raw = F.greatest(c("raw_score"), F.lit(0.0))
    rows = rows.withColumns(
        {
            "title_overlap": overlap(c("terms"), side(c("title"))),
            "section_overlap": overlap(c("terms"), side(c("section_title"))),
            "table_row_bonus": ((c("structure_type") == "table_row") & (c("coverage") >= 0.5) & (c("compactness") >= 0.5)).cast("double"),
            "fts_norm": raw / (raw + F.lit(SATURATION)),
            "length_factor": F.lit(float(SOFT_LENGTH)) / F.greatest(F.length("content"), F.lit(SOFT_LENGTH)),
            "strategy_quality": c("priority") / F.lit(4.0),
            "decision": eligibility(c("terms"), c("keys"), c("n_matched"), c("coverage"), c("exact_phrase"), c("strategy"), c("explicit")),
        }
    )
    return rows.withColumn("score", composite())


def decide(rows: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Adds status: kept, or the reason of exclusion."""
    status = F.when(F.col("decision").isin(*REASONS), F.col("decision")).when(F.col("score") < min_score, "below_threshold").otherwise("kept")
    return rows.withColumn("status", status)


def total_order(partition: str = "question_id"):
    return Window.partitionBy(partition).orderBy(
        F.desc("score"), F.desc("coverage"), F.desc("strategy_quality"), F.desc("raw_score"), F.col("document_id").cast("string"), "chunk_index", F.col("chunk_id").cast("string")
    )


def ranked(rows: DataFrame, top_k: int) -> DataFrame:
    """Kept rows within the top k of their question, with rank."""
    return rows.filter("status = 'kept'").withColumn("rank", F.row_number().over(total_order())).filter(F.col("rank") <= top_k)


def candidates(questions: DataFrame, variants: DataFrame, index: DataFrame) -> DataFrame:
    """Decided candidates of every question: the table that ranking, traces and experiments share.

    ``questions`` are analysed, ``variants`` their planned variants, ``index`` analysed chunks. Each is read several times
    (chunks for words, for places and for arrays), so all three should be stored tables.
    """
    merged = merge_variants(take_quota(scored(match_candidates(variants, index), variants, index)))
    return decide(features(with_arrays(merged, questions, index)))


def trace(rows: DataFrame) -> DataFrame:
    """Counts of each question: candidates by strategy, kept, and excluded by reason; the parts add up."""
    count = lambda cond: F.count_if(cond)
    return rows.groupBy("question_id").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        count(F.col("status") == "kept").alias("n_kept"),
        *(count(F.col("status") == r).alias(f"n_{r}") for r in REASONS),
        *(count(F.col("strategy") == s).alias(f"n_{s}") for s in lx.PRIORITY),
    )


def reason_text(rows: DataFrame) -> DataFrame:
    """Adds a line that explains a score."""
    text = F.format_string("%s; coverage %.2f; proximity %.2f; score %.4f", "decision", "coverage", "proximity", "score")
    return rows.withColumn("reason", text)
