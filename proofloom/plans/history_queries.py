"""Queries of what happens to tables over time: versions after their attempts, drift between two runs, restored diacritics."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofloom.operators import digest_tree, restoration
from proofloom.plans.declare import query
from proofloom.sources import tables
from proofloom.sources.stored import stored
from proofloom.streaming import versions


def version_events(spark, sf_dir):
    """The log of all documents: each is uploaded, every fourth a second time; some files break at first, some are cited before they are tried again."""
    i = F.col("doc_id")
    numbers = F.when(i % 4 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = tables.scan(spark, sf_dir, "documents").select("doc_id", "text", F.explode(numbers).alias("n"))
    version = i * 10 + F.col("n")
    steps = {"upload": F.lit(True), "reference": i % 5 == 0, "retry": i % 3 == 0}
    kinds = F.array_compact(F.array(*(F.when(where, F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"))) for at, (kind, where) in enumerate(steps.items()))))
    log = rows.withColumn("version_id", version).withColumn("step", F.explode(kinds))
    broken = (F.col("step.kind") == "upload") & (F.col("version_id") % 7 == 0)
    return log.select(
        (F.col("version_id") * 10 + F.col("step.at")).alias("event_id"), "step.kind", F.concat(F.lit("i"), (i % 2).cast("string")).alias("institution_id"), i.alias("document_id"), "version_id",
        F.when(~broken & (F.col("step.kind") != "reference"), F.col("text")).alias("content"), F.when(broken, "unreadable_file").alias("error"),
    )


_BLANK = r"NOT regexp_matches(text, '[\p{L}\p{N}]')"


@query(f"""WITH u AS (SELECT doc_id * 10 + n AS version_id, doc_id, 'i' || (doc_id % 2) AS institution_id, text, (doc_id * 10 + n) % 7 = 0 AS broken FROM documents, (VALUES (1), (2)) v(n) WHERE n = 1 OR doc_id % 4 = 0),
  f AS (SELECT *, row_number() OVER (PARTITION BY institution_id, CASE WHEN broken OR text IS NULL THEN version_id::VARCHAR END, CASE WHEN NOT broken THEN text END ORDER BY version_id) = 1 AS taken FROM u),
  s AS (SELECT *, doc_id % 3 = 0 AS again, doc_id % 5 = 0 AS cited FROM f),
  r AS (SELECT *, CASE WHEN again AND NOT cited THEN CASE WHEN text IS NULL THEN 'unreadable' WHEN {_BLANK} THEN 'blank_text' END
    ELSE CASE WHEN broken THEN 'unreadable_file' WHEN text IS NULL THEN 'unreadable' WHEN {_BLANK} THEN 'blank_text' END END AS why FROM s)
  SELECT institution_id, version_id, CASE WHEN NOT taken THEN 'duplicate' WHEN why IS NULL THEN 'processed' ELSE 'failed' END AS status, CASE WHEN taken THEN why END AS reason,
    (CASE WHEN NOT taken THEN 0 WHEN again AND NOT cited THEN 2 ELSE 1 END)::INTEGER AS attempts, (CASE WHEN taken AND again AND cited THEN 1 ELSE 0 END)::INTEGER AS n_refused, CASE WHEN taken AND why IS NULL THEN sha256(text) END AS text_sha256 FROM r""")
def version_states(spark, sf_dir):
    """Every version of every document after its uploads, citations and attempts."""
    return versions.states(version_events(spark, sf_dir))


def _two_runs(spark, sf_dir):
    """Placed rows of the documents, and of a later run: other times throughout, some texts cut, some documents gone, some new."""
    i = F.col("doc_id")
    docs = tables.scan(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    before = docs.withColumn("run_at", F.lit("monday"))
    later = docs.filter(i % 89 != 0).withColumns({"text": F.when(i % 97 == 0, F.concat(F.lit("cut "), F.col("text"))).otherwise(F.col("text")), "run_at": F.lit("friday")})
    new = docs.filter(i % 101 == 0).withColumns({"doc_id": -i - 1, "run_at": F.lit("friday")})
    return [stored(digest_tree.placed(run, ["doc_id"], ["run_at"])) for run in (before, later.unionByName(new))]


@query("""SELECT doc_id AS document_id, CASE WHEN doc_id % 89 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM documents WHERE doc_id % 89 = 0 OR (doc_id % 97 = 0 AND text IS NOT NULL)
  UNION ALL SELECT -doc_id - 1, 'unexpected' FROM documents WHERE doc_id % 101 = 0""")
def run_drift(spark, sf_dir):
    """What a later run of the whole corpus changed, found by the tree of digests: times do not count."""
    before, after = _two_runs(spark, sf_dir)
    trees = [stored(digest_tree.tree(rows)) for rows in (before, after)]
    leaves = digest_tree.differing(*trees).filter(F.col("level") == digest_tree.DEPTH)
    return digest_tree.changes(before, after, leaves, ["doc_id"]).withColumnRenamed("doc_id", "document_id")


# ---- restored diacritics ----------------------------------------------------------------------------------------


def restored_pairs(spark, sf_dir):
    """Every text beside itself without marks, with claims of its marked words; some pairs and claims are wrong on purpose."""
    i = F.col("question_id")
    rows = tables.scan(spark, sf_dir, "documents").select(F.col("doc_id").alias("question_id"), F.coalesce("text", F.lit("")).alias("restored"))
    bare = rows.withColumn("original", restoration.stripped(F.col("restored")))
    marked = F.array_sort(F.array_distinct(F.transform("marked", lambda w: F.struct(w["accented"].alias("accented"), w["plain"].alias("plain")))))
    own = restoration.paired(bare).withColumn("own", marked)
    own = own.withColumn("own", F.when(i % 5 == 0, F.filter("own", lambda c, at: at > 0)).otherwise(F.col("own")))
    claim = lambda plain, accented: F.struct(F.lit(plain).alias("plain"), F.lit(accented).alias("accented"))
    false = F.array_compact(F.array(F.when(i % 7 == 0, claim("zzz", "zzź")), F.when(i % 11 == 0, claim("abcq", "abcq")), F.when(i % 17 == 0, claim("abdq", "ábcq"))))
    claims = F.concat(F.transform("own", lambda c: F.struct(c["plain"].alias("plain"), c["accented"].alias("accented"))), false)
    return own.select("question_id", F.when(i % 13 == 0, F.concat(F.lit("x "), F.col("original"))).otherwise(F.col("original")).alias("original"), "restored", claims.alias("claims"))


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+')"
_MARKED = f"""w AS (SELECT doc_id, unnest({_WORDS}) AS word FROM documents WHERE doc_id % 13 <> 0), m AS (SELECT doc_id, word, strip_accents(word) AS plain FROM w WHERE strip_accents(word) <> word)"""


@query(f"WITH {_MARKED} SELECT plain, word AS accented, count(*) AS n_places, count(DISTINCT doc_id) AS n_questions FROM m GROUP BY ALL")
def restored_words(spark, sf_dir):
    """Which words were restored to which, with the number of places and texts."""
    return restoration.restored_words(restored_pairs(spark, sf_dir))


@query(f"""WITH {_MARKED} SELECT doc_id AS question_id, 'undeclared' AS problem, min(word) AS word FROM m WHERE doc_id % 5 = 0 GROUP BY doc_id
  UNION ALL SELECT doc_id, 'reworded', NULL FROM documents WHERE doc_id % 13 = 0
  UNION ALL SELECT doc_id, unnest(p), word FROM documents, (VALUES (7, 'zzź', ['not_in_text']), (11, 'abcq', ['nothing_restored', 'not_in_text']), (17, 'ábcq', ['not_a_restoration', 'not_in_text'])) v(k, word, p) WHERE doc_id % k = 0 AND doc_id % 13 <> 0""")
def restoration_problems(spark, sf_dir):
    """False, empty, absent and missing claims of restored words, and pairs that differ in more than marks."""
    return restoration.claim_problems(restored_pairs(spark, sf_dir))
