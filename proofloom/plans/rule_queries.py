"""Queries of field rules, sources, rebuilding, scoping, decisions and analyses over the bundled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import json_paths, lexical, stems
from proofloom.functions import text as tx
from proofloom.operators import admissibility, answering, contracts, dense, diagnostics, fusion, metrics, rebuild, retrieval, rules, statistics
from proofloom.plans.declare import query
from proofloom.plans.measure_queries import _A, _B, _DECIDED, _GRID, _MEASURES, _SIGNALS, LISTS, _fact_sql, _facts, _per, exact, halved, judged, presence, signals
from proofloom.plans.search_queries import TOP_K, decided, search_chunks, vectors
from proofloom.plans.views import EN
from proofloom.sources import files, tables

# ---- sources ------------------------------------------------------------------------------------------------


@query(r"""WITH f AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN ' ' || chr(10) ELSE html END AS body FROM pages)
  SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 'not_utf8' WHEN length(regexp_replace(body, '\s', '', 'g')) = 0 THEN 'blank_text' END AS extraction_error,
    CASE WHEN page_id % 11 <> 0 AND length(regexp_replace(body, '\s', '', 'g')) > 0 THEN sha256(body) END AS text_sha256 FROM f""")
def plain_text_source(spark, sf_dir):
    """Pages as uploaded text files: every third with a byte order mark, some not UTF-8, some blank."""
    i = F.col("page_id")
    body = F.when(i % 7 == 0, F.lit(" \n")).otherwise(F.col("html"))
    marked = F.when(i % 3 == 0, F.concat(F.lit("﻿"), body)).otherwise(body).cast("binary")
    rows = tables.scan(spark, sf_dir, "pages").select("page_id", F.when(i % 11 == 0, F.unhex(F.lit("C328FF"))).otherwise(marked).alias("content"))
    return files.decode_text(rows).select("page_id", "extraction_error", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT p_partkey AS part_id, round(least(300 / 72.0::DOUBLE, sqrt(25000000.0::DOUBLE / greatest(1.0::DOUBLE, p_size * 100.0::DOUBLE * (p_size * 50.0::DOUBLE)))), 9) AS scale FROM part""")
def render_scales(spark, sf_dir):
    size = F.col("p_size")
    return tables.scan(spark, sf_dir, "part").select(F.col("p_partkey").alias("part_id"), F.round(files.render_scale(size * F.lit(100.0), size * F.lit(50.0)), 9).alias("scale"))


_PAGES = """pg AS (SELECT doc_id AS document_id, chunk_index + 1 AS page_number, trim(line) AS body, chunk_index % 4 = 1 AS visual,
    (doc_id * 7 + chunk_index * 13) % 100 AS confidence FROM linesof),
  m AS (SELECT *, CASE WHEN length(regexp_replace(body, '\\s', '', 'g')) >= 40 THEN 'native' WHEN visual THEN 'ocr' ELSE 'empty' END AS method FROM pg),
  x AS (SELECT *, CASE method WHEN 'native' THEN 'high' WHEN 'empty' THEN 'empty' ELSE CASE WHEN length(body) = 0 THEN 'empty' WHEN confidence >= 80 THEN 'high' WHEN confidence >= 60 THEN 'medium' ELSE 'low' END END AS quality FROM m)"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of each document as pages with a drawn area here and there and a confidence."""
    flat = tables.scan(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    rows = flat.select(
        F.col("doc_id").alias("document_id"), (F.col("place") + 1).cast("long").alias("page_number"), F.trim("line").alias("text"), (F.col("place") % 4 == 1).alias("visual"),
        ((F.col("doc_id") * 7 + F.col("place") * 13) % 100).cast("double").alias("ocr_confidence"),
    )
    rows = rows.withColumns({"method": files.page_method(F.col("text"), F.col("visual")), "extracted_characters": F.length("text")})
    return files.page_quality(rows)


@query(f"WITH {_PAGES} SELECT document_id, page_number, method, quality FROM x")
def page_methods(spark, sf_dir):
    return _pages(spark, sf_dir).select("document_id", "page_number", "method", "quality")


@query(f"""WITH {_PAGES}, q AS (SELECT document_id, count(*) AS page_count, count_if(method = 'native') AS n_native, count_if(method = 'ocr') AS n_ocr, count_if(method = 'empty') AS n_empty,
    max(CASE quality WHEN 'high' THEN 0 WHEN 'medium' THEN 1 WHEN 'low' THEN 2 ELSE -1 END) AS worst FROM x GROUP BY document_id)
  SELECT document_id, page_count, n_native, n_ocr, n_empty, CASE WHEN n_native > 0 AND n_ocr > 0 THEN 'mixed' WHEN n_native > 0 THEN 'native' WHEN n_ocr > 0 THEN 'ocr' ELSE 'empty' END AS extraction_method,
    CASE worst WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'empty' END AS extraction_quality FROM q""")
def extraction_summary(spark, sf_dir):
    """Method and worst quality of each document over its pages."""
    rows = files.document_extraction(_pages(spark, sf_dir))
    return rows.select("document_id", "page_count", "n_native", "n_ocr", "n_empty", "extraction_method", "extraction_quality")


@query("""WITH c AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN upper(lang) || '_BR' WHEN 1 THEN ' ' || lang || '-x' WHEN 2 THEN lang ELSE 'xx' END AS code FROM documents)
  SELECT doc_id, CASE split_part(replace(lower(trim(code)), '_', '-'), '-', 1) WHEN 'pt' THEN 'por' WHEN 'en' THEN 'eng' WHEN 'es' THEN 'spa' WHEN 'fr' THEN 'fra' WHEN 'de' THEN 'deu' ELSE 'eng' END AS ocr_language,
    CASE split_part(replace(lower(trim(code)), '_', '-'), '-', 1) WHEN 'pt' THEN 'portuguese' WHEN 'en' THEN 'english' ELSE 'simple' END AS fts_configuration FROM c""")
def language_configurations(spark, sf_dir):
    """Recogniser language and text-search configuration of odd spellings of a document's language."""
    i, lang = F.col("doc_id"), F.col("lang")
    code = F.when(i % 4 == 0, F.concat(F.upper(lang), F.lit("_BR"))).when(i % 4 == 1, F.concat(F.lit(" "), lang, F.lit("-x"))).when(i % 4 == 2, lang).otherwise("xx")
    rows = tables.scan(spark, sf_dir, "documents").select("doc_id", code.alias("code"))
    return rows.select("doc_id", files.ocr_language(F.col("code")).alias("ocr_language"), F.coalesce(lexical.fts_configuration(F.col("code")), F.lit("simple")).alias("fts_configuration"))


@query("""WITH old AS (SELECT version_id, chunk_index, content FROM chunks), gone AS (SELECT version_id FROM vers WHERE version_id % 3 = 0),
  fresh AS (SELECT version_id, chunk_index, 'anew: ' || content AS content FROM chunks WHERE chunk_index % 2 = 0)
  SELECT version_id, chunk_index, content FROM old WHERE version_id NOT IN (SELECT version_id FROM gone)
  UNION ALL SELECT version_id, chunk_index, content FROM fresh WHERE version_id IN (SELECT version_id FROM gone) AND version_id % 9 <> 0""")
def chunk_replacement(spark, sf_dir):
    """Chunks after every third version was chunked anew, and every ninth lost its chunks."""
    old = tables.chunks(spark, sf_dir).select("version_id", "chunk_index", "content")
    gone = tables.versions(spark, sf_dir).filter("version_id % 3 = 0").select("version_id")
    fresh = old.filter("chunk_index % 2 = 0 AND version_id % 9 <> 0").withColumn("content", F.concat(F.lit("anew: "), "content"))
    return rebuild.listed(rebuild.replaced(old, fresh, gone)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@query("""WITH v AS (SELECT v.*, CASE WHEN v.document_id % 13 = 0 THEN ' ' ELSE d.text END AS body FROM vers v JOIN docs d USING (document_id)),
  o AS (SELECT *, CASE WHEN version_id % 5 = 0 THEN 'skipped_cited' WHEN processing_status <> 'processed' THEN 'skipped_unprocessed' WHEN trim(body) = '' THEN 'skipped_blank' ELSE 'rebuilt' END AS outcome FROM v),
  n AS (SELECT version_id, count(*) AS k FROM (SELECT version_id, unnest(string_split(body, chr(10))) AS line FROM o WHERE outcome = 'rebuilt') WHERE trim(line) <> '' GROUP BY version_id)
  SELECT outcome, count(*) AS n_versions, coalesce(sum(k), 0)::BIGINT AS n_chunks FROM o LEFT JOIN n USING (version_id) GROUP BY outcome""")
def rebuild_counters(spark, sf_dir):
    """Outcomes of rebuilding all versions from their texts; every fifth is cited, some texts are blank."""
    texts = tables.documents(spark, sf_dir).select("document_id", F.when(F.col("document_id") % 13 == 0, " ").otherwise(F.col("text")).alias("text"))
    versions = tables.versions(spark, sf_dir).join(texts, "document_id")

    def by_line(rows: DataFrame) -> DataFrame:
        return rows.select("version_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.trim("line") != "")

    fresh, outcomes = rebuild.rebuild(versions, versions.filter("version_id % 5 = 0"), by_line)
    return rebuild.rebuild_counts(outcomes, fresh)


@query("""WITH frozen AS (SELECT DISTINCT sha256(text) AS text_sha256 FROM documents WHERE doc_id % 3 <> 0)
  SELECT doc_id, CASE WHEN f.text_sha256 IS NULL THEN 'missing' ELSE 'frozen' END AS state FROM documents d LEFT JOIN frozen f ON f.text_sha256 = sha256(d.text)""")
def frozen_vectors(spark, sf_dir):
    """Texts whose vector was kept under the digest of the text, and texts without one."""
    docs = tables.scan(spark, sf_dir, "documents").select("doc_id", "text")
    kept = docs.filter("doc_id % 3 <> 0").select(F.sha2("text", 256).alias("text_sha256")).distinct()
    found = dense.frozen_vectors(docs, kept).select("doc_id", F.lit("frozen").alias("state"))
    return found.unionByName(dense.missing_vectors(docs, kept).select("doc_id", F.lit("missing").alias("state")))


# ---- fields and texts -----------------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN ' EN_us ' WHEN 1 THEN 'x' WHEN 2 THEN NULL WHEN 3 THEN 'FR' ELSE 'pt-br' END AS code FROM documents),
  n AS (SELECT *, replace(lower(trim(code)), '_', '-') AS plain FROM c)
  SELECT doc_id, CASE WHEN length(plain) BETWEEN 2 AND 8 THEN plain END AS code, CASE WHEN code IS NULL THEN 'en' WHEN plain IN ('en-us', 'fr', 'en') THEN plain END AS resolved,
    length(regexp_replace(text, '\s', '', 'g'))::BIGINT AS useful_characters FROM n""")
def language_codes(spark, sf_dir):
    i = F.col("doc_id")
    code = F.when(i % 5 == 0, " EN_us ").when(i % 5 == 1, "x").when(i % 5 == 3, "FR").when(i % 5 == 4, "pt-br")
    rows = tables.scan(spark, sf_dir, "documents").withColumn("code", code)
    supported = F.array(F.lit("en-us"), F.lit("fr"), F.lit("en"))
    return rows.select("doc_id", tx.normalize_language(F.col("code")).alias("code"), tx.resolve_language(F.col("code"), F.lit("en"), supported).alias("resolved"), tx.useful_characters(F.col("text")).cast("long").alias("useful_characters"))


@query(r"""SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\s+', ' ', 'g')) AS literal, strip_accents(text) AS stripped FROM documents""")
def literal_and_stripped(spark, sf_dir):
    """Texts with blanks collapsed in lower case, and texts without marks in their own case."""
    c = F.col("text")
    return tables.scan(spark, sf_dir, "documents").select("doc_id", tx.normalize_literal(c).alias("literal"), tx.strip_diacritics(c).alias("stripped"))


@query(r"""SELECT doc_id, regexp_replace(substr(text, 11, 120), '[\r\n\f\t]', ' ', 'g') AS excerpt, (length(substr(replaced, 1, 400)) - length(replace(substr(replaced, 1, 400), chr(12), '')) + 1)::INTEGER AS page_number
  FROM (SELECT *, replace(text, '. ', '.' || chr(12)) AS replaced FROM documents)""")
def excerpts(spark, sf_dir):
    """A slice of each text without line marks, and the page of its character 400 where sentences are pages."""
    paged = F.replace(F.col("text"), F.lit(". "), F.lit(".\f"))
    rows = tables.scan(spark, sf_dir, "documents").withColumn("paged", paged)
    return rows.select("doc_id", tx.excerpt(F.col("text"), 10, 120).alias("excerpt"), tx.page_number(F.col("paged"), F.lit(400)).alias("page_number"))


@query(r"""WITH f AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN '  ' ELSE docs.title END AS title, CASE doc_id % 4 WHEN 0 THEN 'ftp://a.example/x' WHEN 1 THEN ' HTTPS://a.example/y ' WHEN 2 THEN NULL ELSE 'http://b.example/' || repeat('z', 2100) END AS url,
    CASE doc_id % 3 WHEN 0 THEN ['EN', 'en ', 'fr'] WHEN 1 THEN ['pt_BR', 'x'] ELSE []::VARCHAR[] END AS langs, valid_from, valid_until FROM documents JOIN docs ON document_id = doc_id),
  n AS (SELECT *, trim(title, ' ') AS t, trim(url) AS u FROM f)
  SELECT doc_id, CASE WHEN t = '' THEN 'blank' WHEN length(t) > 255 THEN 'too_long' END AS title_problem, CASE WHEN t <> '' AND length(t) <= 255 THEN t END AS title,
    CASE WHEN NOT regexp_matches(lower(u), '^https?://') THEN 'not_http' WHEN length(u) > 2048 THEN 'too_long' END AS url_problem,
    CASE doc_id % 3 WHEN 1 THEN 'bad_code' WHEN 2 THEN 'empty' END AS languages_problem, CASE doc_id % 3 WHEN 0 THEN 'en,fr' END AS languages,
    CASE WHEN valid_from > valid_until THEN 'ends_before_it_starts' END AS validity_problem FROM n""")
def document_fields(spark, sf_dir):
    """Title, address, languages and validity of each document, normalised or refused."""
    i = F.col("document_id")
    rows = tables.documents(spark, sf_dir).withColumns(
        {
            "title": F.when(i % 6 == 0, "  ").otherwise(F.col("title")),
            "url": F.when(i % 4 == 0, "ftp://a.example/x").when(i % 4 == 1, " HTTPS://a.example/y ").when(i % 4 == 3, F.concat(F.lit("http://b.example/"), F.repeat(F.lit("z"), 2100))),
            "langs": F.when(i % 3 == 0, F.array(F.lit("EN"), F.lit("en "), F.lit("fr"))).when(i % 3 == 1, F.array(F.lit("pt_BR"), F.lit("x"))).otherwise(F.expr("cast(array() as array<string>)")),
        }
    )
    rows = rows.withColumns({"t": rules.required_text(F.col("title"), rules.TITLE_CHARS), "u": rules.source_url(F.col("url")), "l": rules.language_list(F.col("langs"))})
    return rows.select(
        i.alias("doc_id"), F.col("t.problem").alias("title_problem"), F.col("t.value").alias("title"), F.col("u.problem").alias("url_problem"), F.col("l.problem").alias("languages_problem"),
        F.array_join("l.value", ",").alias("languages"), rules.validity_problem(F.col("valid_from"), F.col("valid_until")).alias("validity_problem"),
    )


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN 'Desk' END AS name, CASE c_custkey % 4 WHEN 1 THEN 'a@b.example' WHEN 2 THEN 'nobody' END AS email, CASE WHEN c_custkey % 5 = 0 THEN 'https://x.example' END AS url FROM customer)
  SELECT id, CASE WHEN NOT (name IS NULL AND email IS NULL AND url IS NULL) AND (name IS NULL OR (email IS NULL AND url IS NULL)) THEN 'incomplete_contact' WHEN email = 'nobody' THEN 'bad_email' END AS problem FROM c""")
def support_contacts(spark, sf_dir):
    i = F.col("c_custkey")
    rows = tables.scan(spark, sf_dir, "customer").select(
        i.alias("id"), F.when(i % 3 > 0, "Desk").alias("name"), F.when(i % 4 == 1, "a@b.example").when(i % 4 == 2, "nobody").alias("email"), F.when(i % 5 == 0, "https://x.example").alias("url")
    )
    return rows.select("id", rules.support_problem(F.col("name"), F.col("email"), F.col("url")).alias("problem"))


@query("""SELECT event_id, '/a~1b/0' AS pointer, event_type AS value FROM events UNION ALL SELECT event_id, '/p~0q/k', 'k' || user_id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, '/a~1b/1/x', 'v' FROM events""")
def json_pointers(spark, sf_dir):
    """Every string of a nested JSON value with its pointer."""
    body = F.to_json(
        F.struct(
            F.expr("parse_json(concat('[\"', event_type, '\", {\"x\": \"v\", \"n\": 1}]'))").alias("a/b"),
            F.when(F.col("event_id") % 2 == 0, F.struct(F.concat(F.lit("k"), F.col("user_id").cast("string")).alias("k"), F.col("value").alias("w"))).alias("p~q"),
        )
    )
    return json_paths.json_strings(tables.scan(spark, sf_dir, "events").select("event_id", body.alias("body")), "event_id", "body")


# ---- scoping, selection, updates ------------------------------------------------------------------------------------


@query("""SELECT is_active, official_source, language, count(*) AS n FROM docs WHERE is_active AND NOT official_source AND language = 'de' GROUP BY ALL""")
def filtered_documents(spark, sf_dir):
    rows = admissibility.listed(tables.documents(spark, sf_dir), is_active=True, official_source=False, language="de")
    return rows.groupBy("is_active", "official_source", "language").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH held AS (SELECT document_id, CASE WHEN document_id % 3 = 0 THEN 'DOC-' ELSE 'Doc-' END || (document_id // 2 * 2 - CASE WHEN document_id % 10 = 1 THEN 2 ELSE 0 END)::VARCHAR || '.pdf' AS filename FROM docs),
  asked AS (SELECT 'doc-' || (item_id * 2)::VARCHAR || '.PDF' AS name FROM benchmark UNION SELECT 'none-' || item_id || '.pdf' FROM benchmark WHERE item_id % 9 = 0),
  n AS (SELECT lower(filename) AS k, min(document_id) AS one, max(document_id) AS other FROM held GROUP BY ALL)
  SELECT name, CASE WHEN one IS NULL THEN 'not_found' WHEN one <> other THEN 'ambiguous' ELSE 'found' END AS status, CASE WHEN one = other THEN one END AS document_id FROM asked LEFT JOIN n ON k = lower(name)""")
def filename_selection(spark, sf_dir):
    i, q = F.col("document_id"), F.col("item_id")
    number = F.floor(i / 2) * 2 - F.when(i % 10 == 1, 2).otherwise(0)
    held = tables.documents(spark, sf_dir).select("document_id", F.concat(F.when(i % 3 == 0, "DOC-").otherwise("Doc-"), number.cast("string"), F.lit(".pdf")).alias("filename"))
    items = tables.scan(spark, sf_dir, "benchmark")
    asked = items.select(F.concat(F.lit("doc-"), (q * 2).cast("string"), F.lit(".PDF")).alias("name"))
    asked = asked.unionByName(items.filter(q % 9 == 0).select(F.concat(F.lit("none-"), q.cast("string"), F.lit(".pdf")).alias("name"))).distinct()
    return rules.select_by_filename(asked, held)


_USERS = """users AS (SELECT s_suppkey AS user_id, 'i' || (s_suppkey % 2) AS institution_id, CASE WHEN s_suppkey % 5 = 0 THEN 'admin' ELSE 'member' END AS role, s_suppkey % 3 <> 0 AS is_active FROM supplier),
  convs AS (SELECT DISTINCT conv_id AS conversation_id, 'i' || (conv_id % 2) AS institution_id, conv_id % 10 AS owner_id, conv_id % 4 <> 0 AS is_active FROM conversations)"""


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("s_suppkey")
    return tables.scan(spark, sf_dir, "supplier").select(
        i.alias("user_id"), F.concat(F.lit("i"), (i % 2).cast("string")).alias("institution_id"), F.when(i % 5 == 0, "admin").otherwise("member").alias("role"), (i % 3 != 0).alias("is_active")
    )


def _conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("conv_id")
    rows = tables.scan(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select(i.alias("conversation_id"), F.concat(F.lit("i"), (i % 2).cast("string")).alias("institution_id"), (i % 10).alias("owner_id"), (i % 4 != 0).alias("is_active"))


@query(f"WITH {_USERS} SELECT user_id, conversation_id FROM users u JOIN convs c USING (institution_id) WHERE u.role = 'admin' OR owner_id = user_id")
def visible_conversations(spark, sf_dir):
    return rules.visible_conversations(_users(spark, sf_dir), _conversations(spark, sf_dir).drop("is_active"))


@query(f"""WITH {_USERS} SELECT message_id, CASE WHEN c.conversation_id IS NULL THEN 'no_conversation' WHEN NOT c.is_active THEN 'conversation_closed'
  WHEN m.conversation_id % 3 <> 0 AND m.role <> 'user' THEN 'role_not_allowed' ELSE 'accepted' END AS verdict FROM messages m LEFT JOIN (SELECT * FROM convs WHERE conversation_id % 7 <> 0) c USING (conversation_id)""")
def message_acceptance(spark, sf_dir):
    """Messages as if written now: by administrators in every third conversation, some conversations gone or closed."""
    rows = tables.messages(spark, sf_dir).withColumn("user_role", F.when(F.col("conversation_id") % 3 == 0, "admin").otherwise("member"))
    return rules.message_verdicts(rows, _conversations(spark, sf_dir).filter("conversation_id % 7 <> 0"))


@query("""WITH asked AS (SELECT document_id, CASE document_id % 4 WHEN 0 THEN 'EN' WHEN 1 THEN NULL ELSE 'fr' END AS asked FROM docs WHERE document_id % 2 = 0 OR document_id % 3 = 0)
  SELECT document_id, CASE WHEN coalesce(lower(asked), language) IS NOT DISTINCT FROM language THEN 'unchanged' WHEN EXISTS (SELECT 1 FROM vers v WHERE v.document_id = a.document_id AND v.version_number > 1) THEN 'language_locked' ELSE 'changed' END AS verdict
  FROM asked a JOIN docs d USING (document_id)""")
def language_changes(spark, sf_dir):
    i = F.col("document_id")
    docs = tables.documents(spark, sf_dir)
    asked = docs.filter((i % 2 == 0) | (i % 3 == 0)).select("document_id", F.when(i % 4 == 0, "EN").when(i % 4 == 1, None).otherwise("fr").alias("asked"))
    return rules.language_changes(asked, docs, tables.versions(spark, sf_dir).filter("version_number > 1"))


@query(f"""WITH {_USERS}, n AS (SELECT institution_id, count(*) AS n FROM users WHERE role = 'admin' AND is_active AND (institution_id <> 'i1' OR user_id = 5) GROUP BY ALL),
  u AS (SELECT *, CASE WHEN institution_id = 'i1' AND role = 'admin' AND user_id <> 5 THEN false ELSE is_active END AS live FROM users)
  SELECT user_id, CASE WHEN role = 'admin' AND user_id % 2 = 0 AND user_id % 4 = 0 THEN 'own_account'
    WHEN role = 'admin' AND coalesce(n, 0) - (CASE WHEN live THEN 1 ELSE 0 END) = 0 THEN 'last_admin' ELSE 'applied' END AS verdict FROM u LEFT JOIN n USING (institution_id)""")
def role_changes(spark, sf_dir):
    """Every user loses the role or is switched off; one institution has a single active administrator."""
    i = F.col("user_id")
    users = _users(spark, sf_dir)
    users = users.withColumn("is_active", F.when((F.col("institution_id") == "i1") & (F.col("role") == "admin") & (i != 5), False).otherwise(F.col("is_active")))
    changes = users.select("user_id", F.when(i % 4 == 0, i).otherwise(F.lit(-1)).alias("acting_id"), F.when(i % 2 == 1, "member").alias("new_role"), F.when(i % 2 == 0, False).alias("new_active"))
    return rules.role_changes(changes, users)


@query("SELECT item_id, d.doc_id AS document_id FROM benchmark b LEFT JOIN documents d ON d.doc_id = b.item_id * 3 AND d.doc_id % 4 <> 0")
def corpus_bindings(spark, sf_dir):
    """Items with the document that carries their key; those without one are what the guard raises on."""
    items = tables.scan(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") * 3).alias("key"))
    docs = tables.documents(spark, sf_dir).filter("document_id % 4 <> 0").select("document_id", F.col("document_id").alias("key"))
    bound, unbound = rules.bindings(items, docs, "key")
    return bound.select("item_id", "document_id").unionByName(unbound.select("item_id", F.lit(None).cast("long").alias("document_id")))


@query("""WITH r AS (SELECT document_id, 200 * k AS row_start, 200 * k + 120 AS row_end FROM docs, range(0, 3) t(k)), c AS (SELECT document_id, 90 * k AS a, 90 * k + 90 AS b FROM docs, range(0, 8) t(k) WHERE 90 * k < length(text))
  SELECT r.document_id, row_start, count(*) AS n_chunks FROM r JOIN c ON r.document_id = c.document_id AND c.a < r.row_end AND c.b > r.row_start GROUP BY ALL HAVING count(*) > 1""")
def split_table_rows(spark, sf_dir):
    """Spans of documents that several fixed pieces overlap: an interval join within documents."""
    docs = tables.documents(spark, sf_dir).select("document_id", F.length("text").alias("n"))
    spans = docs.select("document_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select("document_id", (F.col("k") * 200).cast("long").alias("start_char"), (F.col("k") * 200 + 120).cast("long").alias("end_char"))
    pieces = docs.select("document_id", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).filter(F.col("k") * 90 < F.col("n"))
    return diagnostics.split_rows(spans, pieces.select("document_id", (F.col("k") * 90).cast("long").alias("start_char"), (F.col("k") * 90 + 90).cast("long").alias("end_char")))


@query("""SELECT message_id, coalesce(n, 0) AS n_sources, coalesce(cited, '') AS cited FROM messages m LEFT JOIN (SELECT message_id, count(*) AS n, string_agg(chunk_id::VARCHAR, ',' ORDER BY citation_index) AS cited FROM (
    SELECT message_id, unnest(range(0, message_id % 4)) AS citation_index, message_id * 10 + unnest(range(0, message_id % 4)) AS chunk_id FROM messages WHERE role = 'assistant') GROUP BY message_id) USING (message_id)""")
def messages_with_sources(spark, sf_dir):
    """Messages with their sources in citation order, loaded in one join."""
    i = F.col("message_id")
    rows = tables.messages(spark, sf_dir)
    some = rows.filter((F.col("role") == "assistant") & (i % 4 > 0)).select("message_id", F.explode(F.sequence(F.lit(0).cast("long"), i % 4 - 1)).alias("k"))
    sources = some.select("message_id", F.col("k").cast("int").alias("citation_index"), F.concat(F.lit("E"), (F.col("k") + 1).cast("string")).alias("evidence_id"), (i * 10 + F.col("k")).alias("chunk_id"))
    found = answering.with_sources(rows, sources)
    return found.select("message_id", F.size("sources").cast("long").alias("n_sources"), F.array_join(F.transform("sources", lambda s: s["chunk_id"].cast("string")), ",").alias("cited"))


# ---- lexical fields --------------------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT chunk_id, position, surface, canonical FROM ekeys)
  SELECT chunk_id, array_to_string(list_slice(list_distinct_in_order, 1, 12), ' ') AS terms FROM (SELECT chunk_id, list(surface ORDER BY first) AS list_distinct_in_order FROM (
    SELECT chunk_id, surface, min(position) AS first FROM w WHERE canonical = surface AND NOT (length(surface) = 1 AND regexp_full_match(surface, '\\p{{L}}')) AND NOT list_contains({EN}, surface) GROUP BY ALL) GROUP BY chunk_id)""")
def contextual_terms(spark, sf_dir):
    """Words with content of each admissible chunk that are neither ordinals nor ranges."""
    rows = search_chunks(spark, sf_dir)
    toks = lexical.tokens(F.col("normalized"), F.col("language"))
    found = rows.select("chunk_id", lexical.contextual_terms(toks, F.col("language")).alias("terms")).filter(F.size("terms") > 0)
    return found.select("chunk_id", F.array_join("terms", " ").alias("terms"))


@query(f"""WITH {_DECIDED} SELECT question_id, chunk_id, printf('%s; coverage %.2f; proximity %.2f; score %.4f', decision, round(coverage, 2), round(proximity, 2), round(score, 4)) AS reason FROM decided""")
def score_reasons(spark, sf_dir):
    rows = decided(spark, sf_dir).withColumns({"coverage": F.round("coverage", 2), "proximity": F.round("proximity", 2), "score": F.round("score", 4)})
    return retrieval.reason_text(rows).select("question_id", "chunk_id", "reason")


@query(r"""WITH w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS ws FROM documents))
  SELECT strip_accents(word) AS plain, arg_min(word, doc_id * 100000 + place) AS accented FROM w WHERE strip_accents(word) <> word GROUP BY ALL""")
def accent_map(spark, sf_dir):
    """The first accented form of every word without accents."""
    rows = tables.scan(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)([^\W_]+)"), F.lit(1))).alias("place", "word"))
    distinct = rows.groupBy("word").agg(F.min(F.col("doc_id") * 100000 + F.col("place") + 1).alias("position"))
    return stems.accent_map(distinct.withColumn("plain", tx.strip_diacritics(F.col("word"))))


# ---- measures and decisions --------------------------------------------------------------------------------------------


@query(f"WITH {LISTS} SELECT question_id, item, a.rank FROM j LEFT JOIN a USING (question_id, item) WHERE grade = 2")
def target_ranks(spark, sf_dir):
    return metrics.rank_of(exact(spark, sf_dir), judged(spark, sf_dir).filter("grade = 2").select("question_id", "item"))


@query(f"""WITH {LISTS}, r AS (SELECT question_id, item FROM a WHERE item % 3 <> 0), d AS (SELECT question_id, item FROM b WHERE item % 4 <> 0)
  SELECT question_id, item, 'requested_not_added' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM d) UNION ALL SELECT question_id, item, 'added_not_requested' FROM (SELECT * FROM d EXCEPT SELECT * FROM r)""")
def unmet_requests(spark, sf_dir):
    keys = ["question_id", "item"]
    return fusion.unmet(exact(spark, sf_dir).filter("item % 3 <> 0").select(*keys), halved(spark, sf_dir).filter("item % 4 <> 0").select(*keys))


_REPOOLED = f"""{LISTS}, n AS (SELECT question_id, item, CASE WHEN item % 6 = 0 THEN 2 ELSE grade END AS grade FROM j UNION ALL
    SELECT question_id, item, 2 FROM a WHERE item % 2 = 1 AND NOT EXISTS (SELECT 1 FROM j WHERE j.question_id = a.question_id AND j.item = a.item))"""


def _repooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = judged(spark, sf_dir)
    added = exact(spark, sf_dir).filter("item % 2 = 1").join(before, ["question_id", "item"], "left_anti").select("question_id", "item", F.lit(2).alias("grade"))
    return before.withColumn("grade", F.when(F.col("item") % 6 == 0, 2).otherwise(F.col("grade"))).unionByName(added)


@query(f"""WITH {_REPOOLED}, x AS (SELECT question_id, count_if(grade >= 2) AS n_before FROM j GROUP BY ALL), y AS (SELECT question_id, count_if(grade >= 2) AS n_after FROM n GROUP BY ALL)
  SELECT question_id, n_before, n_after FROM x JOIN y USING (question_id) WHERE n_before <> n_after""")
def denominator_changes(spark, sf_dir):
    return rules.denominator_changes(judged(spark, sf_dir), _repooled(spark, sf_dir))


@query(f"WITH {_REPOOLED} SELECT question_id, count(*) AS n_returned, count(n.item) AS n_judged, count(*) - count(n.item) AS n_unjudged FROM b LEFT JOIN n USING (question_id, item) GROUP BY question_id")
def judgment_coverage(spark, sf_dir):
    return rules.judgment_coverage(halved(spark, sf_dir), _repooled(spark, sf_dir))


@query(f"""WITH {LISTS}, {_SIGNALS}, {_GRID}, {_per('a')}, m AS (SELECT round(min_top1, 2) AS min_top1, sig.question_id FROM sig, pol WHERE rule = 'R1' AND label = 'ANSWERABLE' AND top1 >= pol.min_top1)
  SELECT min_top1, count(*) AS n_questions, {', '.join(f'round(avg(round({x}, 6)), 6) AS mean_{x}' for x in _MEASURES)} FROM m JOIN per USING (question_id) WHERE n_relevant > 0 GROUP BY min_top1""")
def admitted_quality(spark, sf_dir):
    """Retrieval measures over the answerable questions that each threshold admits."""
    per = metrics.per_question(exact(spark, sf_dir), judged(spark, sf_dir)).filter("n_relevant > 0")
    grid = statistics.policy_grid(spark).filter("rule = 'R1'").select("min_top1")
    admitted = signals(spark, sf_dir).filter("label = 'ANSWERABLE'").join(F.broadcast(grid), F.col("top1") >= F.col("min_top1")).select("question_id", F.round("min_top1", 2).alias("min_top1"))
    rows = admitted.join(per, "question_id").groupBy("min_top1")
    return rows.agg(F.count(F.lit(1)).alias("n_questions"), *(F.round(F.avg(F.round(x, 6)), 6).alias(f"mean_{x}") for x in _MEASURES))


_POLICIES = f"""{LISTS}, {_SIGNALS}, {_GRID}, per_policy AS (SELECT policy_id, rule, round(min_top1, 2) AS min_top1, min_margin::DOUBLE AS min_margin, round(count_if(ok) / count(*), 6) AS coverage,
    round(count_if(label = 'NO_EVIDENCE' AND NOT ok) / count_if(label = 'NO_EVIDENCE'), 6) AS correct_abstention, round(count_if(label = 'ANSWERABLE' AND NOT ok) / count_if(label = 'ANSWERABLE'), 6) AS false_abstention FROM adm GROUP BY ALL)"""


@query(f"""WITH {_POLICIES} SELECT policy_id, rule, min_top1, min_margin, coverage, correct_abstention, false_abstention FROM per_policy WHERE coalesce(false_abstention <= 0.2, true)
  ORDER BY correct_abstention DESC NULLS LAST, false_abstention ASC NULLS LAST, coverage DESC, rule, min_top1 NULLS FIRST, min_margin NULLS FIRST LIMIT 1""")
def selected_policy(spark, sf_dir):
    """The policy that calibration chooses."""
    found = statistics.select_policy(statistics.admission_metrics(signals(spark, sf_dir), statistics.policy_grid(spark)))
    return found.select("policy_id", "rule", F.round("min_top1", 2).alias("min_top1"), "min_margin", "coverage", "correct_abstention", "false_abstention")


@query(f"""WITH {_POLICIES}, held AS (SELECT policy_id, correct_abstention * 0.6::DOUBLE AS correct_abstention, least(1.0, false_abstention + 0.05::DOUBLE) AS false_abstention FROM per_policy)
  SELECT policy_id, coalesce(h.correct_abstention >= p.correct_abstention * 0.5 AND h.false_abstention <= 0.2, false) AS generalises FROM per_policy p JOIN held h USING (policy_id)""")
def generalisation(spark, sf_dir):
    """Whether each policy would hold if held-out questions kept six tenths of its correct abstention."""
    rows = statistics.admission_metrics(signals(spark, sf_dir), statistics.policy_grid(spark))
    held, missed = F.col("correct_abstention") * F.lit(0.6), F.least(F.lit(1.0), F.col("false_abstention") + F.lit(0.05))
    return rows.select("policy_id", F.coalesce(statistics.generalises(F.col("correct_abstention"), held, missed), F.lit(False)).alias("generalises"))


@query("""SELECT event_type, CASE WHEN min(value) - 20 > 0 AND NOT count(*) % 2 = 0 THEN 'A' WHEN max(value) - 20 < 0 OR count(*) % 2 = 0 THEN 'C' ELSE 'B' END AS decision FROM events GROUP BY event_type""")
def interval_decisions(spark, sf_dir):
    """The three-way decision on an interval and a regression flag."""
    per = tables.scan(spark, sf_dir, "events").groupBy("event_type").agg((F.min("value") - 20).alias("low"), (F.max("value") - 20).alias("high"), (F.count(F.lit(1)) % 2 == 0).alias("regressed"))
    return per.select("event_type", statistics.interval_decision(F.col("low"), F.col("high"), F.col("regressed")).alias("decision"))


_RRF_MEASURES = ("recall_1", "recall_3", "recall_5", "reciprocal_rank", "ndcg_1", "ndcg_3", "ndcg_5")


@query(f"""WITH {LISTS}, {_A}, {_B}, d AS (SELECT coalesce(p.reciprocal_rank, 0) AS r0, coalesce(p2.reciprocal_rank, 0) AS r1, {', '.join(f'coalesce(p2.{m}, 0) - coalesce(p.{m}, 0) AS d_{m}' for m in _RRF_MEASURES)} FROM per p JOIN per2 p2 USING (question_id)),
  n AS (SELECT count_if(r0 > 0 AND r1 = 0) AS n_lost, ({' + '.join(f'(CASE WHEN avg(d_{m}) < -1e-9 THEN 1 ELSE 0 END)' for m in _RRF_MEASURES)})::INTEGER AS n_decreased,
    count_if(greatest({', '.join(f'd_{m}' for m in _RRF_MEASURES)}) > 1e-9 AND least({', '.join(f'd_{m}' for m in _RRF_MEASURES)}) >= -1e-9) AS n_improved, count_if(least({', '.join(f'd_{m}' for m in _RRF_MEASURES)}) < -1e-9) AS n_worsened FROM d),
  o AS (SELECT count_if(a.rank IS NULL AND b.rank IS NOT NULL) AS n_recovered FROM (SELECT question_id, item FROM j WHERE grade = 2) LEFT JOIN a USING (question_id, item) LEFT JOIN b USING (question_id, item))
  SELECT n_lost, n_decreased, n_improved, n_worsened, n_recovered, CASE WHEN n_lost > 0 OR n_decreased > 0 THEN 'B' WHEN n_recovered = 0 AND n_improved = 0 THEN 'C' ELSE 'D' END AS decision FROM n, o""")
def rrf_decision(spark, sf_dir):
    """What ranking by half of each vector costs against the whole, by the decision rule of fusion."""
    known = judged(spark, sf_dir)
    before, after = (metrics.per_question(f(spark, sf_dir), known) for f in (exact, halved))
    outcomes = fusion.target_outcomes(known.filter("grade = 2"), exact(spark, sf_dir), halved(spark, sf_dir))
    return rules.rrf_comparison(before, after, outcomes, list(_RRF_MEASURES))


_MATRIX = [(m, f"A{m}", "known") for m in range(1, 9)]


@query("""WITH cells AS (SELECT message_id % 12 AS case_id, message_id, 'A' || (message_id % 8 + 1) AS metric, length(content) % 3 <> 0 AS passed, message_id % 5 <> 0 AS outcome_matches FROM messages)
  SELECT message_id, case_id, metric, CASE WHEN outcome_matches AND metric = 'A' || case_id THEN 'known' ELSE 'unexplained' END AS class FROM cells WHERE NOT passed""")
def failure_classes(spark, sf_dir):
    """Failed cells against a small matrix of expected ones."""
    i = F.col("message_id")
    cells = tables.messages(spark, sf_dir).select(
        "message_id", (i % 12).alias("case"), F.concat(F.lit("A"), (i % 8 + 1).cast("string")).alias("metric"), (F.length("content") % 3 != 0).alias("passed"), (i % 5 != 0).alias("outcome_matches")
    )
    keyed = cells.withColumn("case_id", F.struct("message_id", "case"))
    matrix = cells.select("message_id", "case").distinct().join(F.broadcast(spark.createDataFrame(_MATRIX, "case long, metric string, class string")), "case").select(F.struct("message_id", "case").alias("case_id"), "metric", "class")
    found = rules.classified_failures(keyed, matrix)
    return found.select("case_id.message_id", F.col("case_id.case").alias("case_id"), "metric", "class")


@query(f"""WITH {_DECIDED}, {_fact_sql()}, top AS (SELECT question_id, document_id, chunk_index, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC, document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank
    FROM decided WHERE status = 'kept' QUALIFY rank <= 5),
  tg AS (SELECT question_id, document_id AS target FROM judgments), e AS (SELECT question_id, count(DISTINCT fact) AS n_expected FROM f GROUP BY ALL),
  x AS (SELECT top.*, fact FROM top LEFT JOIN pres USING (question_id, document_id, chunk_index)),
  y AS (SELECT question_id, target, document_id, chunk_index, count(fact) AS n, bool_or(document_id = target) AS own FROM x JOIN tg USING (question_id) GROUP BY ALL),
  c AS (SELECT question_id, target, count(*) AS n_results, count_if(n = 0) AS n_irrelevant, bool_or(own) AS target_retrieved, bool_or(own AND n > 0) AS matching_chunk_retrieved FROM y GROUP BY ALL),
  z AS (SELECT question_id, target, count(DISTINCT fact) AS n_covered, count(DISTINCT CASE WHEN document_id <> target THEN fact END) AS n_other, count(DISTINCT CASE WHEN document_id = target THEN fact END) AS n_own FROM x JOIN tg USING (question_id) GROUP BY ALL)
  SELECT question_id, target, coalesce(n_results, 0) AS n_results, coalesce(n_irrelevant, 0) AS n_irrelevant, coalesce(target_retrieved, false) AS target_retrieved, coalesce(matching_chunk_retrieved, false) AS matching_chunk_retrieved,
    coalesce(n_covered, 0) AS n_facts_covered, coalesce(n_covered, 0) = n_expected AS all_facts_covered, coalesce(n_own, 0) = n_expected AS covering_set_retrieved, coalesce(n_other, 0) = n_expected AS other_documents_cover_all,
    coalesce(n_results > 0 AND n_irrelevant = n_results, false) AS only_irrelevant FROM tg JOIN e USING (question_id) LEFT JOIN c USING (question_id, target) LEFT JOIN z USING (question_id, target)""")
def retrieval_analysis(spark, sf_dir):
    """What the results of each question show of its facts and of each relevant document."""
    results = retrieval.ranked(decided(spark, sf_dir), TOP_K).select("question_id", "rank", "document_id", "chunk_index")
    targets = tables.judgments(spark, sf_dir).select("question_id", F.col("document_id").alias("target")).distinct()
    return rules.retrieval_analysis(targets, results, presence(spark, sf_dir), _facts(spark, sf_dir))


@query(f"""WITH {_DECIDED}, {_fact_sql()}, top AS (SELECT question_id, document_id, chunk_index, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, coverage DESC, quality DESC, raw_score DESC, document_id::VARCHAR, chunk_index, chunk_id::VARCHAR) AS rank
    FROM decided WHERE status = 'kept' QUALIFY rank <= 5), x AS (SELECT top.question_id, rank, fact FROM top LEFT JOIN pres USING (question_id, document_id, chunk_index)),
  first AS (SELECT question_id, fact, min(rank) AS rank FROM x WHERE fact IS NOT NULL GROUP BY ALL)
  SELECT question_id, rank, (SELECT count(*) FROM first f WHERE f.question_id = t.question_id AND f.rank <= t.rank) AS n_facts FROM (SELECT DISTINCT question_id, rank FROM top) t""")
def cumulative_facts(spark, sf_dir):
    results = retrieval.ranked(decided(spark, sf_dir), TOP_K).select("question_id", F.col("rank").cast("long"), "document_id", "chunk_index")
    return diagnostics.cumulative_facts(results, presence(spark, sf_dir))


@query("""WITH q AS (SELECT item_id AS question_id, CASE WHEN item_id % 9 = 0 THEN ' ' ELSE text END AS question, CASE WHEN item_id % 2 = 0 THEN 'CONFIRMED' ELSE 'DRAFT' END AS status, item_id % 5 = 0 AS none, item_id % 4 AS n_judgments, item_id % 3 AS n_relevant, item_id % 7 = 0 AS excluded, CASE WHEN item_id % 14 = 0 THEN 'why' END AS why FROM benchmark)
  SELECT question_id, problem FROM (SELECT question_id, unnest([CASE WHEN trim(question) = '' THEN 'blank_question' END, CASE WHEN status = 'CONFIRMED' AND NOT none AND n_judgments = 0 THEN 'confirmed_without_judgments' END,
    CASE WHEN none AND n_relevant > 0 THEN 'relevant_where_none_expected' END, CASE WHEN excluded AND why IS NULL THEN 'exclusion_without_reason' END]) AS problem FROM q) WHERE problem IS NOT NULL""")
def question_set_problems(spark, sf_dir):
    i = F.col("item_id")
    rows = tables.scan(spark, sf_dir, "benchmark").select(
        i.alias("question_id"), F.when(i % 9 == 0, " ").otherwise(F.col("text")).alias("question"), F.when(i % 2 == 0, "CONFIRMED").otherwise("DRAFT").alias("status"), (i % 5 == 0).alias("no_relevant_evidence"),
        (i % 4).alias("n_judgments"), (i % 3).alias("n_relevant"), (i % 7 == 0).alias("excluded_from_metrics"), F.when(i % 14 == 0, "why").alias("exclusion_reason"),
    )
    return contracts.question_set_problems(rows)


@query("""WITH e AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings), a AS (SELECT vec_id AS question_id FROM embeddings WHERE vec_id % 50 = 0),
  x AS (SELECT q.question_id, CASE q.question_id % 100 WHEN 0 THEN 'same' ELSE 'other' END AS kind FROM a q) SELECT question_id FROM x WHERE kind = 'other'""")
def planted_null_control(spark, sf_dir):
    """Two runs of one condition of which the second has another value for every other question: the guard names those."""
    first = vectors(spark, sf_dir).filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question_id"), "label")
    second = first.withColumn("label", F.when(F.col("question_id") % 100 == 0, F.col("label")).otherwise(F.col("label") + 1))
    return contracts.null_controls(first, second, ["question_id"], ["label"])
