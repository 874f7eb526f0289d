"""Queries over documents, versions, chunks and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proofloom.functions import text as tx
from proofloom.operators import admissibility as adm
from proofloom.operators import answering, chunking, diagnostics, digests
from proofloom.plans.declare import query
from proofloom.plans.views import REFERENCE_DATE, normal
from proofloom.schemas import duplicates, orphans, version_checks, violations
from proofloom.sources import files, json_files, tables


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adm.candidates(tables.chunks(spark, sf_dir), tables.documents(spark, sf_dir), tables.versions(spark, sf_dir))


def admissible(spark: SparkSession, sf_dir: str, policy: tuple[str, ...] = adm.RETRIEVAL) -> DataFrame:
    """English chunks that may serve each institution's own questions."""
    rows = adm.within(candidates(spark, sf_dir), F.col("chunk_institution"), "en", REFERENCE_DATE)
    return adm.eligible(rows, policy)


@query(f"SELECT doc_id, {normal('text')} AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return tables.scan(spark, sf_dir, "documents").select("doc_id", tx.normalize_text(F.col("text")).alias("normalized"))


@query("SELECT chunk_id, document_id, chunk_index FROM elig")
def admissible_chunks(spark, sf_dir):
    return admissible(spark, sf_dir).select("chunk_id", "document_id", "chunk_index")


@query("""SELECT chunk_id, condition, coalesce(satisfied, false) AS satisfied FROM (
  SELECT chunk_id, unnest([
    {'condition': 'chunk_belongs_to_institution', 'satisfied': institution_id = 'i0'},
    {'condition': 'document_belongs_to_institution', 'satisfied': document_institution = 'i0'},
    {'condition': 'version_belongs_to_institution', 'satisfied': version_institution = 'i0'},
    {'condition': 'version_processed', 'satisfied': processing_status = 'processed'},
    {'condition': 'version_is_highest_processed', 'satisfied': version_id = latest_version_id},
    {'condition': 'document_active', 'satisfied': is_active},
    {'condition': 'language_compatible', 'satisfied': document_language = 'en'},
    {'condition': 'chunk_language_compatible', 'satisfied': language = 'en'},
    {'condition': 'valid_from_compatible', 'satisfied': valid_from IS NULL OR valid_from <= DATE '2024-06-01'},
    {'condition': 'valid_until_compatible', 'satisfied': valid_until IS NULL OR valid_until >= DATE '2024-06-01'},
    {'condition': 'official_source_compatible', 'satisfied': official_source}], recursive := true) FROM cands)""")
def explain_conditions(spark, sf_dir):
    """Every condition of every chunk, for an English question of one institution that wants official sources."""
    rows = adm.within(candidates(spark, sf_dir), "i0", "en", REFERENCE_DATE, official_only=True)
    return adm.explain(rows, ["chunk_id"])


@query(f"""SELECT document_id, count(*) AS n_citable, count_if(version_id = latest_version_id) AS n_retrievable FROM cands
  WHERE document_institution = institution_id AND version_institution = institution_id AND processing_status = 'processed' AND is_active
  AND document_language = 'en' AND language = 'en' AND (valid_from IS NULL OR valid_from <= DATE '{REFERENCE_DATE}')
  AND (valid_until IS NULL OR valid_until >= DATE '{REFERENCE_DATE}') GROUP BY document_id""")
def citation_policy(spark, sf_dir):
    newest = F.col("version_id") == F.col("latest_version_id")
    return admissible(spark, sf_dir, adm.CITATION).groupBy("document_id").agg(F.count(F.lit(1)).alias("n_citable"), F.count_if(newest).alias("n_retrievable"))


@query("SELECT document_id, institution_id, latest_version_id, latest_version_number FROM latest")
def latest_processed_version(spark, sf_dir):
    return adm.latest_processed(tables.versions(spark, sf_dir))


@query("""SELECT document_id, arg_max(version_id, version_number) AS latest_version_id, arg_max(processing_status, version_number) AS latest_status,
  arg_max(version_id, version_number) FILTER (WHERE processing_status = 'processed') AS effective_version_id FROM vers GROUP BY document_id""")
def latest_any_version(spark, sf_dir):
    return adm.latest_any(tables.versions(spark, sf_dir))


@query("""WITH batch AS (SELECT item_id AS upload_id, item_id % 50 AS document_id FROM benchmark),
  top AS (SELECT document_id, max(version_number) AS top FROM vers GROUP BY document_id)
  SELECT upload_id, document_id, coalesce(top, 0) + row_number() OVER (PARTITION BY document_id ORDER BY upload_id) AS version_number
  FROM batch LEFT JOIN top USING (document_id)""")
def next_version_number(spark, sf_dir):
    batch = tables.scan(spark, sf_dir, "benchmark").select(F.col("item_id").alias("upload_id"), (F.col("item_id") % 50).alias("document_id"))
    return files.number_versions(batch, tables.versions(spark, sf_dir)).select("upload_id", "document_id", F.col("version_number").cast("long"))


@query("""SELECT institution_id, checksum_sha256, count(*) AS n_rows FROM vers WHERE version_number = 1 GROUP BY ALL HAVING count(*) > 1""")
def duplicate_checksums(spark, sf_dir):
    return duplicates(tables.versions(spark, sf_dir).filter("version_number = 1"), ["institution_id", "checksum_sha256"])


@query("""WITH batch AS (SELECT doc_id AS upload_id, 'i' || (doc_id % 2) AS institution_id, sha256(text) AS checksum_sha256 FROM documents)
  SELECT upload_id, institution_id, checksum_sha256 FROM batch b WHERE NOT EXISTS (
    SELECT 1 FROM vers v WHERE v.processing_status = 'processed' AND v.institution_id = b.institution_id AND v.checksum_sha256 = b.checksum_sha256)
  QUALIFY row_number() OVER (PARTITION BY institution_id, checksum_sha256 ORDER BY upload_id) = 1""")
def new_uploads(spark, sf_dir):
    """What would be new if every document came again while only processed versions are known."""
    docs = tables.scan(spark, sf_dir, "documents")
    institution = F.concat(F.lit("i"), (F.col("doc_id") % 2).cast("string"))
    batch = docs.select(F.col("doc_id").alias("upload_id"), institution.alias("institution_id"), F.sha2("text", 256).alias("checksum_sha256"))
    known = tables.versions(spark, sf_dir).filter("processing_status = 'processed'")
    return files.new_contents(batch, known).select("upload_id", "institution_id", "checksum_sha256")


@query(r"""SELECT page_id, CASE WHEN strlen(html) > 20000 THEN 'too_large' WHEN ext NOT IN ('pdf', 'txt', 'md') THEN 'unsupported_extension'
  WHEN ext = 'pdf' AND NOT starts_with(html, '%PDF-') THEN 'not_a_pdf' END AS reject_reason
  FROM (SELECT *, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 2 THEN 'md' ELSE 'html' END AS ext FROM pages)""")
def upload_validation(spark, sf_dir):
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "txt", "md", "html"))), (F.col("page_id") % 4 + 1).cast("int"))
    rows = tables.scan(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page."), kind).alias("filename"), F.col("html").cast("binary").alias("content"))
    rows = rows.withColumns({"size_bytes": F.octet_length("content"), "declared_type": F.lit(None).cast("string")})
    return files.validate(rows, max_bytes=20_000).select("page_id", "reject_reason")


@query("""SELECT version_id, 'status_known' AS "constraint" FROM vers WHERE processing_status NOT IN ('pending', 'processing', 'processed', 'failed')
  UNION ALL SELECT version_id, 'size_positive' FROM vers WHERE size_bytes <= 0
  UNION ALL SELECT version_id, 'version_number_positive' FROM vers WHERE version_number <= 0""")
def version_violations(spark, sf_dir):
    return violations(tables.versions(spark, sf_dir), version_checks(), "version_id")


@query("SELECT doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def orphan_labels(spark, sf_dir):
    """Labels without an English document: a foreign-key check that fails on purpose."""
    english = tables.scan(spark, sf_dir, "documents").filter("lang = 'en'")
    return orphans(tables.scan(spark, sf_dir, "labels"), english, ["doc_id"]).select("doc_id")


@query("SELECT document_id, language, title FROM docs WHERE is_active AND official_source AND language = 'fr' ORDER BY document_id DESC LIMIT 20 OFFSET 10")
def pages_limit_offset(spark, sf_dir):
    rows = adm.listed(tables.documents(spark, sf_dir), is_active=True, official_source=True, language="fr")
    return adm.page(rows, [F.desc("document_id")], 20, 10).select("document_id", "language", "title")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def orders_page(spark, sf_dir):
    rows = tables.scan(spark, sf_dir, "orders")
    return adm.page(rows, [F.desc("o_orderdate"), F.desc("o_orderkey")], 25, 50).select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT document_id, substr(text, 101, 200) AS slice, length(text) AS total_chars FROM docs""")
def text_slices(spark, sf_dir):
    rows = files.text_slice(tables.documents(spark, sf_dir), 100, 200)
    return rows.select("document_id", "slice", F.col("total_chars").cast("long"))


_TYPED = r"""l AS (SELECT doc_id AS document_id, line AS raw, trim(line, ' ' || chr(9) || chr(13)) AS line, chunk_index AS line_index FROM linesof),
  n AS (SELECT *, coalesce(lag(line = '') OVER w, true) AS before, coalesce(lead(line = '') OVER w, false) AS after,
    coalesce(max(line <> '') OVER (PARTITION BY document_id ORDER BY line_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS rest,
    length(regexp_replace(line, '\P{L}', '', 'g')) AS letters, length(regexp_replace(line, '\P{Lu}', '', 'g')) AS upper_,
    len(regexp_extract_all(line, '\S+')) AS words FROM l WINDOW w AS (PARTITION BY document_id ORDER BY line_index)),
  typed AS (SELECT document_id, line_index, raw, line, CASE WHEN line = '' THEN 'blank' WHEN contains(line, ' | ') THEN 'table_row'
    WHEN regexp_matches(line, '^(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][)]\s+)') THEN 'list_item'
    WHEN regexp_matches(line, '^#{1,6}\s+\S') OR regexp_matches(line, '^\d+(?:\.\d+)+(?:[.)])?\s+\S') OR (length(line) <= 120 AND line LIKE '%:')
      OR (letters >= 3 AND length(line) <= 120 AND upper_ >= letters * 0.8)
      OR (before AND after AND rest AND words BETWEEN 1 AND 8 AND length(line) <= 80 AND NOT regexp_matches(line, '[.!?;,]$')) THEN 'heading'
    ELSE 'paragraph' END AS line_type FROM n)"""
#: The units of a document without page breaks: its lines joined to headings, rows, items and paragraphs.
_UNITS = rf"""{_TYPED},
  placed AS (SELECT *, coalesce(sum(length(raw) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(raw) - length(ltrim(raw, ' ' || chr(9) || chr(13))) AS start_char,
    last_value(CASE WHEN line_type = 'heading' THEN line END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title,
    CASE WHEN line_type = 'paragraph' AND coalesce(lag(line_type) OVER w, '') = 'paragraph' THEN 0 ELSE 1 END AS fresh FROM typed WINDOW w AS (PARTITION BY document_id ORDER BY line_index)),
  numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY line_index) AS unit FROM placed),
  pieces AS (SELECT document_id, unit, first(line_type) AS kind, arg_min(section_title, line_index) AS section_title, min(start_char) AS s, max(start_char + length(line)) AS e,
    min(line_index) AS first_line, max(line_index) AS last_line FROM numbered WHERE line_type <> 'blank' GROUP BY document_id, unit)"""


@query(f"WITH {_TYPED} SELECT document_id, line_index, line_type FROM typed")
def line_classification(spark, sf_dir):
    rows = chunking.classify(chunking.lines(tables.documents(spark, sf_dir)))
    return rows.select("document_id", F.col("line_index").cast("long"), "line_type")


@query(f"""WITH {_UNITS} SELECT document_id, 1::INTEGER AS page_number, unit::BIGINT AS unit, kind AS structure_type, section_title, s::BIGINT AS start_char, e::BIGINT AS end_char FROM pieces""")
def structural_units(spark, sf_dir):
    pieces = chunking.units(tables.documents(spark, sf_dir))
    return pieces.select("document_id", "page_number", F.col("unit").cast("long"), "structure_type", "section_title", F.col("start_char").cast("long"), F.col("end_char").cast("long"))


#: Packing by recursion over the units of a run, and over the windows of a long unit.
_CHUNKED = rf"""{_UNITS},
  flagged AS (SELECT *, e - s > 1200 AS long, e - s > 1200 OR kind IN ('heading', 'table_row') AS alone FROM pieces),
  runs AS (SELECT *, CASE WHEN NOT alone AND NOT coalesce(lag(alone) OVER w, true) AND lag(kind) OVER w = kind AND lag(section_title) OVER w IS NOT DISTINCT FROM section_title
    AND NOT (kind = 'list_item' AND lag(last_line) OVER w + 1 < first_line) THEN 0 ELSE 1 END AS fresh FROM flagged WINDOW w AS (PARTITION BY document_id ORDER BY unit)),
  dealt AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY unit) AS run FROM runs),
  turns AS (SELECT *, row_number() OVER (PARTITION BY document_id, run ORDER BY unit) AS turn FROM dealt WHERE NOT long),
  fold AS (SELECT document_id, run, turn, kind, section_title, s, e, 1 AS n FROM turns WHERE turn = 1
    UNION ALL SELECT t.document_id, t.run, t.turn, t.kind, t.section_title, CASE WHEN t.e - f.s <= 1200 THEN f.s ELSE t.s END, t.e, CASE WHEN t.e - f.s <= 1200 THEN f.n + 1 ELSE 1 END
    FROM fold f JOIN turns t ON t.document_id = f.document_id AND t.run = f.run AND t.turn = f.turn + 1),
  whole AS (SELECT document_id, section_title, s, max(e) AS e, CASE WHEN kind = 'list_item' AND max(n) > 1 THEN 'list_block' ELSE kind END AS kind, 'structured_v1' AS strategy FROM fold GROUP BY document_id, run, kind, section_title, s),
  bodies AS (SELECT u.document_id, u.section_title, u.s, substr(d.text, u.s::BIGINT + 1, (u.e - u.s)::BIGINT) AS body, (u.e - u.s)::BIGINT AS n FROM dealt u JOIN docs d USING (document_id) WHERE u.long),
  wins AS (SELECT document_id, section_title, s, body, n, 0::BIGINT AS pos, NULL::BIGINT AS stop FROM bodies
    UNION ALL SELECT document_id, section_title, s, body, n, pos, CASE WHEN most = n THEN most WHEN lined > 0 THEN pos + 150 + lined WHEN spaced > 0 THEN pos + 150 + spaced ELSE most END
    FROM (SELECT *, length(regexp_extract(zone, '(?s)^(.*\n)', 1)) AS lined, length(regexp_extract(zone, '(?s)^(.*[ \t])', 1)) AS spaced
      FROM (SELECT *, least(pos + 1200, n) AS most, substr(body, pos + 151, least(pos + 1200, n) - pos - 150) AS zone
        FROM (SELECT document_id, section_title, s, body, n, CASE WHEN stop IS NULL THEN 0 WHEN stop = n AND pos + 1200 >= n THEN n ELSE greatest(stop - 150, pos + 1) END AS pos FROM wins) WHERE pos < n))),
  cuts AS (SELECT document_id, section_title, s + pos + length(raw) - length(ltrim(raw, w)) AS s, length(trim(raw, w)) AS len
    FROM (SELECT *, substr(body, pos + 1, stop - pos) AS raw, ' ' || chr(9) || chr(10) || chr(13) AS w FROM wins WHERE stop IS NOT NULL)),
  spans AS (SELECT * FROM whole UNION ALL SELECT document_id, section_title, s, s + len, 'fallback_fragment', 'character_fallback_v1' FROM cuts WHERE len > 0),
  made AS (SELECT p.*, substr(d.text, p.s::BIGINT + 1, (p.e - p.s)::BIGINT) AS content, (row_number() OVER (PARTITION BY document_id ORDER BY p.s) - 1)::INTEGER AS chunk_index FROM spans p JOIN docs d USING (document_id))"""


@query(f"""WITH RECURSIVE {_CHUNKED} SELECT document_id, chunk_index, content, {normal('content')} AS normalized_content, sha256(content) AS content_sha256, s::INTEGER AS start_char, e::INTEGER AS end_char,
  1::INTEGER AS page_number, section_title, kind AS structure_type, strategy AS chunking_strategy FROM made""")
def chunk_document(spark, sf_dir):
    """Chunks of every document (the bundled texts have no page breaks)."""
    return chunking.chunk_documents(tables.documents(spark, sf_dir))


@query(f"""WITH RECURSIVE {_CHUNKED}, faulty AS (SELECT document_id, CASE WHEN chunk_index % 7 = 3 THEN s + 1 ELSE s END AS s, e, CASE WHEN chunk_index % 11 = 5 THEN content || '!' ELSE content END AS content,
    CASE WHEN chunk_index % 13 = 6 THEN chunk_index - 1 ELSE chunk_index END AS chunk_index FROM made),
  checked AS (SELECT f.*, substr(d.text, f.s::BIGINT + 1, (f.e - f.s)::BIGINT) AS span, count(*) OVER (PARTITION BY document_id, f.chunk_index) AS same, length(d.text) AS n FROM faulty f JOIN docs d USING (document_id))
  SELECT count(DISTINCT document_id) AS n_documents, count(*) AS n_chunks, count_if(e <= s OR e > n)::BIGINT AS n_bad_offsets, count_if(span <> content)::BIGINT AS n_content_differs, count_if(same > 1)::BIGINT AS n_duplicate_index FROM checked""")
def chunk_integrity(spark, sf_dir):
    """The audit over the chunks with planted faults: some begin a character late, have text of their own, or repeat an index."""
    docs = tables.documents(spark, sf_dir)
    i = F.col("chunk_index")
    faulty = chunking.chunk_documents(docs).withColumns(
        {
            "start_char": F.when(i % 7 == 3, F.col("start_char") + 1).otherwise(F.col("start_char")),
            "content": F.when(i % 11 == 5, F.concat("content", F.lit("!"))).otherwise(F.col("content")),
            "chunk_index": F.when(i % 13 == 6, i - 1).otherwise(i),
        }
    )
    audit = diagnostics.chunk_integrity(faulty, docs.select("document_id", "text"))
    return audit.agg(
        F.count_distinct("document_id").alias("n_documents"), F.count(F.lit(1)).alias("n_chunks"), F.count_if("bad_offsets").alias("n_bad_offsets"),
        F.count_if("content_differs").alias("n_content_differs"), F.count_if("duplicate_index").alias("n_duplicate_index"),
    )


@query("SELECT document_id, structure_type, count(*) AS n_chunks FROM chunks GROUP BY ALL")
def structure_counts(spark, sf_dir):
    return diagnostics.structure_counts(tables.chunks(spark, sf_dir))


@query("""SELECT structure_type, count(*) AS n_chunks, min(length(content)) AS min_chars, max(length(content)) AS max_chars, avg(length(content)) AS mean_chars,
  median(length(content)) AS median_chars FROM chunks GROUP BY ALL""")
def chunk_sizes(spark, sf_dir):
    return diagnostics.chunk_sizes(tables.chunks(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("min_chars", "max_chars")})


@query("""SELECT count_if(has) AS n_with, count_if(NOT has) AS n_without FROM (SELECT bool_or(structure_type = 'table_row') AS has FROM chunks GROUP BY document_id)""")
def structure_bonus_availability(spark, sf_dir):
    return diagnostics.bonus_availability(tables.chunks(spark, sf_dir))


#: The families once more for an engine without looks beside a match: what is looked at is a boundary, or is left out by the group.
_WORDS_APART = r"\b({0})\b"
_FORBIDDEN_TWINS = {
    "windows_path": r"(?:\b|_)([a-zA-Z]:(?:/|\\)+[^\s<>:\"|?*/\\])",
    "windows_unc_path": r"(?:\B|_)(\\\\[^\s<>:\"|?*/\\]+\\)",
    "unix_path": r"(?:\B|_)(/(?:bin|boot|dev|etc|home|lib|media|mnt|opt|proc|root|run|sbin|srv|sys|tmp|usr|var)/)",
    "macos_path": r"(?:\B|_)(/(?:Applications|Library|System|Users|Volumes|private)/)",
    "private_key": r"(-----BEGIN (?:[A-Z\d]+ )*PRIVATE KEY-----)",
    "jwt": _WORDS_APART.format(r"eyJ[\w-]{12,}\.[\w-]{3,}\.[\w-]{3,}"),
    "api_key_or_token": _WORDS_APART.format(r"(?:AKIA|ASIA)[A-Z\d]{16,}|AIza[\w-]{30,}|(?:gh[oprsu]_|github_pat_)\w{20,}|xox[abprs]-[a-zA-Z\d-]{10,}|[prs]k(?:-|_live_)[\w-]{16,}"),
    "credentials_in_url": r"\b([a-zA-Z][a-zA-Z\d.+\-]*://[\w.~!$&'()*+,;=%\-]+:[\w.~!$&'()*+,;=%\-]+@)",
    "uuid": _WORDS_APART.format(r"[a-fA-F\d]{8}(?:-[a-fA-F\d]{4}){3}-[a-fA-F\d]{12}"),
    "hex_digest": _WORDS_APART.format(r"(?:[a-fA-F\d]{20}){2}|(?:[a-fA-F\d]{16}){4}"),
    "email_address": r"([\w!#$%&'*+/=?^`{|}~\-]+(?:\.[\w!#$%&'*+/=?^`{|}~\-]+)*@(?:[a-zA-Z\d\-]+\.)+[a-zA-Z]{2,})\b",
}


def _forbidden_sql(source: str, key: str, text: str, outside: str | None = None) -> str:
    """Matches by rule; ``outside`` adds the addresses of hosts that are neither this one nor below it."""
    quoted = {n: "'" + p.replace("'", "''") + "'" for n, p in _FORBIDDEN_TWINS.items()}
    parts = [f"SELECT {key}, '{name}' AS rule, regexp_extract_all({text}, {pattern}, 1) AS h FROM {source}" for name, pattern in quoted.items()]
    runs = rf"list_filter(regexp_extract_all({text}, '[\w.]*\w'), lambda r: regexp_full_match(r, '\d{{1,3}}(\.\d{{1,3}}){{3}}'))"
    parts.append(f"SELECT {key}, 'ip_address', list_filter({runs}, lambda r: list_max(list_transform(string_split(r, '.'), lambda n: n::INTEGER)) <= 255) FROM {source}")
    if outside:
        links = rf"regexp_extract_all({text}, '\b((?:h|H)(?:t|T){{2}}(?:p|P)(?:s|S)?://[\w.~:/?#\[\]@!$&''()*+,;=%\-]+)', 1)"
        host = r"lower(regexp_extract(u, '://(?:[^/?#]*@)?([^/?#@]*?)(?::\d*)?(?:[/?#]|$)', 1))"
        parts.append(f"SELECT {key}, 'url_outside_allowlist', list_filter({links}, lambda u: NOT ({host} = '{outside}' OR ends_with({host}, '.{outside}'))) FROM {source}")
    return f"SELECT {key}, rule, len(h)::INTEGER AS n_matches, list_max(list_transform(h, lambda x: length(x)))::INTEGER AS longest FROM (" + " UNION ALL ".join(parts) + ") WHERE len(h) > 0"


@query(_forbidden_sql("documents", "doc_id", "text"))
def forbidden_data_scan(spark, sf_dir):
    return json_files.forbidden_data(tables.scan(spark, sf_dir, "documents"), "doc_id", "text")


@query(_forbidden_sql("(SELECT page_id, unnest(['/url', '/html']) AS pointer, unnest([url, html]) AS value FROM pages)", "page_id, pointer", "value", "ththre.example.com"))
def forbidden_in_json(spark, sf_dir):
    """Every string of the pages written as JSON objects, by its pointer."""
    pages = tables.scan(spark, sf_dir, "pages").select("page_id", F.to_json(F.struct("url", "html")).alias("body"))
    return json_files.forbidden_in_json(pages, "page_id", "body", allowed_host="ththre.example.com")


@query("""SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host FROM pages)
  WHERE host <> '' AND NOT (host IN ('ththre.example.com'))""")
def foreign_hosts(spark, sf_dir):
    return json_files.foreign_hosts(tables.scan(spark, sf_dir, "pages"), "page_id", "url", ["ththre.example.com"])


@query("""SELECT a.message_id, a.conversation_id, a.reply_to_message_id, a.content AS answer, u.content AS question FROM messages a
  JOIN messages u ON u.conversation_id = a.conversation_id AND u.message_id = a.reply_to_message_id AND u.role = 'user' WHERE a.role = 'assistant'""")
def conversation_turn_pairs(spark, sf_dir):
    return answering.turn_pairs(tables.messages(spark, sf_dir))


@query("""SELECT m.message_id, 'reply_target_missing' AS problem FROM messages m WHERE reply_to_message_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM messages u WHERE u.conversation_id = m.conversation_id AND u.message_id = m.reply_to_message_id)""")
def reply_problems(spark, sf_dir):
    return answering.reply_problems(tables.messages(spark, sf_dir))


@query("""SELECT conversation_id, count(*) AS n_messages, count_if(role = 'user') AS n_user, max(turn) AS last_turn FROM messages GROUP BY conversation_id
  ORDER BY max(turn) DESC, conversation_id DESC LIMIT 20""")
def list_conversations(spark, sf_dir):
    per = tables.messages(spark, sf_dir).groupBy("conversation_id").agg(F.count(F.lit(1)).alias("n_messages"), F.count_if(F.col("role") == "user").alias("n_user"), F.max("turn").alias("last_turn"))
    return adm.page(per, [F.desc("last_turn"), F.desc("conversation_id")], 20, 0)


@query("""WITH f AS (SELECT conversation_id, arg_min(content, turn) AS content FROM messages WHERE role = 'user' GROUP BY conversation_id),
  g AS (SELECT conversation_id, regexp_replace(trim(regexp_replace(content, '\\s+', ' ', 'g')), '[ .?!…]+$', '') AS flat FROM f)
  SELECT conversation_id, CASE WHEN length(flat) <= 80 THEN flat WHEN substr(flat, 81, 1) = ' ' THEN rtrim(substr(flat, 1, 80)) || '…'
    ELSE rtrim(regexp_replace(substr(flat, 1, 80), ' [^ ]*$', '')) || '…' END AS title FROM g""".replace("\\\\", "\\"))
def conversation_titles(spark, sf_dir):
    first = tables.messages(spark, sf_dir).filter("role = 'user'").groupBy("conversation_id").agg(F.min_by("content", "turn").alias("content"))
    return first.select("conversation_id", tx.conversation_title(F.col("content")).alias("title"))


_UNIT = "chr(31)"


@query(f"""WITH c AS (SELECT document_id, chunk_index, sha256(chunk_index::VARCHAR || {_UNIT} || sha256(trim(line))) AS d FROM (SELECT doc_id AS document_id, chunk_index, line FROM linesof) WHERE trim(line) <> '')
  SELECT document_id, sha256(string_agg(d, chr(10) ORDER BY chunk_index)) AS chunk_digest FROM c GROUP BY document_id""")
def content_digest(spark, sf_dir):
    chunks = tables.lines(spark, sf_dir).withColumn("content_sha256", F.sha2("content", 256))
    return digests.document_digests(chunks)


@query(f"""WITH c AS (SELECT document_id, chunk_index, sha256(chunk_index::VARCHAR || {_UNIT} || sha256(trim(line))) AS d FROM (SELECT doc_id AS document_id, chunk_index, line FROM linesof) WHERE trim(line) <> ''),
  r AS (SELECT document_id::VARCHAR AS k, sha256(document_id::VARCHAR || {_UNIT} || sha256(string_agg(d, chr(10) ORDER BY chunk_index))) AS d FROM c GROUP BY document_id),
  s AS (SELECT substr(md5(k), 1, 3) AS shelf, count(*) AS n, sha256(string_agg(d, chr(10) ORDER BY k)) AS d FROM r GROUP BY ALL)
  SELECT sum(n)::BIGINT AS n_documents, sha256(string_agg(d, chr(10) ORDER BY shelf)) AS corpus_digest FROM s""")
def corpus_digest(spark, sf_dir):
    chunks = tables.lines(spark, sf_dir).withColumn("content_sha256", F.sha2("content", 256))
    return digests.corpus_digest(digests.document_digests(chunks))


@query("""SELECT document_id FROM docs d WHERE NOT EXISTS (SELECT 1 FROM vers v WHERE v.document_id = d.document_id AND processing_status = 'pending')
  AND NOT EXISTS (SELECT 1 FROM judgments j WHERE j.document_id = d.document_id)""")
def deletable_documents(spark, sf_dir):
    """Documents that no pending version and no cited passage protects."""
    pending = tables.versions(spark, sf_dir).filter("processing_status = 'pending'").select("document_id")
    cited = tables.judgments(spark, sf_dir).select("document_id")
    return tables.documents(spark, sf_dir).select("document_id").join(pending, "document_id", "left_anti").join(cited, "document_id", "left_anti")
