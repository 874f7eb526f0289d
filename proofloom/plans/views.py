"""DuckDB views of the evidence tables, the SQL twin of ``sources.tables``; each entry is one common table expression."""

from __future__ import annotations

REFERENCE_DATE = "2024-06-01"

_NORMAL = r"trim(regexp_replace(replace(lower(strip_accents({0})), 'ß', 'ss'), '\s+', ' ', 'g'))"


def normal(text: str) -> str:
    return _NORMAL.format(text)


def _list(words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words.split()) + "]"


# Words without content in English.
EN = _list("a an the of to in on for with from at and or what which when where how who is are does do can should have has")

TOKEN = r"'(\d+\s*(?:a|-|–|—)\s*\d+|[\p{L}\p{N}]+)'"
WORD = r"'[\p{L}\p{N}]+'"
_WRITTEN = "first second third fourth fifth sixth seventh eighth ninth tenth".split()
_ORD = " ".join(f"WHEN '{w}' THEN 'ord:{n}'" for n, w in enumerate(_WRITTEN, 1))

VIEWS = {
    "docs": """SELECT doc_id AS document_id, 'i' || (doc_id % 2) AS institution_id, lang AS language, source, split_part(text, chr(10), 1) AS title,
  doc_id % 3 <> 0 AS official_source, doc_id % 17 <> 0 AS is_active,
  CASE WHEN doc_id % 5 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 700 - 350 AS INTEGER) END AS valid_from,
  CASE WHEN doc_id % 7 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 900 - 150 AS INTEGER) END AS valid_until, text FROM documents""",
    "vers": """SELECT doc_id * 10 + n AS version_id, doc_id AS document_id, 'i' || (doc_id % 2) AS institution_id, n AS version_number,
  CASE (doc_id + n) % 10 WHEN 9 THEN 'failed' WHEN 4 THEN 'pending' ELSE 'processed' END AS processing_status, strlen(text)::BIGINT AS size_bytes,
  sha256(text) AS checksum_sha256 FROM documents, (VALUES (1), (2)) v(n) WHERE n = 1 OR doc_id % 4 = 0""",
    "linesof": """SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk_index FROM documents""",
    "chunks": """SELECT (doc_id * 10 + n) * 1000000 + chunk_index AS chunk_id, doc_id * 10 + n AS version_id, doc_id AS document_id, 'i' || (doc_id % 2) AS institution_id,
  lang AS language, chunk_index, trim(line) AS content, CASE WHEN contains(trim(line), ' | ') THEN 'table_row' ELSE 'paragraph' END AS structure_type
  FROM linesof, (VALUES (1), (2)) v(n) WHERE (n = 1 OR doc_id % 4 = 0) AND trim(line) <> ''""",
    "latest": """SELECT document_id, institution_id, version_id AS latest_version_id, version_number AS latest_version_number FROM vers
  WHERE processing_status = 'processed' QUALIFY row_number() OVER (PARTITION BY document_id, institution_id ORDER BY version_number DESC) = 1""",
    "cands": """SELECT c.*, d.institution_id AS document_institution, d.language AS document_language, d.title, d.official_source, d.is_active, d.valid_from, d.valid_until,
  v.institution_id AS version_institution, v.version_number, v.processing_status, l.latest_version_id
  FROM chunks c JOIN vers v USING (version_id, document_id) JOIN docs d USING (document_id)
  LEFT JOIN latest l ON l.document_id = c.document_id AND l.institution_id = v.institution_id""",
    "elig": f"""SELECT * FROM cands WHERE document_institution = institution_id AND version_institution = institution_id AND processing_status = 'processed'
  AND version_id = latest_version_id AND is_active AND document_language = 'en' AND language = 'en'
  AND (valid_from IS NULL OR valid_from <= DATE '{REFERENCE_DATE}') AND (valid_until IS NULL OR valid_until >= DATE '{REFERENCE_DATE}')""",
    "questions": f"""SELECT item_id AS question_id, 'i' || (item_id % 2) AS institution_id, 'en' AS language,
  {normal('text')} AS query, text FROM benchmark""",
    "qterms": f"""SELECT *, list_slice(list_filter(raw, lambda t, i: NOT (length(t) = 1 AND regexp_full_match(t, '\\p{{L}}')) AND NOT list_contains({EN}, t)
  AND list_position(raw, t) = i), 1, 12) AS informative FROM (SELECT *, regexp_extract_all(query, {WORD}) AS raw FROM questions)""",
    "dwords": f"""SELECT doc_id AS document_id, text, regexp_extract_all({normal('text')}, {WORD}) AS ws FROM documents""",
    "judgments": """SELECT question_id, document_id, CASE WHEN contains(d.text, q.text) THEN 2 ELSE 1 END AS grade FROM qterms q JOIN dwords d
  ON contains(d.text, q.text) OR (len(q.informative) > 0 AND list_has_all(d.ws, q.informative))""",
    "messages": """SELECT conv_id * 10000 + turn AS message_id, conv_id AS conversation_id, turn, role, text AS content,
  CASE WHEN role = 'assistant' THEN conv_id * 10000 + turn - 1 END AS reply_to_message_id FROM conversations""",
    "etoks": f"""SELECT chunk_id, unnest(toks) AS surface, generate_subscripts(toks, 1) - 1 AS position
  FROM (SELECT chunk_id, regexp_extract_all({normal('content')}, {TOKEN}) AS toks FROM elig)""",
    "ekeys": f"""SELECT chunk_id, position, surface, CASE
    WHEN regexp_full_match(surface, '\\d+\\s*(a|-|–|—)\\s*\\d+') THEN 'rng:' || least(a, b)::VARCHAR || '-' || greatest(a, b)::VARCHAR
    WHEN regexp_full_match(surface, '\\d+(st|nd|rd|th)') THEN 'ord:' || a::VARCHAR
    ELSE CASE surface {_ORD} ELSE surface END END AS canonical
  FROM (SELECT *, try_cast(regexp_extract_all(surface, '\\d+')[1] AS HUGEINT) AS a, try_cast(regexp_extract_all(surface, '\\d+')[-1] AS HUGEINT) AS b FROM etoks)""",
}


def with_views(sql: str) -> str:
    """The query with the views it names, directly or through others, as common table expressions."""
    import re

    wanted: list[str] = []

    def need(text: str) -> None:
        for name in re.findall(r"\b(?:FROM|JOIN|,)\s+(\w+)", text):
            if name in VIEWS and name not in wanted:
                need(VIEWS[name])
                if name not in wanted:
                    wanted.append(name)

    need(sql)
    if not wanted:
        return sql
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in wanted)
    body = sql.strip()
    for start in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(start):
            return f"{start} {head}, {body[len(start) :].lstrip()}"
    return f"WITH {head} {body}"
