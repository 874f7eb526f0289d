"""Structure-aware chunks with exact offsets.

Pages, lines and their classes are relational: ``lines`` explodes them with code-point offsets, ``classify`` names
each from itself and its neighbours, ``units`` joins lines to headings, rows, items and paragraphs with their text.
Units that may share a chunk make a run; a run is packed by a greedy fold over its units, a unit that is too long by a
fold over its windows, both as Columns. All of it follows one shuffle by document. ``content`` is always the text
between its offsets, no chunk crosses a page, and chunk_index counts from 0.

A null or blank text has no chunks. Rows are chunked one by one, also where keys repeat or are null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proofloom.functions.text import normalize_text

SIZE, OVERLAP = 1200, 150
STRUCTURED, FALLBACK = "structured_v1", "character_fallback_v1"

# Forms of list items and headings, and what separates columns and pages.
LIST_ITEM = r"^(?:[-*•]\s+|\d+[.)]\s+|[A-Za-z][)]\s+)"
MARKDOWN_HEADING, NUMBERED_HEADING = r"^#{1,6}\s+\S", r"^\d+(?:\.\d+)+(?:[.)])?\s+\S"
COLUMNS, PAGE = " | ", "\f"
BREAK = r"\r\n|\r|\n"
#: White space as it is stripped from both ends of lines and chunks.
BLANK = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Characters in the slices of a long unit's text, so that a window is cut from a few of them.
_SLICE = 4096


# ---- relational part ------------------------------------------------------------------------------------


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{BLANK}+", ""), f"{BLANK}+$", "")


def lines(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """key, page_number, line_index (in the page), start_char, line (trimmed at both ends), raw, separator of every line."""
    pages = documents.select(key, F.posexplode(F.split(text, PAGE)).alias("p", "page"))
    order = Window.partitionBy(key).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    pages = pages.withColumn("base", F.coalesce(F.sum(F.length("page") + 1).over(order), F.lit(0)))
    parts = F.arrays_zip(F.split("page", BREAK).alias("raw"), F.regexp_extract_all("page", F.lit(f"({BREAK})"), F.lit(1)).alias("separator"))
    flat = pages.select(key, (F.col("p") + 1).alias("page_number"), "base", F.posexplode(parts).alias("line_index", "l"))
    flat = flat.select(key, "page_number", "base", "line_index", "l.raw", F.coalesce("l.separator", F.lit("")).alias("separator"))
    within = Window.partitionBy(key, "page_number").orderBy("line_index").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("base") + F.coalesce(F.sum(F.length("raw") + F.length("separator")).over(within), F.lit(0))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", f"^{BLANK}+", ""))
    return flat.select(key, "page_number", "line_index", (at + indent).alias("start_char"), stripped(F.col("raw")).alias("line"), "raw", "separator")


def is_heading(line: Column, blank_before: Column, blank_after: Column, text_after: Column) -> Column:
    letters = F.length(F.regexp_replace(line, r"\P{L}", ""))
    upper = F.length(F.regexp_replace(line, r"\P{Lu}", ""))
    n_words = F.size(F.regexp_extract_all(line, F.lit(r"(\S+)"), F.lit(1)))
    short = F.length(line) <= 120
    alone = blank_before & blank_after & text_after & n_words.between(1, 8) & (F.length(line) <= 80) & ~line.rlike(r"[.!?;,]$")
    return line.rlike(MARKDOWN_HEADING) | line.rlike(NUMBERED_HEADING) | (short & line.endswith(":")) | ((letters >= 3) & short & (upper >= letters * 0.8)) | alone


def classify(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds line_type to ``lines``: blank, table_row, list_item, heading or paragraph."""
    order = Window.partitionBy(key, "page_number").orderBy("line_index")
    is_blank = F.col("line") == ""
    before = F.coalesce(F.lag(is_blank).over(order), F.lit(True))
    after = F.coalesce(F.lead(is_blank).over(order), F.lit(False))
    rest = F.coalesce(F.max(~is_blank).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(False))
    line = F.col("line")
    kind = F.when(line == "", "blank").when(line.contains(COLUMNS), "table_row").when(line.rlike(LIST_ITEM), "list_item")
    return rows.withColumn("line_type", kind.when(is_heading(line, before, after, rest), "heading").otherwise("paragraph"))


def sections(rows: DataFrame, key: str = "document_id") -> DataFrame:
    """Adds section_title (last heading on the page, itself included) and island (paragraph runs count once)."""
    order = Window.partitionBy(key, "page_number").orderBy("line_index")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    title = F.last(F.when(F.col("line_type") == "heading", F.col("line")), ignorenulls=True).over(so_far)
    starts = ~((F.col("line_type") == "paragraph") & F.coalesce(F.lag("line_type").over(order) == "paragraph", F.lit(False)))
    rows = rows.withColumn("section_title", title).withColumn("__new", starts.cast("int"))
    return rows.withColumn("island", F.sum("__new").over(so_far)).drop("__new")


def units(documents: DataFrame, key: str = "document_id", text: str = "text") -> DataFrame:
    """The contiguous pieces before packing: key, page_number, unit, structure_type, section_title, start_char, end_char, indent, body, tail, gap.

    ``body`` is the text between the offsets, ``indent`` what its first line has before it, ``tail`` what follows up to the line
    of the next unit of the page, ``gap`` whether two line breaks with only
    blanks between them lie before the unit, for which the two characters of one Windows line end count as well.
    """
    rows = sections(classify(lines(documents, key, text), key), key)
    so_far = Window.partitionBy(key, "page_number").orderBy("line_index").rowsBetween(Window.unboundedPreceding, 0)
    held = F.col("line_type") != "blank"
    rows = rows.withColumn("unit", F.max(F.when(held, F.col("island"))).over(so_far)).filter("unit is not null")
    own = lambda c: F.when(held, c)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", F.concat("raw", "separator").alias("t")))), lambda s: s["t"]), "")
    found = rows.groupBy(key, "page_number", "unit").agg(
        F.min_by("line_type", own(F.col("line_index"))).alias("structure_type"), F.min_by("section_title", own(F.col("line_index"))).alias("section_title"),
        F.min(own(F.col("start_char"))).alias("start_char"), F.max(own(F.col("start_char") + F.length("line"))).alias("end_char"),
        joined.alias("whole"), F.max((~held & F.col("raw").rlike(r"^[ \t]*$")) | (F.col("separator") == "\r\n")).alias("then_gap"),
    )
    length = (F.col("end_char") - F.col("start_char")).cast("int")
    whole = F.regexp_replace("whole", f"^{BLANK}+", "")
    before = Window.partitionBy(key, "page_number").orderBy("unit")
    return found.select(
        key, "page_number", "unit", "structure_type", "section_title", "start_char", "end_char",
        F.regexp_extract("whole", f"^({BLANK}*)", 1).alias("indent"), F.substring(whole, F.lit(1), length).alias("body"), F.substring(whole, length + 1, F.length(whole)).alias("tail"), F.coalesce(F.lag("then_gap").over(before), F.lit(False)).alias("gap"),
    )


# ---- packing ---------------------------------------------------------------------------------------------


CHUNK = (
    "chunk_index int, content string, normalized_content string, content_sha256 string, start_char int, end_char int, page_number int, "
    "section_title string, structure_type string, chunking_strategy string"
)


def _last_end(zone: Column, what: str) -> Column:
    """Characters of a text up to the end of the last match, 0 without one."""
    return F.length(F.regexp_extract(zone, f"(?s)^(.*(?:{what}))", 1))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def windows(body: Column, size: int, overlap: int) -> Column:
    """array<struct<start, end>> in a long text: windows of at most ``size``, cut at the last line break, else blank, past the overlap."""
    length = F.length(body)
    slices = F.regexp_extract_all(body, F.lit(f"(?s)(.{{1,{_SLICE}}})"), F.lit(1))
    needed = size // _SLICE + 2
    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    start = F.struct(slices.alias("slices"), length.alias("length"), F.lit(0).alias("at"), none.alias("found"))

    def cut(zone: Column) -> Column:
        return _let(_last_end(zone, BREAK), lambda lined: F.when(lined > 0, lined).otherwise(_last_end(zone, r"[ \t]")))

    def put(acc: Column, stop: Column) -> Column:
        at, whole = acc["at"], acc["length"]
        then = F.when((stop == whole) & (at + size >= whole), whole).otherwise(F.greatest(stop - overlap, at + 1)).cast("int")
        found = F.concat(acc["found"], F.array(F.struct(at.alias("start"), stop.alias("end"))))
        return F.struct(acc["slices"].alias("slices"), whole.alias("length"), then.alias("at"), found.alias("found"))

    def step(acc: Column, _: Column) -> Column:
        at, whole = acc["at"], acc["length"]
        first = F.floor((at + overlap) / _SLICE).cast("int")
        zone = F.substring(F.array_join(F.slice(acc["slices"], first + 1, needed), ""), (at + overlap - first * _SLICE + 1).cast("int"), F.lit(size - overlap))
        early = _let(_let(zone, cut), lambda n: F.when(n > 0, at + overlap + n).otherwise(at + size))
        stop = F.when(at + size >= whole, whole).otherwise(early).cast("int")
        return F.when(at >= whole, acc).otherwise(_let(stop, lambda s: put(acc, s)))

    # behind the last break of a zone the next zone has none up to where the first one ended, so of four windows in a row one is long
    most = F.lit(4) * F.ceil(length / F.lit(size - overlap)) + F.lit(4)
    return F.aggregate(F.sequence(F.lit(1).cast("long"), most), start, step, lambda acc: acc["found"])


def packed(run: Column, size: int) -> Column:
    """array<struct<start, end, n, body, tail>>: the units of a run, each put to the chunk before while that stays within ``size``."""
    kind = "struct<start: bigint, end: bigint, n: int, body: string, tail: string>"
    start = F.struct(F.expr(f"cast(array() as array<{kind}>)").alias("done"), F.expr(f"cast(null as {kind})").alias("open"))
    whole = lambda s, e, n, body, tail: F.struct(s.cast("long").alias("start"), e.cast("long").alias("end"), n.alias("n"), body.alias("body"), tail.alias("tail"))

    def step(acc: Column, u: Column) -> Column:
        held = acc["open"]
        fits = held.isNotNull() & (u["end_char"] - held["start"] <= size)
        more = whole(held["start"], u["end_char"], held["n"] + 1, F.concat(held["body"], held["tail"], u["indent"], u["body"]), u["tail"])
        fresh = whole(u["start_char"], u["end_char"], F.lit(1), u["body"], u["tail"])
        done = F.when(fits | held.isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(held)))
        return F.struct(done.alias("done"), F.when(fits, more).otherwise(fresh).alias("open"))

    return F.aggregate(run, start, step, lambda acc: F.concat(acc["done"], F.array(acc["open"])))


def chunk_documents(documents: DataFrame, key: str = "document_id", text: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """key and the chunk columns for every document; a null or blank text has no chunks."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap below it")
    each = documents.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key")).alias("__doc"), F.col(text).cast("string").alias("__text"))
    rows = units(each, "__doc", "__text")
    page = ["__doc", "page_number"]
    order = Window.partitionBy(*page).orderBy("unit")
    long = F.col("end_char") - F.col("start_char") > size
    alone = long | F.col("structure_type").isin("heading", "table_row")
    like = lambda c: F.lag(c).over(order).eqNullSafe(F.col(c))
    joins = ~alone & ~F.coalesce(F.lag(alone).over(order), F.lit(True)) & like("structure_type") & like("section_title") & ~((F.col("structure_type") == "list_item") & F.col("gap"))
    rows = rows.withColumns({"long": long, "fresh": (~joins).cast("int")})
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    unit = F.struct("unit", "start_char", "end_char", "indent", "body", "tail")
    runs = rows.groupBy(*page, "run").agg(F.first("structure_type").alias("kind"), F.first("section_title").alias("section_title"), F.first("long").alias("long"), F.array_sort(F.collect_list(unit)).alias("units"))
    whole = runs.filter(~F.col("long")).select(*page, "kind", "section_title", F.explode(packed(F.col("units"), size)).alias("c"))
    block = F.when((F.col("kind") == "list_item") & (F.col("c.n") > 1), "list_block").otherwise(F.col("kind"))
    whole = whole.select(*page, "section_title", block.alias("structure_type"), F.col("c.start").alias("start"), F.col("c.body").alias("content"), F.lit(STRUCTURED).alias("chunking_strategy"))
    cut = runs.filter("long").select(*page, "section_title", F.element_at("units", 1).alias("u"))
    cut = cut.withColumn("w", F.explode(windows(F.col("u.body"), size, overlap)))
    cut = cut.withColumn("raw", F.substring(F.col("u.body"), F.col("w.start") + 1, F.col("w.end") - F.col("w.start")))
    indent = F.length("raw") - F.length(F.regexp_replace("raw", f"^{BLANK}+", ""))
    cut = cut.select(*page, "section_title", F.lit("fallback_fragment").alias("structure_type"), (F.col("u.start_char") + F.col("w.start") + indent).alias("start"), stripped(F.col("raw")).alias("content"), F.lit(FALLBACK).alias("chunking_strategy"))
    found = whole.unionByName(cut.filter("content <> ''"))
    index = F.row_number().over(Window.partitionBy("__doc").orderBy("start")) - 1
    return found.select(
        F.col("__doc.key").alias(key), index.alias("chunk_index"), "content", normalize_text(F.col("content")).alias("normalized_content"), F.sha2("content", 256).alias("content_sha256"),
        F.col("start").cast("int").alias("start_char"), (F.col("start") + F.length("content")).cast("int").alias("end_char"), "page_number", "section_title", "structure_type", "chunking_strategy",
    )


def rebuild(documents: DataFrame, chunks: DataFrame, cited: DataFrame) -> DataFrame:
    """New chunks of every document that nothing cites, and the old ones of the rest. Running it twice changes nothing."""
    free = documents.join(cited.select("document_id").distinct(), "document_id", "left_anti")
    kept = chunks.join(cited.select("document_id").distinct(), "document_id", "left_semi")
    return chunk_documents(free).unionByName(kept.select("document_id", *(c.split()[0] for c in CHUNK.split(", "))))
