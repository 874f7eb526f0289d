"""Text normalisation as Columns: JVM functions where the alphabet is known, one pandas UDF for the rest."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_BLANKS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def normalize(text: str) -> str:
    """Compatibility decomposition without combining marks, case folded, blanks collapsed."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return " ".join(plain.casefold().split())


def without_marks(text: str) -> str:
    """Compatibility decomposition without combining marks; case stays."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _latin_table() -> tuple[str, str]:
    """Characters up to U+024F that normalise to another single character, and that character."""
    pairs = []
    for code in range(0x41, 0x250):
        c = chr(code)
        folded = without_marks(c).casefold()
        if c != folded and len(folded) == 1 and not c.isspace():
            pairs.append((c, folded))
    return "".join(p[0] for p in pairs), "".join(p[1] for p in pairs)


def _known_class() -> str:
    """Pattern of a character outside what the JVM path handles: single-character results, the sharp s and blanks."""
    known = [c for c in range(0x250) if len(without_marks(chr(c)).casefold()) == 1 or chr(c) == "ß"]
    ends = [c for c in known if c + 1 not in known]
    starts = [c for c in known if c - 1 not in known]
    return "[^" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(starts, ends)) + "–—]"


_FROM, _TO = _latin_table()
_UNKNOWN = _known_class()


@F.pandas_udf(StringType())
def _normalize_udf(texts: pd.Series) -> pd.Series:
    return texts.map(normalize, na_action="ignore")


@F.pandas_udf(StringType())
def strip_diacritics(texts: pd.Series) -> pd.Series:
    return texts.map(without_marks, na_action="ignore")


def normalize_latin(text: Column) -> Column:
    """``normalize`` inside the JVM for texts of Latin letters up to U+024F."""
    folded = F.replace(F.translate(text, _FROM, _TO), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, _BLANKS, " "))


def normalize_text(text: Column) -> Column:
    """``normalize``; only texts with other characters take the Python path (the rest send it nulls)."""
    other = text.rlike(_UNKNOWN)
    return F.coalesce(_normalize_udf(F.when(other, text)), normalize_latin(text))


def normalize_literal(text: Column) -> Column:
    """Blanks collapsed and lower case, accents kept."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), _BLANKS, " "))


def normalize_language(code: Column) -> Column:
    """Trimmed, lower case, with hyphens; null unless 2 to 8 characters remain."""
    plain = F.replace(F.lower(F.trim(code)), F.lit("_"), F.lit("-"))
    return F.when(F.length(plain).between(2, 8), plain)


def resolve_language(asked: Column, fallback: Column, supported: Column) -> Column:
    """The asked language, the fallback where none was asked, null where it is not supported."""
    plain = F.when(asked.isNull(), normalize_language(fallback)).otherwise(normalize_language(asked))
    return F.when(F.array_contains(supported, plain), plain)


def useful_characters(text: Column) -> Column:
    """Characters that are not blanks."""
    return F.length(F.regexp_replace(text, _BLANKS, ""))


def conversation_title(text: Column, limit: int = 80) -> Column:
    """First message as a title: one line, no closing marks, cut at the last blank before the limit."""
    flat = F.regexp_replace(F.trim(F.regexp_replace(text, _BLANKS, " ")), r"[ .?!…]+$", "")
    head = F.substring(flat, 1, limit)
    at_blank = F.regexp_replace(head, r" [^ ]*$", "")
    short = F.when(F.substring(flat, limit + 1, 1) == " ", head).otherwise(at_blank)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(short), F.lit("…")))


def excerpt(text: Column, start: Column | int = 0, length: Column | int = 200) -> Column:
    """A slice by code points, control line marks shown as blanks."""
    cut = F.substring(text, F.lit(start) + 1 if isinstance(start, int) else start + 1, F.lit(length) if isinstance(length, int) else length)
    return F.regexp_replace(cut, r"[\r\n\f\t]", " ")


def page_number(text: Column, offset: Column) -> Column:
    """1 plus the form feeds before the offset."""
    return F.length(F.regexp_replace(F.substring(text, F.lit(1), offset), r"[^\f]", "")) + 1


def contact_email(text: Column) -> Column:
    """Trimmed and lower case; null unless it is one address with a dotted domain."""
    plain = F.lower(F.trim(text))
    good = plain.rlike(r"^[a-z0-9._%+-]+@[a-z0-9](?:[a-z0-9-]*[a-z0-9])?(?:\.[a-z0-9](?:[a-z0-9-]*[a-z0-9])?)+$") & (F.length(plain) <= 255)
    return F.when(good & ~plain.contains(".."), plain)


def contact_url(text: Column) -> Column:
    """Trimmed; null unless http or https with a host, without user data and at most 2048 long."""
    plain = F.trim(text)
    host = F.regexp_extract(plain, r"^https?://([^/?#\s]+)", 1)
    return F.when((host != "") & ~host.contains("@") & ~plain.rlike(r"\s") & (F.length(plain) <= 2048), plain)


def register(spark: SparkSession) -> None:
    """SQL names of the functions that Spark lacks."""
    spark.udf.register("normalize_text", _normalize_udf)
    spark.udf.register("strip_diacritics", strip_diacritics)


_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text)
