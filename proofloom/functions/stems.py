"""Word analysis for full-text configurations: stop words and stems by the published Snowball rules.

English follows the Porter2 description and Portuguese the Portuguese one; ``simple`` leaves words as they are. Stems are
worked out once for each distinct word, by a pandas UDF, and joined back.
"""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from proofloom.functions.lexical import FUNCTIONAL, fts_configuration

_V = "aeiouy"
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
# Porter2 suffix tables.
_STEP2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al",
    "aliti": "al", "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble",
}
_STEP3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"}
_INVARIANT = {"sky", "news", "howe", "atlas", "cosmos", "bias", "andes"}


def _regions(word: str, vowels: str) -> tuple[int, int]:
    """Starts of R1 and R2: after the first consonant that follows a vowel, and the same again."""
    edge = re.compile(f"[{vowels}][^{vowels}]")
    first = edge.search(word)
    r1 = first.end() if first else len(word)
    second = edge.search(word, r1)
    return r1, second.end() if second else len(word)


def _short(word: str) -> bool:
    return bool(re.search(r"[^aeiouy][aeiouy][^aeiouywxY]$", word) or re.fullmatch(r"[aeiouy][^aeiouy]", word))


def _longest(word: str, suffixes) -> str:
    return next((s for s in sorted(suffixes, key=len, reverse=True) if word.endswith(s)), "")


def english(word: str) -> str:
    if len(word) <= 2 or word in _INVARIANT:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = re.sub(r"(^|[aeiouy])y", r"\1Y", word.removeprefix("'"))
    prefix = re.match("gener|commun|arsen", w)
    r1, r2 = _regions(w, _V)
    if prefix:
        r1 = prefix.end()
        again = re.compile("[aeiouy][^aeiouy]").search(w, r1)
        r2 = again.end() if again else len(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(f"[{_V}]", w[:-2]):
        w = w[:-1]
    if w in ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"):
        return w
    if w.endswith(("eed", "eedly")):
        end = "eedly" if w.endswith("eedly") else "eed"
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif (end := _longest(w, ("ed", "edly", "ing", "ingly"))) and re.search(f"[{_V}]", w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_DOUBLES):
            w = w[:-1]
        elif _short(w) and r1 >= len(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    end = _longest(w, [*_STEP2, "ogi", "li"])
    if end and len(w) - len(end) >= r1:
        if end in _STEP2:
            w = w[: -len(end)] + _STEP2[end]
        elif end == "ogi" and w.endswith("logi"):
            w = w[:-1]
        elif end == "li" and w[-3:-2] and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    end = _longest(w, [*_STEP3, "ative"])
    if end and len(w) - len(end) >= r1:
        if end in _STEP3:
            w = w[: -len(end)] + _STEP3[end]
        elif len(w) - 5 >= r2:
            w = w[:-5]
    end = _longest(w, [*_STEP4, "ion"])
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short(w[:-1])):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# Portuguese suffixes of the published rules, without accents where the text has none.
_PT_STANDARD = (
    "amentos imentos amento imento adoras adores adora ador acoes acao ações ação antes ante ancia ância ezas eza icos ica icas ico ismos ismo avel ável ivel ível istas ista osos osas oso osa idades "
    "idade ivas ivos iva ivo logias logia logías logía encias encia ências ência iras ira amente mente"
).split()
_PT_VERB = (
    "aríamos eríamos iríamos ássemos êssemos íssemos aremos eremos iremos aramos eramos iramos áramos éramos íramos ávamos aríeis eríeis iríeis ariam eriam iriam assem essem issem arias erias irias "
    "aríeis aram eram iram avam arem erem irem ando endo indo aria eria iria asse esse isse aste este iste ará erá irá ara era ira ava ada ida adas idas ados idos arão erão irão ado ido amos emos imos íamos "
    "ais eis iam ias ões ar er ir as es is am em ou eu iu ia ei"
).split()


def portuguese(word: str) -> str:
    vowels = "aeiouáéíóúâêôãõ"
    w = word.replace("ã", "a~").replace("õ", "o~")
    r1, r2 = _regions(w, vowels)
    rv = len(w)
    if len(w) > 3:
        if w[1] not in vowels:
            after = re.compile(f"[{vowels}]").search(w, 2)
            rv = after.end() if after else len(w)
        elif w[0] in vowels:
            after = re.compile(f"[^{vowels}]").search(w, 2)
            rv = after.end() if after else len(w)
        else:
            rv = 3
    end = _longest(w, [s.replace("ã", "a~").replace("õ", "o~") for s in _PT_STANDARD])
    changed = bool(end) and len(w) - len(end) >= (rv if end in ("ira", "iras") else r1 if end == "amente" else r2)
    if changed:
        w = w[: -len(end)]
        w += {"logia": "log", "logias": "log", "encia": "ente", "encias": "ente", "ência": "ente", "ências": "ente", "ira": "ir", "iras": "ir"}.get(end, "")
        more = _longest(w, ("ativ", "iv", "os", "ic", "ad", "abil", "avel", "ivel", "ante"))
        if end in ("amente", "mente", "idade", "idades", "iva", "ivo", "ivas", "ivos") and more and len(w) - len(more) >= r2:
            w = w[: -len(more)]
    else:
        end = _longest(w, [s.replace("ã", "a~").replace("õ", "o~") for s in _PT_VERB])
        if end and len(w) - len(end) >= rv:
            w, changed = w[: -len(end)], True
    if changed and w.endswith("ci") and len(w) - 1 >= rv:
        w = w[:-1]
    elif not changed and (end := _longest(w, ("os", "a", "i", "o", "á", "í", "ó"))) and len(w) - len(end) >= rv:
        w = w[: -len(end)]
    if w.endswith(("e", "é", "ê")) and len(w) - 1 >= rv:
        w = w[:-1]
        if w.endswith(("gu", "ci")) and len(w) - 1 >= rv:
            w = w[:-1]
    return w.replace("ç", "c").replace("a~", "ã").replace("o~", "õ")


@F.pandas_udf(StringType())
def stem(words: pd.Series, configurations: pd.Series) -> pd.Series:
    """Stem of each word under its configuration: english, portuguese or simple."""
    rules = {"english": english, "portuguese": portuguese}
    return pd.Series([None if w is None else rules.get(c, str)(w) for w, c in zip(words, configurations)])


STOPS = {"english": frozenset(FUNCTIONAL["en"].split()), "portuguese": frozenset(FUNCTIONAL["pt"].split()), "simple": frozenset()}


@functools.lru_cache(maxsize=200_000)
def lexeme(word: str, configuration: str) -> str:
    """Stem of a word with content, empty for others."""
    return "" if word in STOPS.get(configuration, ()) else {"english": english, "portuguese": portuguese}.get(configuration, str)(word)


@F.pandas_udf(ArrayType(StringType()))
def lexemes(words: pd.Series, configurations: pd.Series) -> pd.Series:
    """Lexemes of arrays of words, place by place; a worker remembers words that come again."""
    return pd.Series([None if own is None else [lexeme(w, c) for w in own] for own, c in zip(words, configurations)])


def postings(chunks: DataFrame) -> DataFrame:
    """chunk_id, lexeme, positions (from 1, as in a text-search vector) of normalised chunks with a language.

    Words without content keep their place but are not lexemes, except under ``simple``.
    """
    rows = chunks.withColumn("configuration", fts_configuration(F.col("language")))
    words = rows.select("chunk_id", "configuration", F.posexplode(F.regexp_extract_all("normalized", F.lit(r"(?U)([^\W_]+)"), F.lit(1))).alias("place", "word"))
    stops = {"english": FUNCTIONAL["en"].split(), "portuguese": FUNCTIONAL["pt"].split()}
    dropped = F.lit(False)
    for name, own in stops.items():
        dropped = dropped | ((F.col("configuration") == name) & F.col("word").isin(own))
    kept = words.filter(~dropped)
    stems = kept.select("word", "configuration").distinct().withColumn("lexeme", stem("word", "configuration"))
    joined = kept.join(stems, ["word", "configuration"])
    return joined.groupBy("chunk_id", "lexeme").agg(F.sort_array(F.collect_list(F.col("place") + 1)).alias("positions"))


def accent_map(surfaces: DataFrame, plain: str = "plain", accented: str = "word", order: str = "position") -> DataFrame:
    """plain form -> its first accented form in the vocabulary."""
    return surfaces.filter(F.col(plain) != F.col(accented)).groupBy(plain).agg(F.min_by(accented, order).alias("accented"))


def project_terms(rows: DataFrame, column: str, mapping: DataFrame, key: str, value: str) -> DataFrame:
    """``column`` (array of terms) through a map table; terms with a prefix (``ord:``, ``rng:``) and unknown ones stay."""
    flat = rows.withColumn("__row", F.monotonically_increasing_id()) if "__row" not in rows.columns else rows
    terms = flat.select("__row", F.posexplode_outer(column).alias("__i", "__t"))
    found = terms.join(mapping.select(F.col(key).alias("__t"), F.col(value).alias("__v")), "__t", "left")
    out = F.when(F.col("__t").rlike("^(ord|rng):"), F.col("__t")).otherwise(F.coalesce("__v", "__t"))
    back = found.groupBy("__row").agg(F.transform(F.sort_array(F.collect_list(F.when(F.col("__t").isNotNull(), F.struct("__i", out.alias("o"))))), lambda x: x["o"]).alias(column))
    return flat.drop(column).join(back, "__row").drop("__row")


def cover_density(positions: list[list[int]], weight: float = 0.1) -> float:
    """Rank of a text by its covers: shortest stretches that hold every query lexeme, each worth its lexemes' weight over its spread.

    After the published cover-density ranking: a cover of n lexemes without a word between them counts n / (1/w summed),
    and every word in between divides it further.
    """
    if not positions or any(not p for p in positions):
        return 0.0
    places = sorted((p, k) for k, own in enumerate(positions) for p in own)
    need, total, last, left = len(positions), 0.0, -1, 0
    held: dict[int, int] = {}
    for right, (_, k) in enumerate(places):
        held[k] = held.get(k, 0) + 1
        while len(held) == need:
            lower = places[left]
            if held[lower[1]] == 1:
                if lower[0] != last:
                    span = [p for p, _ in places[left : right + 1]]
                    noise = span[-1] - span[0] - (len(set(span)) - 1)
                    total += len(span) / (len(span) / weight) / (1 + max(0, noise))
                    last = lower[0]
                del held[lower[1]]
            else:
                held[lower[1]] -= 1
            left += 1
    return total
